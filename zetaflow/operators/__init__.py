"""Operators: signed multisets, search, vectors, ranking, clustering, ingest, metrics."""
