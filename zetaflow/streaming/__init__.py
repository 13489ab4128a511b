"""Incremental pipelines over change streams."""
