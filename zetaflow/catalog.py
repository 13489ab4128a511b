"""All queries of the package outside ``llm`` with the SQL that checks them."""

from __future__ import annotations

from .plans import algebra, base, documents, retrieval, text, vectors  # noqa: F401


def entry(spark, sf_dir):
    return base.QUERIES["b4_bm25"](spark, sf_dir)


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
