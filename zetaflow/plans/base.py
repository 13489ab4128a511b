"""Registry of queries. A query takes (spark, sf_dir); its SQL runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


#: Milliseconds since the epoch of a naive timestamp, whatever the session's zone.
MILLIS = "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))"


def query(name: str, sql: str | None = None):
    def register(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def load(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column) -> Column:
    """Six decimals, rounded half up the same way in every engine."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def s6(x: str) -> str:
    return f"floor(({x})*1e6+0.5::double)/1e6"
