"""Run a query and its SQL on the same tables and compare."""

import os
from functools import cache

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@cache
def tables(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row) for row in frame.itertuples(index=False))


def compare(spark, run, sql: str, sf_dir: str = SF) -> None:
    got, want = run(spark, sf_dir).toPandas(), tables(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:
        if got[c].dtype.kind == "i" and want[c].dtype.kind == "f" or got[c].dtype.kind == "f" and want[c].dtype.kind == "i":
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert _rows(got) == _rows(want)
