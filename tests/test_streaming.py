import pytest
from pyspark.sql import functions as F

from zetaflow.operators import zset
from zetaflow.sources.state import Locked
from zetaflow.streaming.pipeline import KeyedPipeline, Pipeline, bag, count, retained, sums, table

SCHEMA = "k long, v long, _delta long, _seq long"


def feed(spark, rows):
    return spark.createDataFrame([(k, v, d, i) for i, (k, v, d) in enumerate(rows)], SCHEMA)


def sinks():
    pairs = lambda c: c.select("k", "v", "_delta")
    return [count("n"), bag("bag", "k long, v long", pairs), sums("by_key", "k", "long", {"total": "v"}), table("last", ["k"], "k long, v long")]


def contents(pipeline):
    return [sorted(map(tuple, f.collect())) for f in pipeline.read("n", "bag", "by_key", "last")]


def test_incremental_equals_recomputation_and_retraction_empties(spark, tmp_path):
    batches = [[(1, 10, 1), (1, 5, 1), (2, 7, 1)], [(1, 5, -1), (3, 1, 2)], [(1, 10, -1), (2, 7, -1)]]
    step = Pipeline(spark, str(tmp_path / "a"), sinks())
    for b in batches:
        step.write(feed(spark, b))
    n, rows, by_key, _ = contents(step)
    assert n == [(2,)] and rows == [(3, 1, 2)] and by_key == [(3, 2, 2.0)]
    once = Pipeline(spark, str(tmp_path / "b"), sinks())
    once.write(feed(spark, [x for b in batches for x in b]))
    assert contents(once)[:3] == [n, rows, by_key]
    step.write(feed(spark, [(3, 1, -2)]))
    assert contents(step)[1:3] == [[], []]


def test_a_failed_transaction_publishes_nothing_and_reads_see_one_snapshot(spark, tmp_path):
    p = Pipeline(spark, str(tmp_path / "s"), sinks())
    p.write(feed(spark, [(1, 1, 1)]))
    before = contents(p)
    with pytest.raises(Exception):
        p.write(feed(spark, [(2, 2, 1)]).withColumn("v", F.raise_error(F.lit("stop")).cast("long")))
    assert contents(p) == before and p.state.snapshot()["version"] == 1
    shown = p.preview(feed(spark, [(1, 1, 1)]))
    assert shown["n"].first().n == 2 and contents(p) == before
    p.state.lock()
    with pytest.raises(Locked):
        p.write(feed(spark, [(2, 2, 1)]))
    p.state.unlock()
    again = Pipeline(spark, str(tmp_path / "s"), sinks())
    assert contents(again) == before
    assert p.state.stats()["bag"]["rows"] == 1


def test_replayed_batches_are_no_ops_and_streams_resume(spark, tmp_path):
    p = Pipeline(spark, str(tmp_path / "s"), sinks())
    assert p.write(feed(spark, [(1, 1, 1)]), batch=0) == p.write(feed(spark, [(1, 1, 1)]), batch=0) == 1
    q = Pipeline(spark, str(tmp_path / "q"), sinks())
    for i in range(2):
        feed(spark, [(i, 10 * i, 1), (i, 3, 1)]).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        q.stream(source, str(tmp_path / "ckpt")).awaitTermination()
        assert q.read("n")[0].first().n == 2 * (i + 1)


def test_retain_by_arrival(spark, tmp_path):
    now = [0]
    p = Pipeline(spark, str(tmp_path / "r"), [retained("live", "k long", ["k"], 100, lambda: now[0])])

    def at(t, rows):
        now[0] = t
        p.write(feed(spark, [(k, 0, d) for k, d in rows]))
        return sorted(r.k for r in p.read("live")[0].collect())

    assert at(1000, [(1, 1), (2, 1)]) == [1, 2]
    assert at(1050, [(3, 1)]) == [1, 2, 3]
    assert at(1100, []) == [1, 2, 3]  # an entry exactly at the horizon stays
    assert at(1150, []) == [3]
    assert at(1200, []) == []
    assert at(2000, [(9, 3)]) == [9, 9, 9]
    assert at(2020, [(9, -1)]) == [9, 9]
    assert at(2200, []) == []
    assert at(2200, [(9, -1)]) == []
    assert at(2200, [(9, 1)]) == [9]


def test_keyed_upserts(spark, tmp_path):
    p = KeyedPipeline(spark, str(tmp_path / "k"), ["k"], "k long, v string", [bag("bag", "v string", lambda c: c.select("v", "_delta")), table("last", ["k"], "k long, v string")])

    def write(*rows):
        p.write(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "k long, v string, _op string, _seq long"))
        return sorted(map(tuple, p.rows().collect()))

    assert write((1, "a", "u"), (2, "b", "u")) == [(1, "a"), (2, "b")]
    assert write((1, "c", "u")) == [(1, "c"), (2, "b")]
    assert write((1, "c", "u"), (2, "", "d"), (9, "", "d")) == [(1, "c")]
    assert write((4, "x", "u"), (4, "y", "u")) == [(1, "c"), (4, "y")]
    assert sorted(map(tuple, p.pipeline.read("bag")[0].collect())) == [("c", 1), ("y", 1)]
    assert sorted(map(tuple, p.pipeline.read("last")[0].collect())) == [(1, "c"), (4, "y")]
    assert p.get("k = 4").first().v == "y"


def test_duplicate_sink_names(spark, tmp_path):
    with pytest.raises(ValueError):
        Pipeline(spark, str(tmp_path / "d"), [count("n"), count("n")])


def test_strict_consolidation(spark):
    with pytest.raises(Exception):
        zset.consolidate(feed(spark, [(1, 1, -1)]), strict=True).collect()


def test_a_commit_rewrites_the_buckets_it_touches(spark, tmp_path):
    root = str(tmp_path / "d")
    p = Pipeline(spark, root, sinks())
    p.write(feed(spark, [(i, i, 1) for i in range(300)]))
    before = p.state.snapshot()["tables"]["last"]["at"]
    p.write(feed(spark, [(7, 70, 1), (8, 8, -1)]).withColumn("k", F.col("k").cast("int")))  # another type of the same key
    after = p.state.snapshot()["tables"]["last"]["at"]
    assert len(before) > 50 and 1 <= sum(before[b] != after.get(b) for b in before) <= 2
    n, rows, by_key, last = contents(p)
    assert n == [(300,)] and dict(last) == {i: i for i in range(300) if i != 8} | {7: 70} and len(by_key) == 299
    assert (7, 70, 1) in rows and (8, 8, 1) not in rows
    p.write(feed(spark, []))
    assert p.state.snapshot()["tables"]["last"]["at"] == after and contents(p) == [n, rows, by_key, last]
    # another number of buckets deals everything anew
    other = sinks()
    other[3].buckets = 5
    q = Pipeline(spark, root, other)
    q.write(feed(spark, [(1, 11, 1)]))
    assert len(q.state.snapshot()["tables"]["last"]["at"]) == 5 and dict(contents(q)[3]) == dict(last) | {1: 11}


def test_keyed_rows_meet_only_the_buckets_of_their_keys(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v long, _op string, _seq long")
    p = KeyedPipeline(spark, str(tmp_path / "k"), ["k"], "k long, v long", [sums("all", "v", "long", {"total": "k"})])
    p.write(rows(*((i, i % 3, "u", i) for i in range(100))))
    near = p.pipeline.near("_rows", rows((5, 0, "u", 0)))
    assert near.filter("k = 5").count() == 1 and near.count() < 20
    p.write(rows((5, 9, "u", 1), (6, 0, "d", 2), (400, 9, "u", 3)))
    assert p.rows().count() == 100 and p.get("k = 5").first().v == 9
    assert {r.v: (r.n, r.total) for r in p.pipeline.read("all")[0].collect()}[9] == (2, 405.0)
