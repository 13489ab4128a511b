"""Incremental pipelines: a graph of sinks over one change stream, committed together.

A sink turns its stored state and a batch of changes into its next state. A
transaction applies a batch to every sink and publishes them under one version; a
stream does so for every micro-batch, once, by batch number. Sinks with a key lie
in buckets of it: a commit reads and rewrites those that its changes touch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import zset
from ..sources.state import State


#: Buckets of a keyed sink. More make commits of few keys cheaper, and files smaller.
BUCKETS = 64


@dataclass
class Sink:
    """A named view: its stored schema, how changes reach it, how they are folded in.

    With a ``key``, folding must treat each key on its own; rows are dealt by it
    ('*': by the whole row without its count).
    """

    name: str
    schema: str
    prepare: Callable[[DataFrame], DataFrame]
    fold: Callable[[DataFrame, DataFrame], DataFrame]
    key: list[str] = field(default_factory=list)
    buckets: int = BUCKETS

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")


def bag(name: str, schema: str, prepare: Callable[[DataFrame], DataFrame]) -> Sink:
    """Counted multiset; counts at or below zero are forgotten."""
    return Sink(name, f"{schema}, _delta long", prepare, lambda state, new: zset.consolidate(zset.push(state, new.select(state.columns))), ["*"])


def count(name: str, prepare: Callable[[DataFrame], DataFrame] = lambda c: c) -> Sink:
    """Sum of all changes."""

    def fold(state: DataFrame, new: DataFrame) -> DataFrame:
        return state.select("n").union(new.select(F.col("_delta").cast("long"))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))

    return Sink(name, "n long", prepare, fold)


def sums(name: str, key: str, key_type: str, values: dict[str, str], prepare: Callable[[DataFrame], DataFrame] = lambda c: c) -> Sink:
    """Per key the count and sums of value expressions; keys without rows go."""
    schema = f"{key} {key_type}, n long, " + ", ".join(f"{v} double" for v in values)

    def fold(state: DataFrame, new: DataFrame) -> DataFrame:
        part = new.select(key, F.col("_delta").alias("n"), *((F.expr(e) * F.col("_delta")).cast("double").alias(v) for v, e in values.items()))
        return state.unionByName(part).groupBy(key).agg(F.sum("n").alias("n"), *(F.sum(v).alias(v) for v in values)).filter("n > 0")

    return Sink(name, schema, prepare, fold, [key])


def table(name: str, key: list[str], schema: str, prepare: Callable[[DataFrame], DataFrame] = lambda c: c) -> Sink:
    """The last push of each key in a batch decides; a retraction deletes."""

    def fold(state: DataFrame, new: DataFrame) -> DataFrame:
        last = zset.last_push(new, key).select(state.columns)
        return state.join(new.select(*key).distinct(), key, "left_anti").unionByName(last)

    return Sink(name, schema, prepare, fold, list(key))


def retained(name: str, schema: str, record: list[str], horizon: int, clock: Callable[[], int], prepare: Callable[[DataFrame], DataFrame] = lambda c: c) -> Sink:
    """Sliding window by arrival: expire, cancel the oldest copies, then stamp what arrived.

    Net changes of a record are applied once per commit; an empty commit expires
    too, so every commit rewrites the whole window.
    """

    def fold(state: DataFrame, new: DataFrame) -> DataFrame:
        now = clock()
        net = zset.consolidate(new.select(*record, "_delta"), signed=True)
        gone = net.filter("_delta < 0").select(*record, F.explode(F.expr("sequence(1L, -_delta)")).alias("_x")).drop("_x")
        kept = zset.retain(state, gone, record, "at", now, horizon).select(state.columns)
        came = net.filter("_delta > 0").withColumn("_x", F.explode(F.expr("sequence(1L, _delta)"))).select(*record, F.lit(now).cast("long").alias("at"))
        return kept.unionByName(came.select(state.columns))

    return Sink(name, f"{schema}, at long", prepare, fold)


class Pipeline:
    def __init__(self, spark: SparkSession, root: str, sinks: list[Sink]):
        names = [s.name for s in sinks]
        if len(set(names)) < len(names):
            raise ValueError("two sinks have one name")
        self.spark, self.state = spark, State(spark, root)
        whole = lambda s: [c for c in spark.createDataFrame([], s.schema).columns if c != "_delta"]
        self.sinks = {s.name: replace(s, key=whole(s)) if s.key == ["*"] else s for s in sinks}

    def _touched(self, sink: Sink, new: DataFrame, snapshot: dict) -> tuple[DataFrame, list[int] | None]:
        """Changes with keys of the stored types, and the buckets they touch: at most ``sink.buckets`` numbers. None: all."""
        types = self.spark.createDataFrame([], sink.schema).schema
        new = new.withColumns({k: F.col(k).cast(types[k].dataType) for k in sink.key})
        if self.state.buckets(snapshot, sink.name) not in (None, sink.buckets) or isinstance(snapshot["tables"].get(sink.name), str):
            return new, None  # dealt otherwise before
        return new, sorted(r[0] for r in new.select(sink.bucket()).distinct().collect())

    def _step(self, changes: DataFrame, snapshot: dict) -> tuple[dict[str, DataFrame], dict]:
        tables, dealt = {}, {}
        for name, s in self.sinks.items():
            new = s.prepare(changes)
            if not s.key:
                tables[name] = s.fold(self.state.read(name, s.schema, snapshot), new)
                continue
            new, touched = self._touched(s, new, snapshot)
            tables[name] = s.fold(self.state.read(name, s.schema, snapshot, touched), new).withColumn("_bucket", s.bucket())
            dealt[name] = (s.buckets, touched)
        return tables, dealt

    def write(self, changes: DataFrame, batch: int | None = None, rows: Callable[[DataFrame], DataFrame] = lambda c: c) -> int:
        """Apply one batch to every sink, or to none if anything fails. ``rows`` turns it into changes under the lock."""
        self.state.lock()
        held = []
        try:
            held.append(rows(changes).persist())
            tables, dealt = self._step(held[0], self.state.snapshot())
            return self.state.commit(tables, batch, dealt=dealt)
        finally:
            for frame in held:
                frame.unpersist()
            self.state.unlock()

    def near(self, name: str, keys: DataFrame) -> DataFrame:
        """The buckets of a keyed sink in which the keys of a frame lie."""
        sink, snapshot = self.sinks[name], self.state.snapshot()
        return self.state.read(name, sink.schema, snapshot, self._touched(sink, keys, snapshot)[1])

    def preview(self, changes: DataFrame) -> dict[str, DataFrame]:
        """What every sink would hold after ``changes``, without committing."""
        snapshot = self.state.snapshot()
        return {n: s.fold(self.state.read(n, s.schema, snapshot), s.prepare(changes)) for n, s in self.sinks.items()}

    def read(self, *names: str) -> list[DataFrame]:
        """Views of one snapshot."""
        snapshot = self.state.snapshot()
        return [self.state.read(n, self.sinks[n].schema, snapshot) for n in names]

    def stream(self, changes: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        """Keep the sinks up to date with a streaming change feed; replayed batches are no-ops."""
        writer = changes.writeStream.foreachBatch(lambda frame, batch: self.write(frame, batch)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


class KeyedPipeline:
    """A primary-key table in front of a pipeline: upserts and deletes become changes that retract the old row."""

    def __init__(self, spark: SparkSession, root: str, key: list[str], schema: str, sinks: list[Sink]):
        self.key, self.schema = key, schema
        rows = Sink("_rows", schema, lambda c: c, lambda state, new: zset.consolidate(zset.push(zset.changes(state, 1), new.select(*state.columns, "_delta"))).drop("_delta"), key)
        self.pipeline = Pipeline(spark, root, [rows, *sinks])

    def rows(self) -> DataFrame:
        return self.pipeline.read("_rows")[0]

    def write(self, incoming: DataFrame, batch: int | None = None) -> int:
        """``incoming`` has the key, the columns, ``_op`` ('u' or 'd') and ``_seq``."""
        # the old row goes before the new one comes
        return self.pipeline.write(incoming, batch, lambda rows: zset.upsert_changes(self.pipeline.near("_rows", rows), rows, self.key).withColumn("_seq", F.col("_delta")))

    def get(self, condition: str) -> DataFrame:
        return self.rows().filter(condition)
