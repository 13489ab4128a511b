"""Exact nearest neighbours and what is built on them.

Vectors are dealt into shards of a fixed size. Queries travel to every shard and
stream, in batches, past its vectors, which the task holds as one matrix; each
shard gives its ``k`` best, and the best of all shards are merged. Neither pairs
nor vectors are shuffled by query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector

#: Vectors that a task holds, queries scored at once, tasks that a small table is spread over.
SHARD_ROWS, BATCH, LANES = 16_384, 256, 16
#: Groups of a shard's vectors whose best ones say which vectors may be near.
GROUPS = 1024


def pairs(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Every (query, vector) pair: (qid, q, id, v). For reports on a stated, small set of queries."""
    return vectors.join(F.broadcast(queries), F.lit(True))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=x.copy(), where=n > 0)


def _distances(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of one query to all rows, or of a query for each row; all are summed in the same order whatever the other rows are."""
    if metric == "neg_dot":
        return -(x * q).sum(axis=1)
    if metric == "unit_cosine":
        return 1.0 - (x * q).sum(axis=1)  # both were normalised
    if metric == "cosine":
        n = np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum())
        return np.where(n > 0, 1.0 - (x * q).sum(axis=1) / np.where(n > 0, n, 1.0), 0.0)
    if metric == "hamming":
        return (x != q).sum(axis=1).astype(float)
    d = np.abs(x - q)
    return {"l1": lambda: d.sum(axis=1), "chebyshev": lambda: d.max(axis=1, initial=0.0), "l2": lambda: (d * d).sum(axis=1), "euclidean": lambda: np.sqrt((d * d).sum(axis=1))}[metric]()


def _stream(k: int, metric: str, skip_self: bool):
    """Rows come shard by shard, vectors first, then the queries."""

    def run(batches):
        held: list = []
        shard = of = None
        for batch in batches:
            shards, asks = batch.column("shard").to_numpy(), batch.column("qid").is_valid().to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.r_[True, (shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1]), True]) if batch.num_rows else []
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                part = batch.slice(lo, hi - lo)
                if not asks[lo]:
                    if of != shards[lo] or shard is not None:
                        held, shard, of = [], None, shards[lo]
                    held.append((part.column("id"), part.column("v").flatten().to_numpy()))
                    continue
                if of != shards[lo]:
                    continue  # a shard without vectors
                if shard is None:
                    shard, held = _Shard(held, metric), []
                yield from _best(part, shard, k, metric, skip_self)

    return run


class _Shard:
    """The vectors of one shard; ``place`` is where a row stands in the order of identifiers."""

    def __init__(self, held: list, metric: str):
        self.ids = pa.concat_arrays([i for i, _ in held])
        self.names = np.array([*self.ids.to_pylist(), None], dtype=object)[:-1]
        x = np.concatenate([v for _, v in held]).reshape(len(self.ids), -1).astype(float)
        self.x = _unit(x) if metric == "unit_cosine" else x
        self.place = np.empty(len(self.ids), np.int64)
        self.place[pc.array_sort_indices(self.ids).to_numpy()] = np.arange(len(self.ids))
        self.single = self.x.astype(np.float32) if metric == "unit_cosine" and np.isfinite(self.x).all() else None
        self.norm = np.sqrt((self.x * self.x).sum(axis=1).max(initial=0.0))


def _screened(shard: _Shard, q: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all that may be among the ``room`` nearest unit vectors, and few others.

    Inner products in single precision find them. The rows are dealt into groups;
    ``room`` groups reach the product ``least`` or more, so as many rows do, and what
    lies below it by more than twice the largest error of a product isn't nearer than those.
    """
    dim = q.shape[1]
    near = q.astype(np.float32) @ shard.single[:, :dim].T
    groups = max(room, min(GROUPS, near.shape[1]))
    each = near.shape[1] // groups
    best = near[:, : groups * each].reshape(len(q), each, groups).max(axis=1)
    least = np.partition(best, groups - room, axis=1)[:, groups - room].astype(float)
    scale = shard.norm * np.sqrt((q * q).sum(axis=1))
    least -= 4 * (dim + 8) * np.finfo(np.float32).eps * scale + 1e-12
    return np.nonzero(near >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None])


def _best(part: pa.RecordBatch, shard: _Shard, k: int, metric: str, skip_self: bool):
    q = part.column("v").flatten().to_numpy().reshape(part.num_rows, -1).astype(float)
    q = _unit(q) if metric == "unit_cosine" else q
    dim, room = min(q.shape[1], shard.x.shape[1]), k + skip_self
    q, x = q[:, :dim], shard.x[:, :dim]
    screen = shard.single is not None and len(x) > room and np.isfinite(q).all()
    for at in range(0, part.num_rows, BATCH):
        rows, qids = q[at : at + BATCH], part.column("qid")[at : at + BATCH]
        if screen:
            of, to = _screened(shard, rows, room)
            cut = range(0, len(to), SHARD_ROWS)  # where vectors are copies, all of a shard may be near
            d = np.concatenate([_distances(metric, x[to[i : i + SHARD_ROWS]], rows[of[i : i + SHARD_ROWS]]) for i in cut])
        else:
            every = [_distances(metric, x, row) for row in rows]
            near = [np.flatnonzero(d <= np.partition(d, room - 1)[room - 1]) if len(d) > room else np.arange(len(d)) for d in every]
            of, to = np.repeat(np.arange(len(rows)), [len(n) for n in near]), np.concatenate(near)
            d = np.concatenate([d[n] for d, n in zip(every, near, strict=True)])
        if skip_self:
            asked = np.array([*qids.to_pylist(), None], dtype=object)[:-1]
            other = np.array(shard.names[to] != asked[of], dtype=bool)
            of, to, d = of[other], to[other], d[other]
        order = np.lexsort((shard.place[to], d, of))
        order = order[np.arange(len(order)) - np.searchsorted(of[order], of[order]) < k]
        yield pa.RecordBatch.from_arrays([qids.take(pa.array(of[order])), shard.ids.take(pa.array(to[order])), pa.array(d[order], pa.float64())], names=["qid", "id", "dist"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "unit_cosine", allowed: DataFrame | None = None, skip_self: bool = False) -> DataFrame:
    """``qid, id, dist, rank`` (from 0) of the ``k`` nearest; ties to the smaller id. The filter comes before the cut.

    Vectors of one table have one length; a longer query, or longer vectors, are cut to the shorter.
    """
    if metric not in vector.METRICS:
        raise ValueError(f"no metric {metric}")
    if allowed is not None:
        vectors = vectors.join(allowed, "id", "left_semi")
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    rows = vectors.select(F.expr(f"cast(pmod(xxhash64(id), {shards}) as int)").alias("shard"), "id", "v")
    asks = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "qid", "q")
    return merge(rows, asks, k, metric, skip_self, max(1, LANES // shards), shards)


def merge(rows: DataFrame, asks: DataFrame, k: int, metric: str, skip_self: bool, lanes: int, shards: int | None = None) -> DataFrame:
    """The ``k`` nearest of each query (shard, qid, q) among the vectors (shard, id, v) of the shards it is sent to.

    A shard's vectors go to ``lanes`` tasks that share its queries; a shard fits a task.
    """
    kinds = dict(rows.dtypes) | dict(asks.dtypes)
    lane = F.expr(f"cast(pmod(xxhash64(qid), {lanes}) as int)").alias("lane")
    held = rows.select("shard", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(None).cast(kinds["qid"]).alias("qid"), "id", F.col("v").cast("array<double>").alias("v"))
    sent = asks.select("shard", lane, "qid", F.lit(None).cast(kinds["id"]).alias("id"), F.col("q").cast("array<double>").alias("v"))
    both = held.unionByName(sent)
    dealt = both.repartition(shards * lanes, "shard", "lane") if shards else both.repartition("shard", "lane")
    found = dealt.sortWithinPartitions("shard", "lane", F.col("qid").isNotNull()).mapInArrow(_stream(k, metric, skip_self), f"qid {kinds['qid']}, id {kinds['id']}, dist double")
    w = Window.partitionBy("qid").orderBy("dist", "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def upsert_vectors(current: DataFrame, feed: DataFrame) -> DataFrame:
    """Keyed vectors after changes (id, v, _delta, _seq): the last insertion of a key wins; a key whose last push is a retraction goes."""
    from .zset import last_push

    last = feed.groupBy("id").agg(F.max("_seq").alias("_at"))
    new = last_push(feed, ["id"]).select("id", "v")
    return current.join(last.select("id"), "id", "left_anti").unionByName(new)


def mutual_edges(neighbours: DataFrame) -> DataFrame:
    """Pairs that name each other, once each: (a, b, sim) with a < b and the similarity a sees."""
    n = neighbours.select(F.col("qid").alias("a"), F.col("id").alias("b"), (1.0 - F.col("dist")).alias("sim"))
    back = n.select(F.col("a").alias("b"), F.col("b").alias("a"))
    return n.filter("a < b").join(back, ["a", "b"], "left_semi")


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Hits over returned truth, over all queries."""
    hit = truth.join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return hit.agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
