"""Approximate nearest neighbours with a hash-prefix forest.

Each tree keeps a sorted array of long bit strings, one per vector: the signs of
random projections of the centred vector. A query descends every tree to the
entries that share its longest prefix, then all trees ascend together, one bit
at a time, until enough distinct candidates are gathered. Candidates are scored
exactly in double precision.

Rows are dealt into shards of a fixed size. Each shard's forest is built once and
written; a search streams the queries, in batches, through every stored forest
and merges the best of all shards. A task holds one forest and one batch of
queries, so its memory doesn't grow with the input; where there are few shards, a
forest is sent to a bounded number of tasks (``LANES``) that share its queries.
Equal vectors are one entry of a shard with all their identifiers.

Only the centre is fitted on a bounded sample (``CENTRE_ROWS`` rows with the
smallest hashes); every row is indexed.
"""

from __future__ import annotations

import io
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

TREES = 64
BITS = 24
#: Share of a shard's distinct vectors gathered as candidates before a query stops ascending.
CANDIDATES = 0.5
SHARD_ROWS = 16384
#: Tasks that the shards of a small table are spread over.
LANES = 8
#: Queries scored together.
BATCH = 256
CENTRE_ROWS = 4096
SEED = 5


def _planes(dim: int, trees: int, bits: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).standard_normal((dim, trees * bits))


class Forest:
    """Sorted arrays of hash strings over the distinct rows of ``x``; ``ids`` lists those of row i at ``starts[i]``."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, starts: np.ndarray, centre: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED, built: tuple | None = None):
        self.x, self.ids, self.starts, self.centre, self.trees, self.bits, self.seed = x, ids, starts, centre, trees, bits, seed
        self.planes = _planes(x.shape[1], trees, bits, seed)
        if built:
            self.order, self.sorted = built
        else:
            codes = self.codes(x)
            self.order = np.argsort(codes, axis=0, kind="stable").astype(np.int32)
            self.sorted = np.take_along_axis(codes, self.order, axis=0).astype(np.int32)

    @classmethod
    def of(cls, x: np.ndarray, ids: np.ndarray, centre: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> Forest:
        distinct, where = np.unique(x, axis=0, return_inverse=True)
        by = np.lexsort((ids, where.ravel()))
        return cls(distinct, ids[by], np.searchsorted(where.ravel()[by], np.arange(len(distinct) + 1)), centre, trees, bits, seed)

    def dump(self) -> bytes:
        out = io.BytesIO()
        small = self.x.astype(np.float32)  # vectors that came in single precision go so
        np.savez(out, x=small if (small == self.x).all() else self.x, ids=self.ids, starts=self.starts, centre=self.centre, shape=np.array([self.trees, self.bits, self.seed]), order=self.order, sorted=self.sorted)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Forest:
        z = np.load(io.BytesIO(data))
        trees, bits, seed = z["shape"].tolist()
        return cls(z["x"].astype(np.float64), z["ids"], z["starts"], z["centre"], trees, bits, seed, (z["order"], z["sorted"]))

    def codes(self, x: np.ndarray) -> np.ndarray:
        signs = ((x - self.centre) @ self.planes > 0).reshape(len(x), self.trees, self.bits)
        return signs @ (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64))

    def nearest(self, q: np.ndarray, qid: np.ndarray, k: int, share: float) -> tuple[list, list, list]:
        """(query, identifier, score) of the ``k`` best candidates of each query, ties to the smaller identifier."""
        n, out = len(self.x), ([], [], [])
        least = min(n, max(4 * k, int(np.ceil(share * n))))
        seen = self.candidates(q, least)
        scores = np.where(seen, q @ self.x.T, -np.inf)
        for i, mine in enumerate(qid.tolist()):
            if n > k + 1:  # every vector that ties with the (k+1)-th best stays
                floor = np.partition(scores[i], n - k - 1)[n - k - 1]
                near = np.flatnonzero((scores[i] >= floor) & seen[i])
            else:
                near = np.flatnonzero(seen[i])
            # of equal vectors only the k + 1 smallest identifiers can be among the nearest
            got = [(-scores[i, j], v) for j in near for v in self.ids[self.starts[j] : min(self.starts[j + 1], self.starts[j] + k + 1)].tolist() if v != mine]
            for s, v in sorted(got)[:k]:
                out[0].append(mine)
                out[1].append(v)
                out[2].append(float(-s))
        return out

    def candidates(self, q: np.ndarray, least: int) -> np.ndarray:
        """A mask (queries, rows): entries met while all trees ascend from the longest prefixes until ``least`` are seen."""
        n = len(self.order)
        codes = self.codes(q)
        seen = np.zeros((len(q), n), dtype=bool)
        lows = np.empty((self.trees, self.bits + 1, len(q)), dtype=np.int32)
        highs = np.empty_like(lows)
        for t in range(self.trees):
            for drop in range(self.bits + 1):
                prefix = codes[:, t] >> drop << drop
                lows[t, drop] = np.searchsorted(self.sorted[:, t], prefix, side="left")
                highs[t, drop] = np.searchsorted(self.sorted[:, t], prefix + (1 << drop), side="left")
        for i in range(len(q)):
            met, row = 0, seen[i]
            for drop in range(self.bits + 1):
                # the entries met are at most the sum over trees; count them only where that could be enough
                if drop < self.bits and int((highs[:, drop, i] - lows[:, drop, i]).sum()) < least:
                    continue
                for t in range(self.trees):
                    row[self.order[lows[t, drop, i] : highs[t, drop, i], t]] = True
                met = int(np.count_nonzero(row))
                if met >= least:
                    break
        return seen


def _build(centre: list[float], dim: int, trees: int, bits: int):
    def run(group: pa.Table) -> pa.Table:
        x = group.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim).astype(np.float64)
        forest = Forest.of(x, group.column("id").to_numpy(), np.asarray(centre), trees, bits)
        return pa.table({"shard": group.column("shard")[:1], "dim": pa.array([dim], pa.int32()), "forest": pa.array([forest.dump()], pa.binary())})

    return run


def _ask(k: int, share: float):
    """Rows come shard by shard, its forest first; queries are answered in batches."""

    def run(batches):
        forest, of = None, None
        for batch in batches:
            lists, blobs, shards = batch.column("v"), batch.column("forest"), batch.column("shard").to_numpy()
            stored = np.flatnonzero(blobs.is_valid().to_numpy(zero_copy_only=False)).tolist()
            for lo, hi in pairwise([*sorted({0, *stored}), batch.num_rows]):
                if lo in stored:
                    forest, of = Forest.load(blobs[lo].as_py()), shards[lo]
                    lo += 1
                for at in range(lo, hi, BATCH):
                    rows = slice(at, min(hi, at + BATCH))
                    if of != shards[at]:
                        break  # no vector was dealt to that shard
                    q = lists[rows].flatten().to_numpy().reshape(rows.stop - rows.start, -1).astype(np.float64)
                    found = forest.nearest(q, batch.column("id")[rows].to_numpy(), k, share)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """Rows that take part: (id, v) with a finite, non-zero vector of ``dim`` components."""
    v = F.col(vec_col).cast("array<double>")
    ok = f"size(v) = {dim} and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"
    return vectors.select(F.col(id_col).alias("id"), v.alias("v")).filter("id is not null and v is not null").filter(ok)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, bits: int = BITS) -> DataFrame | None:
    """The stored index: ``shard, dim, forest``, one row per shard of about ``SHARD_ROWS`` vectors; None without any vector.

    It is a table like others: keep it, and search it as often as needed.
    """
    dims = vectors.filter(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None or not dims["d"]:
        return None
    rows = usable(vectors, id_col, vec_col, dims["d"]).dropDuplicates(["id", "v"])
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(CENTRE_ROWS).toPandas()
    if not len(sample):
        return None
    centre = np.mean(np.array(sample["v"].tolist()), axis=0).tolist()
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    v = F.col("v").cast("array<float>") if dict(vectors.dtypes)[vec_col] == "array<float>" else F.col("v")
    dealt = rows.select("id", v.alias("v"), F.expr(f"cast(pmod(xxhash64(1, id), {shards}) as int)").alias("shard"))
    return materialize(dealt.groupBy("shard").applyInArrow(_build(centre, dims["d"], trees, bits), "shard int, dim int, forest binary"))


def search_index(index: DataFrame, queries: DataFrame, k: int = 20, share: float = CANDIDATES) -> DataFrame:
    """The ``k`` best found for each query (id, v) over all shards: ``query_id, rank, vec_id, score``. Queries travel to the forests."""
    size = index.agg((F.max("shard") + 1).alias("shards"), F.max("dim").alias("dim")).first()
    lanes = max(1, LANES // size["shards"])
    asks = usable(queries, "id", "v", size["dim"]).withColumn("lane", F.expr(f"cast(pmod(xxhash64(2, id), {lanes}) as int)"))
    asks = asks.select(F.explode(F.sequence(F.lit(0), F.lit(size["shards"] - 1))).alias("shard"), "lane", "id", "v", F.lit(None).cast("binary").alias("forest"))
    none = F.lit(None).cast("array<double>").alias("v")
    stored = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(None).cast("long").alias("id"), none, "forest")
    dealt = stored.unionByName(asks).repartition(size["shards"] * lanes, "shard", "lane").sortWithinPartitions("shard", "lane", F.col("forest").isNull())
    found = dealt.mapInArrow(_ask(k, share), "query_id long, vec_id long, score double")
    found = found.dropDuplicates(["query_id", "vec_id", "score"])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, is_query: str = "id % 20 = 0", k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, bits: int = BITS, share: float = CANDIDATES) -> DataFrame:
    """The ``k`` nearest rows found for each query by inner product: ``query_id, rank, vec_id, score``.

    ``is_query`` is a predicate on ``id``. Nearest first, ties to the smaller
    identifier; a query is no candidate of its own.

    Defined cases: rows whose vector is null, zero, of another length than the
    most common one, or holds a null or non-finite component take no part, nor do
    rows without an identifier; repeated rows (identifier and vector) count once;
    an empty table gives an empty result; fewer than ``k`` candidates are all
    returned; other columns are ignored. Identifiers are integers.
    """
    index = build_index(vectors, id_col, vec_col, trees, bits)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search_index(index, vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).filter(is_query), k, share)


def op9_nearest(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"))


def brute_force(x: np.ndarray, ids: np.ndarray, k: int, every: int) -> dict[int, list[int]]:
    """The exact answer on a small table, for measuring recall."""
    x = x.astype(np.float64)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out
