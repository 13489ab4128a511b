"""Hybrid ranking: fusing lexical and semantic lists, reranking, cutoffs, shaping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESERVED_BOOST = 1.4
MIN_REL = 0.25
SPREAD = 0.35


def relative(lexical: DataFrame) -> DataFrame:
    """``rel``: score over the best score of its query (1 where that isn't positive)."""
    top = F.max("score").over(Window.partitionBy("qid"))
    return lexical.withColumn("rel", F.when(top > 0, F.col("score") / top).otherwise(F.lit(1.0)))


def similarity(semantic: DataFrame) -> DataFrame:
    """``sim``: max(1 - dist, 0) over the best of its query (0 where that isn't positive)."""
    own = F.greatest(1.0 - F.col("dist"), F.lit(0.0))
    top = F.max(own).over(Window.partitionBy("qid"))
    return semantic.withColumn("sim", F.when(top > 0, own / top).otherwise(F.lit(0.0)))


def fuse(lexical: DataFrame, semantic: DataFrame, alpha: float = 0.5, reserved: DataFrame | None = None) -> DataFrame:
    """alpha * rel + (1 - alpha) * sim over the union of two lists; reserved documents are boosted."""
    both = relative(lexical).select("qid", "doc", "rel").join(similarity(semantic).select("qid", F.col("id").alias("doc"), "sim"), ["qid", "doc"], "full_outer")
    fused = alpha * F.coalesce("rel", F.lit(0.0)) + (1 - alpha) * F.coalesce("sim", F.lit(0.0))
    both = both.withColumn("fused", fused)
    if reserved is not None:
        both = both.join(reserved.select("doc", F.lit(RESERVED_BOOST).alias("boost")), "doc", "left").withColumn("fused", F.col("fused") * F.coalesce("boost", F.lit(1.0))).drop("boost")
    return both


def ranked(fused: DataFrame, score: str = "fused") -> DataFrame:
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(score), "doc")) - 1)


def reciprocal_rank(lists: list[DataFrame], k: float = 60.0, weights: list[float] | None = None, depth: int | None = None) -> DataFrame:
    """Sum of weight / (k + rank + 1) over ranked lists (qid, doc, rank from 0)."""
    parts = [x.filter(F.col("rank") < depth) if depth else x for x in lists]
    out = None
    for x, w in zip(parts, weights or [1.0] * len(parts), strict=True):
        x = x.select("qid", "doc", (F.lit(w) / (k + F.col("rank") + 1)).alias("s"))
        out = x if out is None else out.unionByName(x)
    return out.groupBy("qid", "doc").agg(F.sum("s").alias("fused"))


def cutoff(hits: DataFrame, least: float = MIN_REL) -> DataFrame:
    """Keep hits the semantic list has, and lexical ones of at least ``least`` of the best."""
    return hits.filter(F.col("sim").isNotNull() | (F.col("rel") >= least))


def spread_cutoff(hits: DataFrame, share: float = SPREAD) -> DataFrame:
    """Keep similarities in the upper part of the fetched range."""
    w = Window.partitionBy("qid")
    lo, hi = F.min("sim").over(w), F.max("sim").over(w)
    return hits.withColumn("_floor", lo + share * (hi - lo)).filter(F.col("sim") >= F.col("_floor")).drop("_floor")


def confidence(best, coverage, least: float = 6.0, bar: float = 0.99):
    """'none' without a score, 'strong' for a high one that covers the query, else 'weak'."""
    return F.when(best.isNull(), "none").when((best >= least) & (coverage >= bar), "strong").otherwise("weak")


def page(hits: DataFrame, offset: int, size: int) -> DataFrame:
    return hits.filter((F.col("rank") >= offset) & (F.col("rank") < offset + size))


def max_sim(pool: DataFrame, words: DataFrame, pieces: DataFrame, queries: DataFrame, keep: float = 0.7) -> DataFrame:
    """Late interaction over a bounded pool (qid, doc, fused).

    ``words`` (doc, word), ``pieces`` (word, v unit vectors), ``queries`` (qid,
    tok, v unit, w). Each query token takes its best cosine over a document's
    words; the weighted mean is blended with the fused score, both scaled to the
    pool, and put back into the pool's range.
    """
    from ..functions.vector import dot

    pool = pool.select("qid", "doc", "fused")
    seen = words.join(pool.select("doc").distinct(), "doc", "left_semi").distinct().join(pieces, "word").select("doc", F.col("v").alias("wv"))
    best = pool.join(seen, "doc").join(queries, "qid").groupBy("qid", "doc", "tok").agg(F.max(dot(F.col("wv"), F.col("v"))).alias("m"), F.first("w").alias("w"))
    late = best.groupBy("qid", "doc").agg((F.sum(F.col("m") * F.col("w")) / F.sum("w")).alias("late"))
    out = pool.join(late, ["qid", "doc"], "left").withColumn("late", F.coalesce("late", F.lit(-1.0)))
    w = Window.partitionBy("qid")
    scale = lambda c: F.when(F.max(c).over(w) > F.min(c).over(w), (F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w))).otherwise(F.lit(0.0))
    out = out.withColumn("mixed", keep * scale("fused") + (1 - keep) * scale("late"))
    lo, hi = F.min("fused").over(w), F.max("fused").over(w)
    return out.withColumn("reranked", F.when(hi > lo, lo + (hi - lo) * F.col("mixed")).otherwise(F.col("fused")))


def _matrix(vectors) -> np.ndarray:
    """A row for each vector; a shorter one ends in zeros, one that is missing or not finite is zero."""
    rows = [np.zeros(0) if v is None else np.asarray(v, dtype=float) for v in vectors]
    x = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, v in enumerate(rows):
        if np.isfinite(v).all():
            x[i, : len(v)] = v
    return x


def mmr(pool: DataFrame, lam: float = 0.7, depth: int = 100) -> DataFrame:
    """Maximal marginal relevance over the first ``depth`` hits of each query: (qid, doc, fused, v) -> mmr_rank.

    Greedy and sequential within a query, so each query's bounded pool is one
    group. Hits past the pool keep their fused order behind it. A hit without a
    vector (null, empty, zero) is like no other: its similarities are 0.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["fused", "doc"], ascending=[False, True]).reset_index(drop=True)
        head = group
        x = _matrix(head["v"])
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
        top = head["fused"].iloc[0]
        rel = head["fused"].to_numpy() / top if top > 0 else head["fused"].to_numpy() * 0
        order, near = [0], x @ x[0]
        left = list(range(1, len(head)))
        while left:
            pick = max(left, key=lambda i: (lam * rel[i] - (1 - lam) * near[i], -i))
            order.append(pick)
            left.remove(pick)
            near = np.maximum(near, x @ x[pick])
        out = head.iloc[order]
        return pd.DataFrame({"qid": out["qid"], "doc": out["doc"], "mmr_rank": np.arange(len(out), dtype=np.int64)})

    all_ = ranked(pool)
    kinds = dict(pool.dtypes)
    first = all_.filter(F.col("rank") < depth).drop("rank").groupBy("qid").applyInPandas(run, f"qid {kinds['qid']}, doc {kinds['doc']}, mmr_rank long")
    return first.unionByName(all_.filter(F.col("rank") >= depth).select("qid", "doc", F.col("rank").cast("long").alias("mmr_rank")))


def blend(texts: list, images: list, slot_of) -> list:
    """Merge image hits into text hits: image i is due at slot ``4 * i + slot_of(image) % 4``; the rest follows."""
    out, queue = [], list(images)
    taken = 0
    for t in texts:
        while queue and taken * 4 + slot_of(queue[0]) % 4 <= len(out):
            out.append(queue.pop(0))
            taken += 1
        out.append(t)
    return out + queue


def _slot(hit: int) -> int:
    """A spread of whole numbers that is the same in every run."""
    return (int(hit) * 2654435761) >> 7 & 0x7FFFFFFF


def blend_hits(texts: DataFrame, images: DataFrame) -> DataFrame:
    """:func:`blend` for every query: (qid, hit, rank) of both lists -> qid, slot, hit. A query's page is a bounded group."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        hits = blend(group.loc[~group["image"], "hit"].tolist(), group.loc[group["image"], "hit"].tolist(), _slot)
        return pd.DataFrame({"qid": group["qid"].iloc[0], "slot": range(len(hits)), "hit": hits})

    both = texts.select("qid", "hit", "rank", F.lit(False).alias("image")).unionByName(images.select("qid", "hit", "rank", F.lit(True).alias("image")))
    kinds = dict(both.dtypes)
    return both.groupBy("qid").applyInPandas(run, f"qid {kinds['qid']}, slot long, hit {kinds['hit']}")


def group_images(hits: DataFrame, pad: float = 0.015) -> DataFrame:
    """Image hits (qid, doc, page, id, rank, sim, x, y, w, h) per page: the first rank, the best similarity, all boxes in
    rank order and the padded box around them."""
    far = lambda a, n: F.least(F.max(F.col(a) + F.col(n)) + pad, F.lit(1.0))
    near = lambda a: F.greatest(F.min(a) - pad, F.lit(0.0))
    places = F.array_sort(F.collect_list(F.struct("rank", "id", "x", "y", "w", "h")))
    return hits.groupBy("qid", "doc", "page").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("boxes"), F.max("sim").alias("best"), places.alias("places"), near("x").alias("x0"), near("y").alias("y0"), far("x", "w").alias("x1"), far("y", "h").alias("y1"))


def decorate(hits: DataFrame, cards: DataFrame) -> DataFrame:
    """Hits (doc, ...) on reserved documents, ``~card/<id>``, with the title of their card (id, title); null elsewhere."""
    own = F.regexp_extract("doc", "^~card/(.*)$", 1)
    titles = cards.select(F.concat(F.lit("~card/"), "id").alias("_of"), "title")
    return hits.join(titles, F.when(own != "", F.col("doc")) == F.col("_of"), "left").drop("_of")


def dedup_copies(hits: DataFrame, most: int = 2) -> DataFrame:
    """Hits (qid, rank, base, doc, page): copies of one work collapse by page, at most ``most`` hits of such a work;
    otherwise one hit per (doc, page)."""
    copies = hits.groupBy("qid", "base").agg(F.countDistinct("doc").alias("_docs"))
    h = hits.join(copies, ["qid", "base"])
    multi = F.col("_docs") >= 2
    unit = F.when(multi, F.col("base").cast("string")).otherwise(F.col("doc").cast("string"))
    h = h.withColumn("_multi", multi).withColumn("_unit", unit)
    h = h.withColumn("_nth", F.row_number().over(Window.partitionBy("qid", "_unit", "page").orderBy("rank"))).filter("_nth = 1")
    h = h.withColumn("_of", F.row_number().over(Window.partitionBy("qid", "_unit").orderBy("rank"))).filter(~F.col("_multi") | (F.col("_of") <= most))
    return h.drop("_docs", "_multi", "_unit", "_nth", "_of")
