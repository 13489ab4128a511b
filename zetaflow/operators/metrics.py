"""Retrieval metrics over ranked lists (qid, id, rank from 0) and gold pairs (qid, id)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """``qid, recall, rr, ndcg`` at ``k`` for every query with gold; 0 where nothing was found."""
    sizes = gold.distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("g"))
    hits = ranked.filter(F.col("rank") < k).join(gold.distinct(), ["qid", "id"], "left_semi")
    found = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("h"), F.min("rank").alias("first"), F.sum(1.0 / F.log2(F.col("rank") + 2.0)).alias("dcg"))
    ideal = F.reduce(F.sequence(F.lit(0), F.least("g", F.lit(k)).cast("int") - 1), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 2.0))
    out = sizes.join(found, "qid", "left")
    return out.select("qid", (F.coalesce("h", F.lit(0)) / F.col("g")).alias("recall"), F.coalesce(1.0 / (F.col("first") + 1), F.lit(0.0)).alias("rr"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def macro(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("queries"), *(F.avg(c).alias(c) for c in ("recall", "rr", "ndcg")), F.stddev_pop("rr").alias("sd_rr"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Wins, losses and ties of ``a`` over ``b`` on the reciprocal rank."""
    both = a.select("qid", F.col("rr").alias("x")).join(b.select("qid", F.col("rr").alias("y")), "qid")
    return both.agg(F.count(F.when(F.col("x") > F.col("y"), 1)).alias("wins"), F.count(F.when(F.col("x") < F.col("y"), 1)).alias("losses"), F.count(F.when(F.col("x") == F.col("y"), 1)).alias("ties"))


def spread(total, n: int):
    """The same for a column of totals: an array of page numbers."""
    if n <= 1:
        return F.array(F.lit(1).cast("long"))
    pages = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (1 + F.floor(i * (total - 1) / float(n - 1) + 0.5)).cast("long"))
    return F.when(total >= 1, F.array_distinct(pages)).otherwise(F.array().cast("array<bigint>"))


def spread_pages(n: int, total: int) -> list[int]:
    """``n`` page numbers from 1, evenly spaced, first and last included, without repeats."""
    if n <= 1 or total <= 1:
        return [1] if total >= 1 else []
    return sorted({1 + int(i * (total - 1) / (n - 1) + 0.5) for i in range(n)})


def longest_common_run(a: list[str], b: list[str]) -> int:
    """Length of the longest run of consecutive words that both have."""
    places: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        places.setdefault(w, []).append(j)
    best, before = 0, {}
    for w in a:  # runs that end at this word, by their end in b
        before = {j: before.get(j - 1, 0) + 1 for j in places.get(w, ())}
        best = max(best, max(before.values(), default=0))
    return best


def copied_share(rows: DataFrame, key: list[str], answer: str, source: str) -> DataFrame:
    """key, share: the longest run of words of an answer that its source has too, over the answer's words; case and
    punctuation don't count, and an empty answer has share 0."""
    split = lambda x: re.findall(r"[^\W_]+", (x or "").lower())

    def run(batches):
        for batch in batches:
            out = []
            for a, s in zip(batch.column(answer).to_pylist(), batch.column(source).to_pylist(), strict=True):
                mine = split(a)
                out.append(longest_common_run(mine, split(s)) / len(mine) if mine else 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in key), pa.array(out, pa.float64())], names=[*key, "share"])

    kinds = dict(rows.dtypes)
    return rows.select(*key, answer, source).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in key) + ", share double")


def breakdown(parts: DataFrame, whole: DataFrame) -> DataFrame:
    """(part, bytes) with what the parts don't account for of the whole (one row, bytes) as a part of its own."""
    known = parts.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("known"))
    rest = whole.crossJoin(F.broadcast(known)).select(F.lit("unaccounted").alias("part"), (F.col("bytes") - F.col("known")).cast("long").alias("bytes"))
    return parts.select("part", F.col("bytes").cast("long").alias("bytes")).unionByName(rest)


def span_depths(spans: DataFrame) -> DataFrame:
    """``track, id, depth``: how many spans (track, id, at, us) of the same track enclose each."""
    outer = spans.select(F.col("track").alias("t"), F.col("id").alias("o"), F.col("at").alias("oa"), (F.col("at") + F.col("us")).alias("oe"))
    inside = (F.col("track") == F.col("t")) & (F.col("id") != F.col("o")) & (F.col("oa") <= F.col("at")) & (F.col("oe") >= F.col("at") + F.col("us"))
    return spans.join(outer, inside, "left").groupBy("track", "id").agg(F.count("o").alias("depth"))


def below_floors(scores: dict[str, float], floors: dict[str, float]) -> list[str]:
    """The names of measures under their floor, those that are missing included."""
    return sorted(n for n, least in floors.items() if not scores.get(n, float("-inf")) >= least)
