"""Signed multisets: rows with a ``_delta`` count, and the views kept over them.

A change feed is any DataFrame with ``_delta`` (copies inserted, or retracted if
negative) and, where the order of pushes matters, ``_seq``. Every view is a
function of the consolidated feed, so applying changes step by step and
recomputing agree. All aggregations are map-side combined; global top-k never
sorts more than ``k`` rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELTA, SEQ = "_delta", "_seq"


def changes(rows: DataFrame, n: int | Column = 1) -> DataFrame:
    """Rows as insertions (``n`` copies) or retractions (negative ``n``)."""
    return rows.withColumn(DELTA, n if isinstance(n, Column) else F.lit(n).cast("long"))


def push(*feeds: DataFrame) -> DataFrame:
    """Several feeds as one; columns go by name."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f)
    return out


def consolidate(feed: DataFrame, cols: list[str] | None = None, strict: bool = False, signed: bool = False) -> DataFrame:
    """Add up the copies of equal rows. Rows at or below zero go; ``signed`` keeps negative ones, ``strict`` fails on them."""
    cols = cols or [c for c in feed.columns if c not in (DELTA, SEQ)]
    out = feed.groupBy(*cols).agg(F.sum(DELTA).alias(DELTA))
    if strict:
        out = out.withColumn(DELTA, F.when(F.col(DELTA) < 0, F.raise_error(F.lit("negative multiplicity"))).otherwise(F.col(DELTA)))
    return out.filter(F.col(DELTA) != 0) if signed else out.filter(F.col(DELTA) > 0)


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """The changes that turn one consolidated multiset into another: one aggregation, no join."""
    return consolidate(push(old.withColumn(DELTA, -F.col(DELTA)), new.select(old.columns)), signed=True)


def distinct(feed: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Each value with a positive count, once."""
    return consolidate(feed, cols).withColumn(DELTA, F.lit(1).cast("long"))


def aggregate(feed: DataFrame, key: list[str], **sums: Column) -> DataFrame:
    """Per key with a positive count: the count and invertible sums, each value times its copies."""
    aggs = [F.sum(v * F.col(DELTA)).alias(k) for k, v in sums.items()]
    return feed.groupBy(*key).agg(F.sum(DELTA).alias("n"), *aggs).filter("n > 0")


def aggregate_changes(before: DataFrame, delta: DataFrame, key: list[str], suppress_equal: bool = False, **sums: Column) -> DataFrame:
    """What an aggregate emits for a commit: old rows retracted and new rows inserted, for the keys the commit touches."""
    touched = delta.select(*key).distinct()
    old = aggregate(before.join(touched, key, "left_semi"), key, **sums)
    new = aggregate(push(before, delta).join(touched, key, "left_semi"), key, **sums)
    both = changes(old, -1).unionByName(changes(new, 1))
    return consolidate(both, signed=True) if suppress_equal else both


def top_k(feed: DataFrame, k: int, order: list[Column], cols: list[str] | None = None) -> DataFrame:
    """The ``k`` first copies in ``order``; a value that straddles the boundary has the copies inside."""
    rows = consolidate(feed, cols).orderBy(*order).limit(k)  # every row has a copy, so k rows are enough
    before = F.sum(DELTA).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    inside = F.least(F.col(DELTA), F.greatest(F.lit(k) - F.coalesce(before, F.lit(0)), F.lit(0)))
    return rows.withColumn(DELTA, inside).filter(F.col(DELTA) > 0)


def keyed_top(feed: DataFrame, key: list[str], k: int, order: list[Column]) -> DataFrame:
    """:func:`top_k` within each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    rows = consolidate(feed).withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")
    before = F.sum(DELTA).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(DELTA, F.least(F.col(DELTA), F.lit(k) - F.coalesce(before, F.lit(0)))).filter(F.col(DELTA) > 0)


def retain(arrivals: DataFrame, retractions: DataFrame, record: list[str], at: str, now: int | Column, horizon: int) -> DataFrame:
    """Sliding window at a commit: entries older than the horizon expire first (one exactly at it stays),
    then retractions cancel live copies of their record, oldest first; the rest of them is absorbed."""
    now = now if isinstance(now, Column) else F.lit(now)
    live = arrivals.filter(F.col(at) >= now - horizon)
    gone = retractions.groupBy(*record).agg(F.count(F.lit(1)).alias("_gone"))
    nth = F.row_number().over(Window.partitionBy(*record).orderBy(at))
    return live.withColumn("_nth", nth).join(gone, record, "left").filter(F.col("_nth") > F.coalesce("_gone", F.lit(0))).drop("_nth", "_gone")


# Terminal views.


def count(feed: DataFrame) -> DataFrame:
    """Sum of all copies; may be negative, 0 if empty."""
    return feed.agg(F.coalesce(F.sum(DELTA), F.lit(0)).alias("n"))


def last_push(feed: DataFrame, key: list[str], order: str = SEQ) -> DataFrame:
    """The last push of each key, if it was an insertion."""
    rest = [c for c in feed.columns if c not in key]
    last = feed.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return last.select(*key, *(F.col(f"_row.{c}").alias(c) for c in rest)).filter(F.col(DELTA) > 0)


def inverted_index(feed: DataFrame, value: str, key: str) -> DataFrame:
    """value -> sorted keys; the last push of a pair decides whether it is there."""
    return last_push(feed.select(value, key, DELTA, SEQ), [value, key]).groupBy(value).agg(F.sort_array(F.collect_list(key)).alias("keys"))


def multimap(feed: DataFrame, key: str, value: str) -> DataFrame:
    """key -> sorted values; the last push of a pair decides whether it is there."""
    return last_push(feed.select(value, key, DELTA, SEQ), [value, key]).groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("values"))


def stats(feed: DataFrame, value: Column, key: list[str] | None = None) -> DataFrame:
    """count, sum, mean and population variance and deviation of a value; null where the count isn't positive."""
    x, d = value.cast("double"), F.col(DELTA)
    out = feed.groupBy(*(key or [])).agg(F.sum(d).alias("n"), F.sum(x * d).alias("total"), F.sum(x * x * d).alias("_sq"))
    mean = F.when(F.col("n") > 0, F.col("total") / F.col("n"))
    var = F.when(F.col("n") > 0, F.greatest(F.col("_sq") / F.col("n") - mean * mean, F.lit(0.0)))
    return out.withColumn("mean", mean).withColumn("variance", var).withColumn("stddev", F.sqrt(var)).drop("_sq")


def histogram(feed: DataFrame, bucket: Column, key: list[str] | None = None) -> DataFrame:
    return feed.groupBy(*(key or []), bucket.alias("bucket")).agg(F.sum(DELTA).alias("n")).filter("n > 0")


def quantiles(hist: DataFrame, qs: list[float], key: list[str] | None = None) -> DataFrame:
    """First bucket whose cumulative count reaches ``max(1, ceil(q * total))``, for each q clamped to [0, 1]."""
    key = key or []
    w = Window.partitionBy(*key).orderBy("bucket")
    cum = hist.withColumn("_cum", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_total", F.sum("n").over(Window.partitionBy(*key)))
    asked = F.explode(F.array(*(F.lit(min(1.0, max(0.0, q))) for q in qs))).alias("q")
    target = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("_total")))
    return cum.select("*", asked).filter(F.col("_cum") >= target).groupBy(*key, "q").agg(F.min("bucket").alias("bucket"))


def ranked_range(feed: DataFrame, low: Column | None = None, high: Column | None = None, score: str = "score") -> DataFrame:
    """Consolidated rows with a score between two bounds, each a condition on the score or none."""
    out = consolidate(feed)
    for bound in (low, high):
        out = out.filter(bound) if bound is not None else out
    return out


def keyed_extremes(feed: DataFrame, key: list[str], score: str, value: str) -> DataFrame:
    """Smallest and largest (score, value) of each key that has rows."""
    pair = F.struct(F.col(score).alias("s"), F.col(value).alias("v"))
    out = consolidate(feed).groupBy(*key).agg(F.min(pair).alias("lo"), F.max(pair).alias("hi"))
    return out.select(*key, F.col("lo.s").alias("min_score"), F.col("lo.v").alias("min_value"), F.col("hi.s").alias("max_score"), F.col("hi.v").alias("max_value"))


# Keyed sources.


def upsert_changes(current: DataFrame, incoming: DataFrame, key: list[str], order: str = SEQ) -> DataFrame:
    """Changes for a batch of upserts (``_op`` 'u') and deletes ('d'): the last write of a key wins; equal rows cause none."""
    cols = [c for c in current.columns if c not in key]
    last = incoming.groupBy(*key).agg(F.max_by(F.struct("_op", *cols), order).alias("_new"))
    both = current.select(*key, F.struct(*cols).alias("_old")).join(last, key, "full_outer")
    new = F.when(F.col("_new._op") == "u", F.struct(*(F.col(f"_new.{c}").alias(c) for c in cols)))
    both = both.withColumn("_put", new).filter("_new is not null").filter(~F.col("_old").eqNullSafe(F.col("_put")))
    sides = F.array(F.struct(F.col("_old").alias("row"), F.lit(-1).cast("long").alias("d")), F.struct(F.col("_put").alias("row"), F.lit(1).cast("long").alias("d")))
    out = both.select(*key, F.explode(sides).alias("_s")).filter("_s.row is not null")
    return out.select(*key, *(F.col(f"_s.row.{c}").alias(c) for c in cols), F.col("_s.d").alias(DELTA))


def upsert(current: DataFrame, incoming: DataFrame, key: list[str], order: str = SEQ) -> DataFrame:
    """The keyed table after a batch."""
    return consolidate(push(changes(current, 1), upsert_changes(current, incoming, key, order))).drop(DELTA)
