"""Exact deduplication by a content sort, in DataFrame operations only.

Rows are range-partitioned by Spark's sampled splitters on a bounded content key
(the first bytes and the SHA-256 of the normalised text), sorted externally, and
each row is compared in full with its neighbour. The splitters never hold whole
texts, so what the sampling job sends to the driver is bounded per partition.

Texts with very many copies would land in one task. Their digests are counted
first (map-side combined); a digest with more than ``T = max(piece_rows,
rows / HOT_KEYS)`` rows is split into pieces by a hash of the identifier, each
piece is deduplicated like any other group, and the few piece heads are compared
in full once more. There are at most ``HOT_KEYS`` such digests and twice as many
heads, whatever the input, which is the bound of the two broadcasts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table, text_or_empty

#: At most so many digests are treated as hot; bounds the broadcast of (digest, pieces).
HOT_KEYS = 20_000
#: Bytes of content in the sort key.
PREFIX_BYTES = 16


def exact_dedup(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    keep: str = "min",
    normalise: Callable[[Column], Column] | None = None,
    piece_rows: int = 500,
    carry: bool = False,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after ``normalise`` (default: unchanged).
    ``keep`` is ``min`` or ``max``: which identifier of a group survives.

    Defined cases: a null text counts as empty; a null identifier never wins
    against another one; of rows that share the surviving identifier exactly one
    is kept; an empty table gives an empty result; other columns of ``docs`` are
    ignored, whatever their names (``carry`` returns them as a struct ``row``).
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be 'min' or 'max'")
    norm = normalise or (lambda c: c)
    text = norm(text_or_empty(text_col))
    ids = F.col(id_col)
    base = docs.select(ids.alias("id"), text.alias("t"), F.sha2(text, 256).alias("sha"), *([F.struct(*docs.columns).alias("row")] if carry else []))

    digests = docs.select(F.sha2(text, 256).alias("sha")).groupBy("sha").agg(F.count(F.lit(1)).alias("c"))
    limit = max(piece_rows, docs.count() // HOT_KEYS)
    hot = digests.filter(F.col("c") > limit).select("sha", F.ceil(F.col("c") / limit).cast("int").alias("pieces")).collect()
    if hot:
        frame = docs.sparkSession.createDataFrame(hot, "sha string, pieces int")
        base = base.join(F.broadcast(frame), "sha", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    else:
        base = base.withColumn("pieces", F.lit(1))
    base = base.withColumn("piece", F.when(F.col("pieces") > 1, F.expr("pmod(xxhash64(id), pieces)")).otherwise(F.lit(0)).cast("int"))
    base = base.withColumn("head_bytes", F.substring(F.col("t").cast("binary"), 1, PREFIX_BYTES))

    runs = _runs(base, keep, ["row"] if carry else [])
    if not hot:
        out = runs.withColumn("keep_id", F.col("best")).withColumn("size", F.col("n"))
    else:
        heads = materialize(_runs(base.drop("row").filter("pieces > 1"), keep, []).filter("head").select("id", "sha", "piece", "run", "n"))
        merged = _merge_heads(base, heads, keep)
        out = runs.join(F.broadcast(merged), ["sha", "piece", "run"], "left")
        out = out.withColumn("keep_id", F.when(F.col("all_n").isNull(), F.col("best")).otherwise(F.col("all_best"))).withColumn("size", F.coalesce("all_n", "n"))
    kept = F.col("head") & F.col("id").eqNullSafe(F.col("keep_id"))
    return out.select(F.col("id").alias(id_col), "keep_id", F.col("size").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"), *(["row"] if carry else []))


def _runs(base: DataFrame, keep: str, extra: list[str]) -> DataFrame:
    """Sort by content, compare neighbours, and give each row its run's size and best identifier."""
    key = ["head_bytes", "sha", "piece"]
    near = Window.partitionBy(*key).orderBy("t", "id")
    same = F.lag("t").over(near).eqNullSafe(F.col("t"))
    order = F.col("id").asc_nulls_last() if keep == "min" else F.col("id").desc_nulls_last()
    run = Window.partitionBy(*key, "run")
    best = F.min("id") if keep == "min" else F.max("id")
    sorted_rows = base.repartitionByRange(*key)
    marked = sorted_rows.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("new").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.select("id", *key, "run", *extra)
    return marked.withColumn("n", F.count(F.lit(1)).over(run)).withColumn("best", best.over(run)).withColumn("head", F.row_number().over(run.orderBy(order)) == 1)


def _merge_heads(base: DataFrame, heads: DataFrame, keep: str) -> DataFrame:
    """(sha, piece, run) -> size and best identifier of the whole group, from full comparisons of the pieces' heads."""
    texts = base.select("id", "sha", "piece", "t").join(F.broadcast(heads.withColumnRenamed("id", "hid")), ["sha", "piece"]).filter(F.col("id").eqNullSafe(F.col("hid")))
    texts = texts.groupBy("sha", "piece", "run").agg(F.min("t").alias("t"), F.first("id").alias("id"), F.first("n").alias("n"))
    near = Window.partitionBy("sha").orderBy("t", "piece", "run")
    marked = texts.withColumn("new", F.when(F.lag("t").over(near).eqNullSafe(F.col("t")), 0).otherwise(1)).withColumn("grp", F.sum("new").over(near.rowsBetween(Window.unboundedPreceding, 0))).drop("t")
    whole = Window.partitionBy("sha", "grp")
    best = F.min("id") if keep == "min" else F.max("id")
    return marked.select("sha", "piece", "run", F.sum("n").over(whole).alias("all_n"), best.over(whole).alias("all_best"))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
