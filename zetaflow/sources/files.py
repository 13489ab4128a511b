"""File sources and sinks: folder scans, page words, marked editions, vector files, JSON sidecars."""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File kinds a folder scan accepts; how deep it goes.
EXTENSIONS = ("pdf", "epub", "md", "txt", "png", "jpg", "jpeg", "tif", "tiff", "webp")
DEPTH = 16


def folder(spark: SparkSession, root: str, extensions=EXTENSIONS, depth: int = DEPTH) -> DataFrame | None:
    """``path, relpath, size, mtime, ext`` of the files under a root, by relpath; None if the root can't be read.

    Any file system that Spark reads serves. Names and folders that begin with a
    dot are skipped; contents are not read.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        if not fs.exists(path):
            return None
    except Exception:
        return None
    full = fs.makeQualified(path).toString().rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).drop("content")
    rel = F.substr(F.col("path"), F.lit(len(full) + 2))
    out = rows.select("path", rel.alias("relpath"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"))
    out = out.withColumn("ext", F.lower(F.regexp_extract("relpath", r"\.([^./]+)$", 1)))
    return out.filter(F.col("ext").isin(*extensions) & ~F.regexp_like("relpath", F.lit(r"(^|/)\.")) & (F.size(F.split("relpath", "/")) <= depth)).orderBy("relpath")


def content_hash(content: str = "content"):
    return F.sha2(F.col(content), 256)


PAGE_SCHEMA = "doc string, page int, words array<struct<t: string, x: float, y: float, w: float, h: float>>"


def page_words(spark: SparkSession, raw: str, clean: str | None = None) -> DataFrame:
    """Words per page from JSON, a cleaned copy in place of the raw one where there is one."""
    rows = spark.read.schema(PAGE_SCHEMA).json(raw)
    if clean is None:
        return rows
    return overlay(rows, spark.read.schema(PAGE_SCHEMA).json(clean), ["doc", "page"], "words")


def overlay(rows: DataFrame, over: DataFrame, key: list[str], value: str) -> DataFrame:
    """``rows`` with the value of a sparse copy where that has the key."""
    over = over.select(*key, F.col(value).alias("_over"))
    return rows.join(over, key, "left").select(*key, F.coalesce("_over", value).alias(value))


def marked_pages(docs: DataFrame, text_col: str) -> DataFrame:
    """Explode texts at ``<!-- page N -->`` markers: the other columns, page, text. The preamble belongs to no page."""
    rest = [c for c in docs.columns if c != text_col]
    parts = F.expr(f"slice(split(`{text_col}`, '<!-- page (?=[0-9]+ -->)'), 2, 2147483647)")
    out = docs.select(*rest, F.explode(parts).alias("_part"))
    return out.select(*rest, F.regexp_extract("_part", "^([0-9]+) -->", 1).cast("long").alias("page"), F.regexp_replace("_part", "^[0-9]+ -->", "").alias("text"))


def pairs(frame: DataFrame, *keep: str) -> DataFrame:
    """Question and answer columns under any of their usual names, behind the columns to keep."""
    have = set(frame.columns)
    pick = lambda names: F.coalesce(*(F.col(n) for n in names if n in have))
    return frame.select(*keep, pick(["question", "query", "sentence1", "anchor"]).alias("question"), pick(["answer", "passage", "sentence2", "positive"]).alias("answer"))


def _vectors(code: str):
    kind, out = np.dtype(code), (pa.float32() if code == "<f4" else pa.int32())

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                at, rows = 0, []
                while at + 4 <= len(data):
                    (dim,) = struct.unpack_from("<i", data, at)
                    rows.append(np.frombuffer(data, kind, dim, at + 4))
                    at += 4 + 4 * dim
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.list_(out))], names=["path", "row", "v"])

    return run


def fvecs(spark: SparkSession, path: str) -> DataFrame:
    """``path, row, v`` of little-endian float vector files."""
    rows = spark.read.format("binaryFile").load(path).select("path", "content")
    return rows.mapInArrow(_vectors("<f4"), "path string, row long, v array<float>")


def ivecs(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("binaryFile").load(path).select("path", "content")
    return rows.mapInArrow(_vectors("<i4"), "path string, row long, v array<int>")


def write_sidecar(frame: DataFrame, path: str) -> None:
    """JSON, complete or as it was: written beside, then renamed; the old one goes last."""
    spark = frame.sparkSession
    jvm = spark.sparkContext._jvm
    target, temp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = jvm.org.apache.hadoop.fs.Path(path + ".old")
    frame.write.mode("overwrite").json(path + ".tmp")
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(temp, target):
        fs.rename(old, target)
        raise OSError(f"cannot publish {path}")
    fs.delete(old, True)


def read_sidecar(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The sidecar, or None if it isn't there or isn't JSON of that schema; after a crash between renames, the old one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at(path)) and fs.exists(at(path + ".old")):
        path += ".old"
    try:
        rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path).cache()
        bad = rows.filter("_corrupt is not null").head(1)
        rows.unpersist()
    except Exception:
        return None
    return None if bad else spark.read.schema(schema).json(path)


def text_layer_ok(words: str = "words", text: str = "text"):
    """Whether a page's own text layer is good enough: 50 marks, and boxes for half of its words."""
    marks = F.length(F.regexp_replace(F.col(text), r"(?U)\s", ""))
    tokens = F.size(F.filter(F.split(F.col(text), r"(?U)\s+"), lambda w: w != ""))
    return (marks >= 50) & (F.size(words) * 2 >= tokens)


def write_editions(editions: DataFrame, path: str) -> None:
    """Editions (doc, body) as text, a folder ``doc=...`` each; those of other documents stay."""
    editions.select("doc", "body").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc").text(path)


def read_editions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select("doc", F.expr("left(value, length(value) - 1)").alias("body"))


# Records that wait for a store that is locked.


def stage_records(records: DataFrame, path: str, batch: int) -> None:
    """Keep prepared records until the store can take them; the same batch again replaces itself."""
    records.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def staged_records(spark: SparkSession, path: str, owner: str) -> DataFrame | None:
    """What is staged, with its ``batch``: of each owner only its newest batch. None if nothing is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at) or not fs.listStatus(at):
        return None
    rows = spark.read.parquet(path)
    newest = rows.groupBy(owner).agg(F.max("batch").alias("batch"))
    return rows.join(newest, [owner, "batch"], "left_semi")


def clear_staged(spark: SparkSession, path: str, batches: list[int]) -> None:
    """Drop batches that were committed; later ones stay."""
    for batch in batches:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/batch={batch}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
