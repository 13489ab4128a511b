"""Pieces shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a Java pattern and as the characters themselves.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = "\t\n\x0b\x0c\r "

#: Short rows (digests, identifiers, labels) to a written file: about 10 MB.
FILE_ROWS = 250_000

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a temporary one serves a local master; on a cluster that is
    an error, because every executor would write to a disk of its own.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="zetaflow-")
    return _own_dirs[context.applicationId]


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    The files go when the driver ends, or before by :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/zf-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _path(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def few(df: DataFrame, rows: int, each: int = FILE_ROWS, apart: bool = False) -> DataFrame:
    """``df``, of about ``rows`` rows, to be written in as many files as hold them at ``each``, or as there are cores.

    Without native libraries, Hadoop's local files take three processes each
    (``chmod``), started by the executor's JVM. ``apart`` moves the rows to tasks
    of their own; else the tasks that make them are as few.
    """
    files = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each))
    return df.repartition(files) if apart else df.coalesce(files)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more; anything else is left alone."""
    path = getattr(df, "written", None)
    if path:
        files, at = _path(df.sparkSession, path)
        files.delete(at, True)


def tidy(run):
    """``run``, a function for ``mapInArrow``; when a task ends, the memory it has freed goes back to the system.

    Python workers wait for later tasks, of any query, and would keep what their
    largest batches took.
    """

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return tidied


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words in a text (0 for null)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
