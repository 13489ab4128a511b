"""Versioned state: several named tables published together under one manifest.

A commit writes every table of the next version in a directory of its own and
then publishes one manifest by rename; readers resolve the manifest once and see
all tables of that version or of the one before. A commit that fails publishes
nothing. One writer at a time holds the lock file.
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


_scratch: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset, a temporary one on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _scratch.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="zetaflow-"))
    return f"{root.rstrip('/')}/state-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Cut lineage: write a table that several steps read, and read it back. Its files go when the driver ends."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


class Locked(RuntimeError):
    """Another writer holds the state directory."""


class State:
    def __init__(self, spark: SparkSession, root: str, keep: int = 2, lease: float = 3600):
        self.spark, self.root, self.keep, self.lease, self.owner = spark, root.rstrip("/"), keep, lease, uuid.uuid4().hex
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _write(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    # Locking.

    def lock(self) -> None:
        """Take the lock, or one whose holder has not renewed it within ``lease`` seconds, as after a crash."""
        at = self._path(f"{self.root}/LOCK")
        for last in (False, True):
            try:
                out = self._fs.create(at, False)
                out.write(bytearray(self.owner.encode()))
                out.close()
                return
            except Exception as e:
                if last or not self._expired(at):
                    raise Locked(self.root) from e
            # only one of several waiting writers can move the old lock away
            aside = self._path(f"{self.root}/.lock-{uuid.uuid4().hex}")
            if self._fs.rename(at, aside):
                self._fs.delete(aside, False)

    def _expired(self, at) -> bool:
        try:
            return time.time() * 1000 - self._fs.getFileStatus(at).getModificationTime() > self.lease * 1000
        except Exception:
            return True  # it was released meanwhile

    def held(self) -> bool:
        """Whether this writer still owns the lock."""
        try:
            return self._read(f"{self.root}/LOCK") == self.owner
        except Exception:
            return False

    def unlock(self) -> None:
        if self.held():
            self._fs.delete(self._path(f"{self.root}/LOCK"), False)

    # Versions.

    def manifests(self) -> list[int]:
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n.removeprefix("manifest-")) for n in found if n.startswith("manifest-"))

    def snapshot(self) -> dict:
        """The last manifest: version, batch and the directory of each table."""
        versions = self.manifests()
        return json.loads(self._read(f"{self.root}/manifest-{versions[-1]:012d}")) if versions else {"version": 0, "batch": None, "tables": {}}

    def read(self, table: str, schema: str, snapshot: dict | None = None, only: list[int] | None = None) -> DataFrame:
        """A table, or ``only`` some of its buckets."""
        at = (snapshot or self.snapshot())["tables"].get(table)
        if isinstance(at, dict):
            at = [p for b, p in at["at"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*([at] if isinstance(at, str) else at)) if at else self.spark.createDataFrame([], schema)

    @staticmethod
    def buckets(snapshot: dict, table: str) -> int | None:
        """Into how many buckets a table is dealt; None if into none."""
        at = snapshot["tables"].get(table)
        return at["of"] if isinstance(at, dict) else None

    def commit(self, tables: dict[str, DataFrame], batch: int | None = None, partition_by: dict[str, str] | None = None, dealt: dict[str, tuple[int, list[int] | None]] | None = None) -> int:
        """Publish new contents of ``tables``; others stay as they are. A batch number that was committed before is a no-op.

        ``partition_by`` names a column by whose values a table lies in folders of
        its own. ``dealt`` says of a table with the bucket of each row in ``_bucket``
        how many buckets there are and which of them the frame replaces (None: all).
        """
        old = self.snapshot()
        if batch is not None and old["batch"] is not None and batch <= old["batch"]:
            return old["version"]
        version = old["version"] + 1
        at = dict(old["tables"])
        for name, frame in tables.items():
            if name in (dealt or {}):
                at[name] = self._deal(f"{self.root}/v{version:012d}-{uuid.uuid4().hex[:8]}/{name}", frame, at.get(name), *dealt[name])
                continue
            at[name] = f"{self.root}/v{version:012d}-{uuid.uuid4().hex[:8]}/{name}"
            by = (partition_by or {}).get(name)
            (frame.repartition(by).write.partitionBy(by) if by else frame.write).parquet(at[name])
        temp = f"{self.root}/.manifest-{uuid.uuid4().hex}"
        self._write(temp, json.dumps({"version": version, "batch": old["batch"] if batch is None else batch, "tables": at}))
        if not self._fs.rename(self._path(temp), self._path(f"{self.root}/manifest-{version:012d}")):
            raise OSError("another writer published this version")
        self._clean()
        return version

    def _deal(self, path: str, frame: DataFrame, old, of: int, replaced: list[int] | None) -> dict:
        """Write buckets and name them beside the old ones that stay; large buckets take several tasks, small ones share one."""
        kept = {b: p for b, p in old["at"].items() if int(b) not in replaced} if replaced is not None and isinstance(old, dict) else {}
        if replaced != []:
            frame.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(path)
            found = [s.getPath().getName() for s in self._fs.listStatus(self._path(path))]
            kept |= {n.removeprefix("_bucket="): f"{path}/{n}" for n in found if n.startswith("_bucket=")}
        return {"of": of, "at": kept}

    @staticmethod
    def _paths(at) -> list[str]:
        return list(at["at"].values()) if isinstance(at, dict) else [at]

    def _clean(self) -> None:
        """Drop manifests beyond the last ``keep`` and the directories none of the others names."""
        versions = self.manifests()
        used = set()
        for v in versions[-self.keep :]:
            tables = json.loads(self._read(f"{self.root}/manifest-{v:012d}"))["tables"]
            used |= {p.removeprefix(f"{self.root}/").split("/")[0] for at in tables.values() for p in self._paths(at)}
        for v in versions[: -self.keep]:
            self._fs.delete(self._path(f"{self.root}/manifest-{v:012d}"), False)
        for s in self._fs.listStatus(self._path(self.root)):
            name = s.getPath().getName()
            if name.startswith("v0") and name not in used:
                self._fs.delete(s.getPath(), True)

    def stats(self) -> dict[str, dict]:
        """Rows and bytes of each table of the current version."""
        out = {}
        for name, at in self.snapshot()["tables"].items():
            paths = self._paths(at)
            size = sum(self._fs.getContentSummary(self._path(p)).getLength() for p in paths)
            out[name] = {"bytes": size, "rows": self.spark.read.parquet(*paths).count() if paths else 0}
        return out


def cached(state: State, name: str, fingerprint: str, build) -> DataFrame:
    """The table kept under ``fingerprint``, else what ``build()`` returns, kept from now on. One builder at a time: others
    get :class:`Locked`."""

    def fresh() -> DataFrame | None:
        at = state.snapshot()["tables"]
        if name not in at or state.read(f"{name}_of", "fingerprint string").first()[0] != fingerprint:
            return None
        return state.spark.read.parquet(at[name])

    found = fresh()
    if found is None:
        state.lock()
        try:
            if (found := fresh()) is None:
                state.commit({name: build(), f"{name}_of": state.spark.createDataFrame([(fingerprint,)], "fingerprint string")})
                found = fresh()
        finally:
            state.unlock()
    return found
