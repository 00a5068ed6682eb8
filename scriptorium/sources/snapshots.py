"""Versioned write-once snapshots on any file system that Spark reaches.

A snapshot's tables are first staged in a folder of their own. It comes into being when its
record, a small JSON file named after its fingerprint, is created exclusively as the last step;
a folder without a record is invisible, so a lost driver leaves nothing half done, and a second
commit of the same fingerprint fails without touching the first. Records name their parents, so
snapshots form a history. Fingerprints are meant to be taken from the staged tables, that is
from what was stored. Nothing is ever rewritten.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping
from datetime import UTC, datetime

from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import DataFrame, SparkSession

FINGERPRINT = re.compile(r"[0-9a-f]{64}")


class SnapshotError(RuntimeError):
    """A snapshot exists already, does not exist, or its record cannot be read."""


class Files:
    """Small files written once, through the file system interface of Spark."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm, self._conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")

    def _path(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self._conf)

    def create(self, name: str, value: Mapping) -> None:
        """Fails when the file exists."""
        path, fs = self._path(name)
        try:
            out = fs.create(path, False)
        except Exception as error:
            if fs.exists(path):
                raise SnapshotError(f"{name} exists already") from error
            raise
        try:
            out.write(bytearray(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()))
        finally:
            out.close()

    def read(self, name: str) -> dict | None:
        """None when there is no such file."""
        path, fs = self._path(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError as error:
            raise SnapshotError(f"{name} is not a complete record") from error
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        path, fs = self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def delete(self, folder: str) -> None:
        path, fs = self._path(folder)
        fs.delete(path, True)


class Stage:
    """Tables that were written but are not part of a snapshot yet."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.name, self.tables, self._root = spark, f"data/{uuid.uuid4().hex}", [], root

    def write(self, table: str, df: DataFrame) -> DataFrame:
        """Stores ``df`` and returns it as stored."""
        df.write.mode("errorifexists").parquet(f"{self._root}/{self.name}/{table}")
        self.tables.append(table)
        return self.spark.read.parquet(f"{self._root}/{self.name}/{table}")


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def stage(self) -> Stage:
        return Stage(self.spark, self.root)

    def discard(self, stage: Stage) -> None:
        self.files.delete(stage.name)

    def commit(
        self, stage: Stage, fingerprint: str, *, parents: Mapping[str, str] | None = None, facts: Mapping[str, str | int] | None = None, now: datetime | None = None
    ) -> dict:
        """Makes a stage the snapshot of ``fingerprint``; the stage is discarded when that one exists."""
        parents = dict(parents or {})
        if bad := [v for v in [fingerprint, *parents.values()] if not FINGERPRINT.fullmatch(v)]:
            raise ValueError(f"not a fingerprint: {bad[0]!r}")
        stamp = (now or datetime.now(UTC)).astimezone(UTC).isoformat().replace("+00:00", "Z")
        record = {"fingerprint": fingerprint, "data": stage.name, "tables": sorted(stage.tables), "parents": parents, "facts": dict(facts or {}), "created_at_utc": stamp}
        try:
            self.files.create(f"commits/{fingerprint}.json", record)
        except SnapshotError:
            self.discard(stage)
            raise
        return record

    def exists(self, fingerprint: str) -> bool:
        return self.files.read(f"commits/{fingerprint}.json") is not None

    def record(self, fingerprint: str) -> dict:
        found = self.files.read(f"commits/{fingerprint}.json")
        if found is None:
            raise SnapshotError(f"no snapshot {fingerprint}")
        return found

    def load(self, fingerprint: str, table: str) -> DataFrame:
        record = self.record(fingerprint)
        try:
            return self.spark.read.parquet(f"{self.root}/{record['data']}/{table}")
        except CapturedException as error:
            raise SnapshotError(f"snapshot {fingerprint} has no readable table {table}") from error

    def history(self) -> list[dict]:
        """Records of all snapshots, oldest first."""
        records = [self.files.read(f"commits/{name}") for name in self.files.names("commits") if name.endswith(".json")]
        return sorted(records, key=lambda r: (r["created_at_utc"], r["fingerprint"]))

    def lineage(self, fingerprint: str) -> list[str]:
        """The snapshot and those of its ancestors that this store holds, nearest first."""
        seen, todo = [], [fingerprint]
        while todo:
            at = todo.pop(0)
            if at not in seen and (record := self.files.read(f"commits/{at}.json")):
                seen.append(at)
                todo += [record["parents"][k] for k in sorted(record["parents"])]
        return seen
