"""A store of tables in a folder: each change writes a new version of a table and then moves one pointer, so that readers see all of it or nothing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StoreError(Exception):
    """What a store refuses."""


class NotFound(StoreError):
    pass


class Store:
    """Tables by name under a folder that driver and executors share. One writer at a time: a commit is refused if another came between."""

    def __init__(self, spark: SparkSession, folder: str, read_only: bool = False) -> None:
        self.spark, self.folder, self.read_only = spark, folder.rstrip("/"), read_only
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- the pointer

    def _commits(self) -> list[int]:
        log = self._path(f"{self.folder}/_log")
        if not self._fs.exists(log):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(log) if s.getPath().getName().endswith(".json"))

    def version(self) -> int:
        return max(self._commits(), default=-1)

    def state(self, version: int | None = None) -> dict:
        """Table name -> folder, and settings, at a version."""
        at = self.version() if version is None else version
        if at < 0:
            return {"tables": {}, "settings": {}, "migrations": []}
        stream = self._fs.open(self._path(f"{self.folder}/_log/{at:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, state: dict, after: int) -> None:
        if self.read_only:
            raise StoreError("the store was opened to read only")
        name = self._path(f"{self.folder}/_log/{after + 1:012d}.json")
        draft = self._path(f"{self.folder}/_log/.{uuid.uuid4().hex}")
        self._fs.mkdirs(self._path(f"{self.folder}/_log"))
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()
        # A rename on to a name that is there fails: then another writer was faster.
        if self._fs.exists(name) or not self._fs.rename(draft, name):
            self._fs.delete(draft, False)
            raise StoreError("another writer committed in between")

    # ---- tables

    def tables(self) -> list[str]:
        return sorted(self.state()["tables"])

    def table(self, name: str, version: int | None = None) -> DataFrame:
        held = self.state(version)["tables"].get(name)
        if held is None:
            raise NotFound(name)
        return self.spark.read.parquet(*held["parts"])

    def columns(self, name: str) -> list[str]:
        return self.table(name).columns

    def transaction(self, changes: dict[str, DataFrame], append: bool = False, settings: dict | None = None, migration: str | None = None) -> int:
        """Write some tables anew, or on to what they have, and make all of it visible at once; the new version's number."""
        after = self.version()
        state = self.state(after)
        for name, df in changes.items():
            part = f"{self.folder}/{name}/{uuid.uuid4().hex}"
            df.write.parquet(part)
            before = state["tables"].get(name, {"parts": []})["parts"] if append else []
            state["tables"][name] = {"parts": [*before, part]}
        state["settings"] |= settings or {}
        state["migrations"] += [migration] if migration else []
        self._commit(state, after)
        return after + 1

    def drop_folder(self, path: str) -> None:
        """Delete a folder that no version names."""
        if self.read_only:
            raise StoreError("the store was opened to read only")
        self._fs.delete(self._path(path), True)

    def expire(self, keep: int = 1) -> int:
        """Forget all versions but the last ``keep`` and delete every file that none of these has; how many folders went.

        Versions go first, so that nobody finds one whose files are gone. Readers of those that stay see no change.
        """
        if self.read_only:
            raise StoreError("the store was opened to read only")
        commits = self._commits()
        stay = commits[-max(1, keep) :]
        live = {part.rstrip("/").rsplit("/", 2)[-2] + "/" + part.rstrip("/").rsplit("/", 1)[-1] for v in stay for held in self.state(v)["tables"].values() for part in held["parts"]}
        for version in commits:
            if version not in stay:
                self._fs.delete(self._path(f"{self.folder}/_log/{version:012d}.json"), False)
        gone = 0
        for table in self._fs.listStatus(self._path(self.folder)):
            name = table.getPath().getName()
            if table.isDirectory() and name != "_log":
                for part in self._fs.listStatus(table.getPath()):
                    if f"{name}/{part.getPath().getName()}" not in live:
                        self._fs.delete(part.getPath(), True)
                        gone += 1
        return gone

    def rewrite(self, changes: dict[str, Callable[[DataFrame], DataFrame]]) -> int:
        """Write tables anew as a function of what they are, and expire all before: what is not in the new rows is in no file any more."""
        self.transaction({name: change(self.table(name)) for name, change in changes.items()})
        self.expire()
        return self.version()

    def insert(self, name: str, df: DataFrame) -> int:
        return self.transaction({name: df}, append=True)

    def query(self, sql: str, **args) -> DataFrame:
        """SQL over the store's tables in braces."""
        return self.spark.sql(sql, **{n: self.table(n) for n in self.tables() if f"{{{n}}}" in sql}, **args)

    def scalar(self, sql: str) -> object:
        row = self.query(sql).first()
        return row[0] if row else None

    # ---- settings and migrations

    def setting(self, key: str, default: object = None) -> object:
        return self.state()["settings"].get(key, default)

    def set_setting(self, key: str, value: object) -> int:
        return self.transaction({}, settings={key: value})

    def pending(self, migrations: dict[str, Callable[[Store], dict[str, DataFrame]]]) -> list[str]:
        return [m for m in migrations if m not in self.state()["migrations"]]

    def migrate(self, migrations: dict[str, Callable[[Store], dict[str, DataFrame]]]) -> list[str]:
        """Run what has not run yet, in order, each with its mark in one commit."""
        done = self.pending(migrations)
        for name in done:
            self.transaction(migrations[name](self), migration=name)
        return done

    # ---- bundles

    def register_bundle(self, body: str, bundle_id: str, version: str, staged: bool = False) -> int:
        """Add a version of a bundle; it is the active one unless it is only staged."""
        seq = 0 if "bundles" not in self.tables() else 1 + (self.scalar("SELECT max(seq) FROM {bundles}") or 0)
        return self.insert("bundles", self.spark.createDataFrame([(seq, bundle_id, version, body, staged)], "seq long, bundle_id string, version string, body string, staged boolean"))


def numbered(rows: DataFrame, start: int, by: str) -> DataFrame:
    """rows with version numbers on from start, for lists that a person keeps."""
    from pyspark.sql import Window

    return rows.withColumn("version", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(by)) + start)
