"""Operator 11: copy-on-write keyed upsert over sorted files, with exact splitters found without sorting all rows.

* ``order_statistics`` finds the keys at given ranks by histograms: each open rank has a key
  range, every round counts the keys in equal parts of all ranges at once (``BINS`` in all,
  counted in each task and summed) and keeps the part that holds the rank, until it is one key.
* ``write_sorted`` takes every M-th order statistic as a splitter. The splitters are the
  partitioner, by which rows go to their file's task, and the index of homes. A task sorts its
  rows and writes one file.
* ``Files.upsert`` finds each change's home by the splitters, reads only the files that changes go
  to, joins rows and changes by sorted merge, and compares. The counts of rows by home lay out
  the new files; the same search for order statistics splits the new rows exactly, so that a
  home with any number of new rows is never one task's; the new files are added and those
  replaced are deleted.

The driver holds the splitters and paths, one for each file, and counts of bins and homes; no
rows. A file is written by one task that streams its sorted rows.

Defined results: rows and changes without a key are left out. Where the base repeats a key, its
rows stay together in the file that the splitter puts the last of them in, files then differ in
size from M, and a change holds for all of them. Of changes to one key the caller picks one.
An empty base has no files, so no home, and all changes are ignored. Any other columns
may stand beside, with any names; values are compared with nulls equal.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.llm.common import column, materialise, remove, shared_dir, written_path

#: Parts that all open key ranges together are cut into in a round.
BINS = 1 << 14


# ---- order statistics -----------------------------------------------------------------


def histogram(keys: DataFrame, ranges: list[tuple[int, int, int]]) -> dict[tuple[int, int], int]:
    """How many keys are in each part of each range (first key, last key, width of its parts), of those that have any."""
    low, high = (np.array([r[i] for r in ranges], dtype=np.int64) for i in (0, 1))
    width = np.array([r[2] for r in ranges], dtype=np.uint64)
    parts = ((high - low).view(np.uint64) // width).astype(np.int64) + 1
    begin = np.cumsum(parts) - parts

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(int(parts.sum()), dtype=np.int64)
        for batch in batches:
            key = batch["key"].to_numpy(dtype=np.int64)
            r = np.searchsorted(low, key, "right") - 1
            inside = (r >= 0) & (key <= high[r])
            key, r = key[inside], r[inside]
            total += np.bincount(begin[r] + ((key - low[r]).view(np.uint64) // width[r]).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"part": at, "n": total[at]})

    found = keys.mapInPandas(count, "part long, n long").groupBy("part").agg(F.sum("n").alias("n")).collect()
    out = {}
    for row in found:
        r = int(np.searchsorted(begin, row["part"], "right")) - 1
        out[r, row["part"] - int(begin[r])] = row["n"]
    return out


def order_statistics(keys: DataFrame, ranks: Sequence[int], bins: int = BINS) -> list[int]:
    """The keys at these ranks (from 0, ascending, all below the number of rows) of a one-column table of integers, in order."""
    if not ranks:
        return []
    keys = keys.toDF("key").select(F.col("key").cast("long"))
    first, last = keys.agg(F.min("key"), F.max("key")).first()
    held = [(first, last, 0)] * len(ranks)  # each rank's first and last possible key, and how many keys are smaller
    while any(a < b for a, b, _ in held):
        wide = sorted({(a, b) for a, b, _ in held if a < b})
        share = max(2, bins // len(wide))
        ranges = [(a, b, -(-(b - a + 1) // share)) for a, b in wide]
        number = {r: i for i, r in enumerate(wide)}
        counts: dict[int, list[tuple[int, int]]] = {}
        for (r, part), n in sorted(histogram(keys, ranges).items()):
            counts.setdefault(r, []).append((part, n))
        for i, rank in enumerate(ranks):
            a, b, smaller = held[i]
            if a < b:
                width = ranges[number[a, b]][2]
                for part, n in counts[number[a, b]]:
                    if rank < smaller + n:
                        held[i] = (a + part * width, min(b, a + (part + 1) * width - 1), smaller)
                        break
                    smaller += n
    return [a for a, _, _ in held]


def place(key: Column, splitters: Sequence[int]) -> Column:
    """The number of the last splitter at or below the key, else 0."""
    known = np.array(splitters, dtype=np.int64)

    @F.pandas_udf("int")
    def found(keys: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(known, keys.to_numpy(dtype=np.int64), "right") - 1, 0).astype(np.int32))

    return found(key)


# ---- files ----------------------------------------------------------------------------


def layout(counts: Sequence[int], changed: set[int], m: int) -> list[int]:
    """The sizes of the new files, in order: each changed home as the fewest of at most m rows, then joined to the left where both fit into one."""
    out: list[int] = []
    joinable = False  # is the file to the left a new one?
    for home, n in enumerate(counts):
        if home not in changed:
            joinable = False
            continue
        k = -(-n // m)
        for i in range(k):
            size = n // k + (i < n % k)
            if joinable and out[-1] + size <= m:
                out[-1] += size
            else:
                out.append(size)
            joinable = True
    return out


@dataclass
class Files:
    """A table as a folder of Parquet files of at most m rows, sorted by an integer key; firsts and paths are in the order of the key."""

    spark: SparkSession
    folder: str
    schema: StructType
    key: str
    m: int
    firsts: list[int]
    paths: list[str]

    def read(self, paths: Sequence[str] | None = None) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*([self.folder] if paths is None else paths))

    def home(self, key: Column) -> Column:
        """The number of a key's file."""
        return place(key, self.firsts)

    def first_of(self, home: Column) -> Column:
        """The first key of the file with this number."""
        return F.get(F.array(*map(F.lit, self.firsts)).cast("array<bigint>"), home)

    def add(self, rows: DataFrame, splitters: Sequence[int]) -> None:
        """Write rows as one sorted file for each splitter."""
        firsts = sorted(set(splitters))
        dealt = rows.repartitionById(len(firsts), place(column(self.key), firsts)).sortWithinPartitions(column(self.key))
        dealt.write.mode("append").parquet(self.folder)

    def found(self) -> list[tuple[str, int]]:
        """(path, first key) of the files that are there, by key."""
        each = self.read().groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min(column(self.key)).alias("first"))
        return [(r["path"], r["first"]) for r in each.orderBy("first").collect()]

    def upsert(self, changes: DataFrame) -> Files:
        """The table after the changes: a struct ``set`` of the columns to set, whether to ``delete``, and the ``key``, once for each.

        Files whose rows the changes leave as they are stay; the others are replaced. A row that is
        inserted has null in the columns that aren't set.
        """
        if not self.firsts:
            return self
        asked = materialise(changes.where("key IS NOT NULL").select("key", "delete", "set", self.home(F.col("key")).alias("home")), "upsert-changes")
        homes = [r["home"] for r in asked.select("home").distinct().orderBy("home").collect()]
        if not homes:
            remove(self.spark, [written_path(asked)])
            return self
        held = self.read([self.paths[h] for h in homes]).select(column(self.key).alias("key"), F.struct(*map(column, self.schema.names)).alias("row"))
        both = held.withColumn("home", self.home(F.col("key"))).join(asked.hint("merge"), ["home", "key"], "full_outer")
        row, put = F.col("row"), asked.schema["set"].dataType.names
        was = {f.name: row.getField(f.name) for f in self.schema} | {self.key: F.coalesce(row.getField(self.key), F.col("key").cast(self.schema[self.key].dataType))}
        to = {n: F.col("set").getField(n).cast(self.schema[n].dataType) for n in put}
        new = F.struct(*[(F.when(F.col("set").isNotNull(), to[n]).otherwise(v) if n in put else v).alias(n) for n, v in was.items()])
        after = F.when(F.col("delete").isNull(), row).when(~F.col("delete"), new)
        differs = reduce(or_, [~was[n].eqNullSafe(after.getField(n)) for n in put], row.isNull() != after.isNull())
        told = both.select("home", "key", after.alias("after"), differs.alias("differs"))
        merged = materialise(told, "upsert-rows")
        by_home = merged.groupBy("home").agg(F.count("after").alias("n"), F.max("differs").alias("changed")).collect()
        changed = {r["home"] for r in by_home if r["changed"]}
        sizes = dict.fromkeys(range(len(self.firsts)), 0) | {r["home"]: r["n"] for r in by_home}
        rows = merged.where(F.col("after").isNotNull() & F.col("home").isin(sorted(changed)))
        starts = np.cumsum([0, *layout([sizes[h] for h in range(len(self.firsts))], changed, self.m)]).tolist()[:-1]
        if starts:
            self.add(rows.select("after.*"), order_statistics(rows.select("key"), starts))
        delete(self.spark, [self.paths[h] for h in sorted(changed)])
        remove(self.spark, [written_path(asked), written_path(merged)])
        there = self.found()
        return Files(self.spark, self.folder, self.schema, self.key, self.m, [f for _, f in there], [p for p, _ in there])


def delete(spark: SparkSession, paths: Sequence[str]) -> None:
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(path))
        where.getFileSystem(hadoop).delete(where, False)


def write_sorted(rows: DataFrame, key: str, m: int) -> Files:
    """rows as sorted files of m rows (the last: the rest) in a new folder of the shared one."""
    spark = rows.sparkSession
    files = Files(spark, f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex}", rows.schema, key, m, [], [])
    rows = rows.where(column(key).isNotNull())
    n = rows.count()
    if not n:
        made = spark._jvm.org.apache.hadoop.fs.Path(files.folder)
        made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(made)
        return files
    files.add(rows, order_statistics(rows.select(column(key)), range(0, n, m)))
    there = files.found()
    files.paths, files.firsts = [p for p, _ in there], [f for _, f in there]
    return files


# ---- the query ------------------------------------------------------------------------

#: What the contract calls M: a file has this share of all clients, and one row.
SHARE = 700
SET = ("source", "segment", "city", "balance")


def crc(value: Column | str) -> Column:
    return F.crc32((F.col(value) if isinstance(value, str) else value).cast("string"))


def latest(changes: DataFrame) -> DataFrame:
    """Of each client's changes the one with the highest seq, then change_id; nulls are lowest."""
    own = F.struct("seq", "change_id", "op", *SET)
    return changes.where("client_id IS NOT NULL").groupBy("client_id").agg(F.max(own).alias("c")).select("client_id", "c.*")


def digests(files: Files) -> DataFrame:
    """(path, first_id, n_rows, cents, rows_crc, ids_sha256) of every file, read in the order of its rows."""
    text = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("source", "segment", "city")])
    cents = F.coalesce(F.floor(100 * F.col("balance") + 0.5).cast("long"), F.lit(0))
    rows = files.read().select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"), "client_id", cents.alias("cents"), F.crc32(text).alias("crc"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, told, sha = None, None, None
        columns = ["path", "first_id", "n_rows", "cents", "rows_crc", "ids_sha256"]
        for batch in batches:
            for name, part in batch.groupby("path", sort=False):
                ids = part["client_id"].astype(str).str.cat(sep=",")
                if name != path:
                    if path is not None:
                        yield pd.DataFrame([(*told, sha.hexdigest())], columns=columns)
                    path, told, sha = name, [name, int(part["client_id"].iloc[0]), 0, 0, 0], hashlib.sha256()
                else:
                    ids = "," + ids
                sha.update(ids.encode())
                told[2:] = [told[2] + len(part), told[3] + int(part["cents"].sum()), told[4] + int(part["crc"].sum())]
        if path is not None:
            yield pd.DataFrame([(*told, sha.hexdigest())], columns=columns)

    return rows.repartition("path").sortWithinPartitions("path", "at").mapInPandas(run, "path string, first_id long, n_rows long, cents long, rows_crc long, ids_sha256 string")


def report(clients: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per file after the changes: first_id, n_rows, cents, rows_crc, ids_sha256, columns, path, rewritten."""
    base = clients.where(crc("client_id") % 7 > 3)
    before = write_sorted(base, "client_id", 1 + clients.count() // SHARE)
    won = latest(changes).withColumn("h", crc(before.first_of(before.home(F.col("client_id")))) % 12).where("h <= 7")
    gone = F.coalesce((F.col("op") == "D") | (crc("change_id") % 8 < F.col("h")), F.lit(False))
    after = before.upsert(won.select(F.col("client_id").alias("key"), gone.alias("delete"), F.struct(*SET).alias("set")))
    spark = clients.sparkSession
    started = spark.createDataFrame([(p,) for p in before.paths], "path string")
    found = digests(after).join(F.broadcast(started.withColumn("old", F.lit(True))), "path", "left")
    names = F.lit(",".join(after.read().columns))
    return found.select("first_id", "n_rows", "cents", "rows_crc", "ids_sha256", names.alias("columns"), "path", F.col("old").isNull().alias("rewritten"))

