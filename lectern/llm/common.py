"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the word definitions of the operators name: \x20 and \x09-\x0D.
WHITE = " \t\n\x0b\x0c\r"

#: Broadcasts are made only of tables that were written first and found to be no larger than this.
BROADCAST_BYTES = 32 << 20


#: The tables that the runs which are on have written, each run in a list of its own.
_runs: ContextVar[tuple[list[str], ...]] = ContextVar("runs", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session (tests) gets a temporary one; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lectern.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="lectern-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        found = f"file://{local}"
        spark.conf.set("lectern.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _runs.get():
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def written_path(df: DataFrame) -> str:
    """Where ``materialise`` put this table."""
    return df._written


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete written tables that nothing will read again."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(hadoop).delete(where, True)


@contextmanager
def written_tables() -> Iterator[list[str]]:
    """The list of tables that are written inside, by this thread's own work alone."""
    made: list[str] = []
    token = _runs.set((*_runs.get(), made))
    try:
        yield made
    finally:
        _runs.reset(token)


def finished(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, written; the tables that it wrote on its way are removed."""
    with written_tables() as made:
        out = materialise(make(), name)
    remove(out.sparkSession, [path for path in made if path != written_path(out)])
    return out


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that nothing refers to any more, which it else does when the driver happens to collect garbage."""
    gc.collect()
    spark._jvm.System.gc()


def column(name: str) -> Column:
    """A column by its name as it is, dots and backticks among it."""
    return F.col("`" + name.replace("`", "``") + "`")


def boxed(docs: DataFrame, **beside: Column) -> DataFrame:
    """(row, ...): whole rows as one struct, so that no column of theirs clashes with those beside; ``unboxed`` gives them back."""
    return docs.select(F.struct(*map(column, docs.columns)).alias("row"), *[c.alias(k) for k, c in beside.items()])


def unboxed(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def small(df: DataFrame, row_bytes: int | Column) -> DataFrame:
    """A written table, marked for broadcast if its rows, at so many bytes each, prove to be few; else as it is, for a shuffled join."""
    size = df.agg(F.coalesce(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def salted_join(rows: DataFrame, known: DataFrame, keys: list[str], count: str, total: int, how: str = "inner", salts: int = 64) -> DataFrame:
    """rows joined with ``known``, which has each key once and how many rows have it, of ``total``.

    Keys of a thousandth of the rows or more, a thousand at most, are dealt over ``salts``
    partitions; only the list of these keys is broadcast, which that bounds.
    """
    hot = known.where(F.col(count) >= max(1000, total // 1000)).select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_hot_{k}") for k in keys])
    spread = F.when(F.col(f"_hot_{keys[0]}").isNotNull(), F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).otherwise(0)
    left = rows.join(F.broadcast(hot), same, "left").withColumn("_salt", spread.cast("int")).drop(*[f"_hot_{k}" for k in keys])
    each = F.when(F.col(count) >= max(1000, total // 1000), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = known.withColumn("_salt", F.explode(each))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def runs(batches: Iterator[pd.DataFrame], key: str, rows: int) -> Iterator[pd.DataFrame]:
    """Frames of whole key groups of about so many rows, from batches that are sorted by the key."""
    held: list[pd.DataFrame] = []
    count = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        count += len(batch)
        if count < rows:
            continue
        frame = pd.concat(held, ignore_index=True)
        keys = frame[key].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield frame.iloc[:cut]
        held, count = [frame.iloc[cut:]], len(frame) - cut
    if count:
        yield pd.concat(held, ignore_index=True)


def components(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node reachable from each of n nodes over the links u-v, by hooking and pointer jumping."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        keep = a != b
        u, v, a, b = u[keep], v[keep], a[keep], b[keep]
        if not len(u):
            break
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def map_texts(docs: DataFrame, column: str, function: Callable[[list[str]], dict], schema: str, keep: list[str], chars: int = 4_000_000) -> DataFrame:
    """keep, and what function makes of the texts (null: empty), in slices of about so many characters at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch[column]]
            begin = size = 0
            for i, text in enumerate(texts):
                size += len(text)
                if size >= chars or i == len(texts) - 1:
                    rows = batch.iloc[begin : i + 1]
                    yield pd.DataFrame({k: rows[k].to_numpy() for k in keep} | function(texts[begin : i + 1]))
                    begin, size = i + 1, 0

    kept = ", ".join(f"`{k}` {dict(docs.dtypes)[k]}" for k in keep)
    return docs.select(*keep, column).mapInPandas(run, f"{kept}, {schema}")
