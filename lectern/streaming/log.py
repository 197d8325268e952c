"""The event log as a stream: deduplicated offers, counts by window, and the tail of the log from files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.search import Index
from lectern.sources.store import Store


def tail(spark: SparkSession, path: str, schema, files_per_trigger: int = 25) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and action; what is later than the watermark is left out."""
    return events.withWatermark("edited_at", late).groupBy(F.window("edited_at", window).alias("w"), "action").agg(F.count(F.lit(1)).alias("n"))


def offers(events: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Each fingerprint once within the watermark."""
    return events.withWatermark("edited_at", late).dropDuplicatesWithinWatermark(keys)


def run_once(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Work through what is there now, and stop: a scheduled task's chunk."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(sink).awaitTermination()


def into_store(stream: DataFrame, store: Store, table: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Keep a table of a store merged with what arrives: ``merge(table or None, batch)`` is its next version.

    The number of the batch is committed with the version that holds it. A batch that comes
    again, as the stream stopped between the store's commit and its own, changes nothing.
    """
    mark = f"{table}_batch"

    def step(batch: DataFrame, number: int) -> None:
        if number > store.setting(mark, -1):
            store.transaction({table: merge(store.table(table) if table in store.tables() else None, batch)}, settings={mark: number})

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted(keys: list[str], at: str = "at") -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A merge that counts rows by key between runs: (*keys, n, first_at, last_at)."""

    def merge(held: DataFrame | None, batch: DataFrame) -> DataFrame:
        new = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
        both = new if held is None else held.unionByName(new)
        return both.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))

    return merge


def into_index(stream: DataFrame, index: Index, checkpoint: str) -> StreamingQuery:
    """Keep an index in step with pages as they arrive; a batch that comes again finds nothing new."""
    return stream.writeStream.foreachBatch(lambda batch, _: index.add(batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
