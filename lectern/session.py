"""The session settings that the engine is run with."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def session(master: str = "local[*]", shuffle_partitions: int = 8, driver_memory: str = "4g") -> SparkSession:
    """A session with adaptive execution on; on a cluster the master and memory come from spark-submit."""
    return (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def new_folder(spark: SparkSession, name: str) -> str:
    """A name for a new folder in the one that driver and executors share, spark.checkpoint.dir. Where that is unset, a local session gets one of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix=f"{name}-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        shared = f"file://{local}"
    return f"{shared}/{name}-{uuid.uuid4().hex}"
