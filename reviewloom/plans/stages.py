"""Stage tables: work done once and read by many analyses."""

from __future__ import annotations

import gc
import uuid

from pyspark import SparkContext, StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str | None:
    """The folder all executors see, as the cluster names it; None where it names none."""
    context = spark.sparkContext
    return context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()


def drop_unused(context: SparkContext) -> None:
    """Shuffle files and checkpoints that nothing reaches go when the driver has collected its garbage: here, soon."""
    gc.collect()
    context._jvm.System.gc()


def materialize(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """The rows as a stage of their own; ``folder`` and its lifetime are the caller's.

    Without ``folder`` that of ``spark.checkpoint.dir`` is taken. With a shared folder they are written there as a parquet table and read back: later scans prune
    columns and push filters, and a lost executor costs nothing. Without one (a local session) they
    are persisted, spilling to disk, and recomputed if lost; a cluster must name one.
    """
    folder = folder or shared_folder(df.sparkSession)
    if folder is None:
        if not df.sparkSession.sparkContext.master.startswith("local"):
            raise ValueError("name a shared folder for stage tables, or set spark.checkpoint.dir")
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{folder.rstrip('/')}/stage-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    drop_unused(df.sparkSession.sparkContext)  # what was shuffled for the table
    return df.sparkSession.read.parquet(path)
