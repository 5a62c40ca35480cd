"""Metrics table, run log and exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS_SCHEMA = "section string, metric string, value string, updated_at string"


def upsert_metrics(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New sections replace old ones whole; other sections stay."""
    others = existing.join(new.select("section").distinct(), "section", "left_anti")
    return others.select(*existing.columns).unionByName(new)


def latest_metrics(history: DataFrame, version: str = "updated_at") -> DataFrame:
    """Current state of an append-only metrics table: per section the rows of its last write.

    The last version per section is a plain maximum, joined back - no section is sorted in one task.
    """
    last = history.groupBy("section").agg(F.max(version).alias(version))
    return history.join(last, ["section", version], "left_semi").select(*history.columns)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics table, or an empty one when there is none yet; any other failure is raised."""
    try:
        return spark.read.parquet(path).select("section", "metric", "value", "updated_at")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], METRICS_SCHEMA)


def replace_sections(new: DataFrame, path: str) -> None:
    """Writes each section of ``new`` whole, as a partition of its own; other sections' files stay.

    Writers of different sections do not meet: each replaces only the partitions it holds rows of.
    """
    (new.repartition("section").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("section").parquet(path))


def append_metrics(new: DataFrame, path: str) -> None:
    new.write.mode("append").parquet(path)


def run_entries(runs: DataFrame, errors: DataFrame, max_errors: int = 10) -> DataFrame:
    """Run rows (run_id, kind, timestamp, total, elapsed_sec) with the seconds per reply and their
    first errors. Errors are limited per run before they are gathered."""
    w = W.partitionBy("run_id").orderBy("error_no")
    first = errors.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_errors)
    listed = first.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("error_no", "error"))).alias("_e"))
    out = runs.join(listed, "run_id", "left")
    return out.select(
        *runs.columns,
        F.when(F.col("total") > 0, F.col("elapsed_sec") / F.col("total")).otherwise(F.lit(0.0)).alias(
            "avg_sec_per_reply"),
        F.coalesce(F.transform("_e", lambda e: e["error"]), F.array().cast("array<string>")).alias("errors"))


def latest_runs(entries: DataFrame) -> DataFrame:
    """The last entry of each kind of run (the larger run id on equal times)."""
    others = [c for c in entries.columns if c not in ("kind", "timestamp", "run_id")]
    last = entries.groupBy("kind").agg(
        F.max(F.struct("timestamp", "run_id")).alias("_k"),
        F.max_by(F.struct(*others), F.struct("timestamp", "run_id")).alias("_v"))
    return last.select("kind", "_k.timestamp", "_k.run_id", *[F.col(f"_v.{c}").alias(c) for c in others])


def append_runs(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)


def flat_columns(df: DataFrame, separator: str = ", ") -> DataFrame:
    """Arrays joined to text and dates rendered, for text files."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, separator)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(f.name))
    return df.select(*out)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV files with header, quoted so that multi-line texts survive a round trip."""
    flat_columns(df).write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False, emptyValue="")
