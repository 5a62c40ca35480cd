"""App dimension, collection report, source manifest and competitor documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions import fixed_values as fv
from reviewloom.functions import text as tx


def clean_apps(apps: DataFrame) -> DataFrame:
    """App dimension: trimmed names and ids, ids as text, rows without a name dropped."""
    def text(c: str):
        return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))

    out = apps.select(
        text("name").alias("name"), text("google_play").alias("google_play"),
        text("app_store").alias("app_store"),
        F.coalesce(F.col("is_our_app"), F.lit(False)).alias("is_our_app"))
    return out.filter(F.col("name") != "")


def app_by_name(apps: DataFrame, name: str) -> DataFrame:
    return clean_apps(apps).filter(F.col("name") == name).limit(1)


def collection_report(requested: DataFrame, apps: DataFrame, reviews: DataFrame,
                      stores: Sequence[str] = ("google_play", "app_store")) -> DataFrame:
    """(app, store, count, status) for each requested app and store it has an id for.

    ``requested``: one column ``app``. An unregistered app gives one row with store '-'. Review
    counts are one row per app and store before they are joined.
    """
    counts = reviews.groupBy("app_name", "store").agg(F.count(F.lit(1)).alias("n"))
    known = clean_apps(apps)
    grid = F.array(*[
        F.struct(F.lit(s).alias("store"), (F.col(s) != "").alias("has_id")) for s in stores])
    picked = requested.join(known, F.col("app") == F.col("name"), "left")
    cells = picked.filter(F.col("name").isNotNull()).select("app", F.explode(grid).alias("g"))
    cells = cells.filter("g.has_id").select("app", F.col("g.store").alias("store"))
    n = F.coalesce(F.col("n"), F.lit(0))
    filled = cells.join(
        counts.withColumnRenamed("app_name", "app"), ["app", "store"], "left").select(
        "app", "store", n.alias("count"),
        F.when(n > 0, fv.STATUS_COLLECTED).when(
            F.col("store") == "app_store", fv.STATUS_EMPTY_APP_STORE).otherwise(fv.STATUS_EMPTY).alias("status"))
    unknown = picked.filter(F.col("name").isNull()).select(
        "app", F.lit("-").alias("store"), F.lit(0).cast("long").alias("count"),
        F.lit(fv.STATUS_UNREGISTERED).alias("status"))
    return filled.unionByName(unknown)


def manifest_records(reviews: DataFrame, collected_at: str, manual_files: dict[str, str] | None = None) -> DataFrame:
    """One manifest record per (app, store) that has reviews.

    manual_files: the file by app where the app-store reviews were brought in by hand.
    """
    loads = reviews.groupBy("app_name", "store").agg(
        F.count(F.lit(1)).alias("n"), F.min("source_url").alias("url"))
    method = F.when(F.col("store") == "google_play", "google_play_scraper").when(
        F.col("store") == "app_store", F.when(F.col("app_name").isin(list(manual_files or {})), "app_store_manual_csv")
        .otherwise("manual_download")).otherwise("sample_generated")
    file = F.lit(None).cast("string")
    for app, path in (manual_files or {}).items():
        file = F.when((F.col("app_name") == app) & (F.col("store") == "app_store"), path).otherwise(file)
    return loads.select(
        F.concat_ws(" ", "app_name", "store").alias("source_name"),
        F.when(method == "sample_generated", "sample").otherwise("review").alias("source_type"),
        "app_name", F.coalesce(file, "url", F.lit("")).alias("url_or_file"), method.alias("collection_method"),
        F.lit(collected_at).alias("collected_at"),
        F.concat(F.col("n").cast("string"), F.lit(" reviews")).alias("terms_note"),
        F.lit("collected").alias("status"))


def validated_manifest(records: DataFrame) -> DataFrame:
    """Fails the job on an unknown source type or collection method."""
    def checked(c: str, allowed: list[str]):
        return F.when(F.col(c).isin(allowed), F.col(c)).otherwise(
            F.raise_error(F.concat(F.lit(f"{c} not allowed: "), F.coalesce(F.col(c), F.lit("null")))))

    return records.withColumns({
        "source_type": checked("source_type", fv.SOURCE_TYPES),
        "collection_method": checked("collection_method", fv.COLLECTION_METHODS),
    }).select(*fv.MANIFEST_COLUMNS)


def append_manifest(records: DataFrame, path: str) -> None:
    validated_manifest(records).write.mode("append").parquet(path)


def write_manifest(records: DataFrame, path: str) -> None:
    validated_manifest(records).write.mode("overwrite").parquet(path)


def competitor_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(app_name, norm_text) of every *.md file in the folder except the readme."""
    docs = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    stem = F.regexp_extract(F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))), r"^(.*)\.md$", 1)
    return docs.select(stem.alias("app_name"), tx.normalize(F.col("value")).alias("norm_text")).filter(
        F.lower("app_name") != "readme")
