"""Review scans and normalisers: store exports, feeds and manual files to one review layout.

All readers take data already landed as files; nothing here talks to a store.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.functions import fixed_values as fv
from reviewloom.operators.cleaning import SEQ, SRC
from reviewloom.operators.ranking import first_per_group
from reviewloom.operators.setops import union_sources

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in fv.REVIEW_COLUMNS])

PLAY_SCHEMA = T.StructType([
    T.StructField("app_id", T.StringType()), T.StructField("app_name", T.StringType()),
    T.StructField("score", T.StringType()), T.StructField("at", T.StringType()),
    T.StructField("content", T.StringType()), T.StructField("reviewCreatedVersion", T.StringType()),
])

_LABEL = T.StructType([T.StructField("label", T.StringType())])
FEED_SCHEMA = T.StructType([
    T.StructField("app_id", T.StringType()), T.StructField("app_name", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("feed", T.StructType([T.StructField("entry", T.ArrayType(T.StructType([
        T.StructField("im:rating", _LABEL), T.StructField("im:version", _LABEL),
        T.StructField("updated", _LABEL), T.StructField("title", _LABEL),
        T.StructField("content", _LABEL),
    ])))])),
])


def read_review_csv(spark: SparkSession, path: str | list[str], schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """Review CSV files with header, quoted multi-line texts and an optional byte-order mark.

    Everything is read as text; ratings and dates are converted where they are used. Land the rows
    once (``land_reviews``) before using ``ingest_seq`` in more than one job.
    """
    rows = spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"',
                          encoding="UTF-8", enforceSchema=True)
    return with_ingest_seq(rows)


def read_large_review_csv(spark: SparkSession, path: str | list[str], schema: T.StructType = RAW_SCHEMA,
                          bad: str = "bad_record") -> DataFrame:
    """The rows of ``read_review_csv`` with one file read by many tasks, and a column for records that do not parse.

    Files are read by lines in blocks. An index of the quotes per block tells whether a block starts inside a quoted
    text; within a block a running count of quotes finds the lines where records start. Records of one line are parsed
    as they are; lines of longer ones, also over block borders, are glued by the number of their record in the file.
    Lines shuffle once, by block. ``ingest_seq`` ascends with file, block and line. Quotes inside a text are doubled.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (lines.groupBy("file", "block").agg(F.sum("quotes").alias("all"))  # one row per block
              .select("file", "block", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("before"),
                      (F.row_number().over(Window.orderBy("file", "block")) - 1).cast("long").alias("ordinal")))
    inside = Window.partitionBy("file", "block").orderBy("line")
    sofar = F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("before")
    placed = (lines.withColumn("line", F.monotonically_increasing_id()).join(blocks, ["file", "block"])
              .withColumn("sofar", sofar).withColumn("place", F.row_number().over(inside) - 1)
              .where((F.col("block") > 0) | (F.col("place") > 0))  # headers
              .select("file", "block", "value", F.shiftleft("ordinal", 33).bitwiseOR(F.col("place").cast("long")).alias(SEQ),
                      ((F.col("sofar") - F.col("quotes")) % 2 == 0).alias("opens"), (F.col("sofar") % 2 == 0).alias("closes")))
    pieces = placed.where("NOT (opens AND closes)")
    records = (pieces.groupBy("file", "block").agg(F.count_if("opens").alias("all"))
               .select("file", "block", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("records")))
    running = F.count_if("opens").over(Window.partitionBy("file", "block").orderBy(SEQ))
    glued = (pieces.withColumn("running", running).join(records, ["file", "block"])
             .groupBy("file", (F.col("running") + F.col("records")).alias("number"))
             .agg(F.min(SEQ).alias(SEQ), F.array_sort(F.collect_list(F.struct(SEQ, "value"))).alias("parts"))
             .select(SEQ, F.array_join("parts.value", "\n").alias("record")))
    whole = placed.where(F.col("opens") & F.col("closes")).select(SEQ, F.col("value").alias("record")).unionByName(glued)
    whole = whole.select(SEQ, F.regexp_replace("record", "\r$", "").alias("record")).where(F.trim("record") != "")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*schema.fields, T.StructField(bad, T.StringType())])
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    return whole.select(F.from_csv("record", fields, options).alias("row"), SEQ).select("row.*", SEQ)


def read_review_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def with_ingest_seq(df: DataFrame) -> DataFrame:
    """Numbers rows in scan order (no shuffle)."""
    return df if SEQ in df.columns else df.withColumn(SEQ, F.monotonically_increasing_id())


def land_reviews(df: DataFrame, path: str, partition_by_app: bool = False) -> None:
    """Write numbered reviews: from here on ``ingest_seq`` is a stored column, unique over all sources.

    A union of sources is sorted by (source, number) in ranges and numbered anew in that order.
    """
    if SRC in df.columns:
        df = df.orderBy(SRC, SEQ).drop(SRC, SEQ)
    writer = with_ingest_seq(df).write.mode("overwrite")
    if partition_by_app:
        writer = writer.partitionBy("app_name")
    writer.parquet(path)


def read_play_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PLAY_SCHEMA).json(path)


def read_feed_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEED_SCHEMA).json(path, multiLine=True)


def _one_line(c: Column) -> Column:
    return F.trim(F.replace(c, F.lit("\n"), F.lit(" ")))


def _text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _cap_per_app(df: DataFrame, n: int | None, *order: Column) -> DataFrame:
    if n is None:
        return df
    return first_per_group(df, ["app_name"], list(order), n, SEQ).drop("_rn")


def normalize_play_records(records: DataFrame, n: int | None = None) -> DataFrame:
    """Play-store records to reviews: all, or the newest n per app."""
    rows = with_ingest_seq(records)
    newest = _cap_per_app(rows, n, F.col("at").desc_nulls_last(), F.col(SEQ))
    return newest.select(
        SEQ, "app_name", F.lit("google_play").alias("store"), F.col("score").cast("string").alias("rating"),
        F.substring(_text_or_empty(F.col("at").cast("string")), 1, 10).alias("date"),
        _one_line(_text_or_empty(F.col("content"))).alias("review_text"),
        _text_or_empty(F.col("reviewCreatedVersion")).alias("version"),
        F.concat(F.lit(fv.PLAY_STORE_URL), _text_or_empty(F.col("app_id"))).alias("source_url"))


def normalize_feed_pages(pages: DataFrame, country: str = "kr", n: int | None = None) -> DataFrame:
    """App-store feed pages to reviews: entries that carry a rating, all or the first n per app."""
    entries = with_ingest_seq(
        pages.select("app_id", "app_name", "page", F.posexplode("feed.entry").alias("pos", "e")))
    rated = entries.filter(F.col("e.`im:rating`").isNotNull())
    first = _cap_per_app(rated, n, F.col("page"), F.col("pos"))
    url = fv.APP_STORE_URL.replace("{country}", country)

    def label(name: str) -> Column:
        return _text_or_empty(F.col(f"e.`{name}`.label"))

    return first.select(
        SEQ, "app_name", F.lit("app_store").alias("store"), F.col("e.`im:rating`.label").alias("rating"),
        F.substring(label("updated"), 1, 10).alias("date"),
        _one_line(F.concat(label("title"), F.lit(" "), label("content"))).alias("review_text"),
        label("im:version").alias("version"),
        F.replace(F.lit(url), F.lit("{app_id}"), _text_or_empty(F.col("app_id"))).alias("source_url"))


def normalize_store_csv(df: DataFrame, app_name: str) -> DataFrame:
    """A manually downloaded store file: app name defaulted, store forced, text from review_text or
    else review."""
    have = set(df.columns)

    def col_or(name: str, default: str) -> Column:
        return F.col(name).cast("string") if name in have else F.lit(default)

    text = "review_text" if "review_text" in have else "review"
    return with_ingest_seq(df).select(
        SEQ, col_or("app_name", app_name).alias("app_name"), F.lit("app_store").alias("store"),
        (F.col("rating").cast("string") if "rating" in have else F.lit(None).cast("string")).alias("rating"),
        F.substring(col_or("date", ""), 1, 10).alias("date"), col_or(text, "").alias("review_text"),
        col_or("version", "").alias("version"), col_or("source_url", "").alias("source_url"))


def normalize_manual(df: DataFrame, default_app: str = "") -> DataFrame:
    """Any manual table: missing standard columns become ''; the app name and the store are filled
    only when blank in every row."""
    have = set(df.columns)
    rows = with_ingest_seq(df).select(SEQ, *[
        F.col(c).cast("string").alias(c) if c in have else F.lit("").alias(c) for c in fv.REVIEW_COLUMNS])

    def filled(column: str, default: str) -> Column:
        if not default:
            return F.col(column)
        if column not in have:
            return F.lit(default)
        used = rows.agg(F.coalesce(F.bool_or(F.trim(column) != ""), F.lit(False))).scalar()
        return F.when(used, F.col(column)).otherwise(default)

    return rows.withColumns({"app_name": filled("app_name", default_app), "store": filled("store", "sample")})


def collect_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of all landed sources in order (see ``union_sources``); sources without rows add none."""
    return union_sources(*frames)
