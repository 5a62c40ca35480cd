"""Review cleaning: blank filter, keep-first de-duplication, masking, clean text, length flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.functions import fixed_values as fv
from reviewloom.functions import labels as lb
from reviewloom.functions import text as tx

SEQ = "ingest_seq"
# Which source of a union a row comes from: one number per union, outermost first. With SEQ it is the
# order of rows that are not landed yet; landed rows have one unique SEQ and no SRC.
SRC = "ingest_source"
# Columns whose values can be long: grouped by digest, so a shuffle never carries the text.
_LONG_TEXT = ("review_text", "clean_text", "text")


def missing_columns(df: DataFrame, required: list[str] = fv.REVIEW_COLUMNS) -> list[str]:
    """Required columns absent from the frame (known without reading data)."""
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: list[str] = fv.REVIEW_COLUMNS) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def drop_blank(df: DataFrame, column: str = "review_text") -> DataFrame:
    return df.filter(tx.not_blank(F.col(column)))


def key_columns(keys: list[str]) -> list[Column]:
    return [F.sha2(F.col(k), 256).alias(f"_k_{k}") if k in _LONG_TEXT else F.col(k).alias(f"_k_{k}")
            for k in keys]


def keep_first(df: DataFrame, keys: list[str] = fv.DEDUPE_KEY, seq: str = SEQ) -> DataFrame:
    """First row per key by ingest order; missing key parts compare as equal.

    The minimum of ``seq`` per key is a hash aggregate that collapses copies before the shuffle, so
    a text repeated in a third of all rows costs one row per task. The survivors are then fetched
    by their unique place - an even key - instead of ranking each group in one task. In a union of
    sources the place is (source, seq), as each source numbers its own rows.
    """
    place = [SRC, seq] if SRC in df.columns else [seq]
    first = df.groupBy(*key_columns(keys)).agg(F.min(F.struct(*place)).alias("_first")).select("_first.*")
    # The places are looked up in a hash table of each task's share: the rows with the texts are never sorted.
    return df.join(first.hint("shuffle_hash"), place, "left_semi")


def with_typed_columns(df: DataFrame) -> DataFrame:
    """Rating to double and date to DATE; what cannot be read becomes null."""
    out = df.withColumn("rating", lb.to_rating(F.col("rating")))
    if not isinstance(df.schema["date"].dataType, T.DateType):
        out = out.withColumn("date", lb.to_review_date(F.col("date")))
    return out


def mask_and_clean(df: DataFrame) -> DataFrame:
    """Masked review_text, clean_text, review_len and the flags. Row-wise: works on streams too."""
    masked = tx.with_once(df, "_masked", tx.mask_pii(F.col("review_text")))
    cleaned = tx.with_once(masked, "clean_text", tx.clean_text(F.col("_masked")))
    flag = F.coalesce(F.col("_masked") != F.col("review_text"), F.lit(False))
    return cleaned.select(
        *[F.col(c) for c in df.columns if c != "review_text"],
        F.col("_masked").alias("review_text"), "clean_text", F.length("clean_text").alias("review_len"),
        flag.alias("has_pii_masked"), flag.alias("needs_human_review"))


def keep_long_enough(cleaned: DataFrame, min_len: int = fv.MIN_REVIEW_LEN) -> DataFrame:
    return cleaned.filter(F.col("review_len") >= min_len)


def deduplicated(raw: DataFrame, keys: list[str] = fv.DEDUPE_KEY) -> DataFrame:
    return keep_first(drop_blank(raw), keys)


def clean_reviews(raw: DataFrame, min_len: int = fv.MIN_REVIEW_LEN,
                  keys: list[str] = fv.DEDUPE_KEY) -> DataFrame:
    """Raw reviews (with ``ingest_seq``) to clean reviews, all steps in order."""
    require_columns(raw)
    return keep_long_enough(mask_and_clean(with_typed_columns(deduplicated(raw, keys))), min_len)


def length_fences(clean: DataFrame) -> DataFrame:
    """One row: min, quartiles, max, IQR and outlier fences of review_len.

    Exact interpolated quantiles from a histogram of lengths: the final state holds one entry per
    distinct length, however many reviews there are.
    """
    hist = clean.groupBy("review_len").agg(F.count(F.lit(1)).alias("n"))
    q = hist.agg(
        F.percentile("review_len", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("q"),
        F.min("review_len").alias("min_len"), F.max("review_len").alias("max_len"))
    return q.select(
        "min_len", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q3"), "max_len",
    ).withColumn("iqr", F.col("q3") - F.col("q1")).withColumns({
        "low_fence": F.greatest(F.lit(0.0), F.col("q1") - 1.5 * F.col("iqr")),
        "high_fence": F.col("q3") + 1.5 * F.col("iqr"),
    })


def flag_length_outliers(clean: DataFrame) -> DataFrame:
    """``len_outlier``: strictly outside the fences, which come in as a one-row subquery."""
    fences = length_fences(clean).select(F.struct("low_fence", "high_fence")).scalar()
    return clean.withColumn("_f", fences).withColumn(
        "len_outlier",
        (F.col("review_len") < F.col("_f.low_fence")) | (F.col("review_len") > F.col("_f.high_fence")),
    ).drop("_f")


def clean_export(clean: DataFrame) -> DataFrame:
    """Clean reviews as written out: the date as text."""
    return clean.withColumn("date", F.date_format("date", "yyyy-MM-dd"))
