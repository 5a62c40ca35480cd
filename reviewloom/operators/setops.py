"""Union and merge of review tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions import fixed_values as fv
from reviewloom.operators import cleaning as cl
from reviewloom.operators.cleaning import SEQ, SRC


def to_standard_columns(df: DataFrame, columns: list[str] = fv.REVIEW_COLUMNS) -> DataFrame:
    """Standard columns in order (missing ones null), plus the ingest order."""
    cols = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    return df.select(*[c for c in (SRC, SEQ) if c in df.columns], *cols)


def union_sources(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all frames; columns matched by name, absent ones null.

    Each frame numbers its own rows, so ``ingest_source`` keeps the frame's number (in front of those
    of a union inside it): all rows of a frame come before those of the next.
    """
    out = None
    for i, df in enumerate((first, *others)):
        number = F.array(F.lit(i))
        placed = df.withColumn(SRC, F.concat(number, SRC) if SRC in df.columns else number)
        out = placed if out is None else out.unionByName(placed, allowMissingColumns=True)
    return out


def merge_reviews(base: DataFrame, new: DataFrame, keys: list[str] = fv.DEDUPE_KEY) -> DataFrame:
    """Base plus new rows; for the same key the base row, else the earlier row, stays."""
    return cl.keep_first(union_sources(to_standard_columns(base), to_standard_columns(new)), keys)


def apply_new_reviews(base: DataFrame | None, new: DataFrame, mode: str) -> DataFrame:
    """'merge' keeps what is there; 'overwrite' (or no base) takes the new rows. Cleaned afterwards.

    Base rows come before new ones in the order (``ingest_source``, ``ingest_seq``); landing the
    result numbers it anew.
    """
    if mode not in ("merge", "overwrite"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "merge" and base is not None:
        return cl.clean_reviews(merge_reviews(base, new))
    return cl.clean_reviews(to_standard_columns(new))


def other_apps(df: DataFrame, own_app: str) -> DataFrame:
    return df.select("app_name").filter(F.col("app_name") != own_app).distinct()
