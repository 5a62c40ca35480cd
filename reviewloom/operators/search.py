"""Filters, listings and candidate queues over reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions import fixed_values as fv
from reviewloom.functions import labels as lb
from reviewloom.functions.rules import IssueRules
from reviewloom.operators import issues
from reviewloom.operators.cleaning import SEQ, drop_blank


def faceted_search(df: DataFrame, apps: Sequence[str] | None = None, stores: Sequence[str] | None = None,
                   rating_min: float = 1, rating_max: float = 5, keyword: str = "",
                   text_col: str = "clean_text", literal: bool = False) -> DataFrame:
    """Reviews matching every facet. The keyword is a case-insensitive regular expression, or plain
    text with ``literal``. Reviews without a rating never match."""
    out = df.filter(F.col("rating").between(rating_min, rating_max))
    if apps is not None:
        out = out.filter(F.col("app_name").isin(list(apps)))
    if stores:
        out = out.filter(F.col("store").isin(list(stores)))
    word = keyword.strip()
    if word:
        if literal:
            hit = F.lower(F.col(text_col)).contains(word.lower())
        else:
            hit = F.col(text_col).rlike(f"(?iu){word}")
        out = out.filter(F.coalesce(hit, F.lit(False)))
    return out


def negative_reviews(df: DataFrame) -> DataFrame:
    return df.filter(lb.is_negative(F.col("rating")))


def first_rows(df: DataFrame, n: int, seq: str = SEQ) -> DataFrame:
    """First n rows in ingest order (top-n per task, then merged)."""
    return df.orderBy(seq).limit(n)


def negative_listing(df: DataFrame, n: int = 100) -> DataFrame:
    return first_rows(negative_reviews(df), n)


def evidence(df: DataFrame, n: int = 3, text_col: str = "clean_text", width: int = 120) -> DataFrame:
    """The first negative reviews as (evidence_no, source, text)."""
    picked = first_rows(negative_reviews(df).select(SEQ, "app_name", text_col), n)
    numbered = picked.agg(F.array_sort(F.collect_list(F.struct(
        F.col(SEQ).alias("s"),
        F.concat(F.col("app_name"), F.lit(fv.EVIDENCE_SUFFIX)).alias("source"),
        F.substring(text_col, 1, width).alias("text")))).alias("items"))
    return numbered.select(F.posexplode("items")).select(
        (F.col("pos") + 1).alias("evidence_no"), "col.source", "col.text")


def latest_candidates(df: DataFrame, n: int = 50) -> DataFrame:
    """Reviews to answer, newest first."""
    return drop_blank(df, "clean_text").orderBy(F.col("date").desc_nulls_last(), SEQ).limit(n)


def priority_candidates(df: DataFrame, rules: IssueRules, n: int = 50, pool: int = 400) -> DataFrame:
    """The newest ``pool`` reviews by severity, then low rating, then date.

    Severity is computed for the pool only; that choice is part of the result.
    """
    tagged = issues.classify(latest_candidates(df, pool), rules)
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).when(
        F.col("severity") == "low", 2).otherwise(3)
    return tagged.withColumn("severity_rank", rank).orderBy(
        "severity_rank", F.col("rating").asc_nulls_last(), F.col("date").desc_nulls_last(), SEQ).limit(n)
