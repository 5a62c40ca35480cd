"""Daily sums per app: a small table that every period figure is read from, refreshed by touched days.

State rows: app_name, date, n (reviews), rated (with a rating), stars (sum of ratings), negative (ratings of 2 or less).
Sums of different days add up, so a figure over any period, or over all days, is a sum of state rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions import labels as lb
from reviewloom.operators import aggregates as ag

SUMS = ["n", "rated", "stars", "negative"]
STATE = "app_name string, n long, rated long, stars double, negative long, date date"


def daily_state(reviews: DataFrame) -> DataFrame:
    """Sums per (app, day); reviews without an app or a day have rows of their own."""
    return reviews.groupBy("app_name", "date").agg(
        F.count(F.lit(1)).alias("n"), F.count("rating").alias("rated"), F.coalesce(F.sum("rating"), F.lit(0.0)).alias("stars"),
        F.count_if(F.coalesce(lb.is_negative(F.col("rating")), F.lit(False))).alias("negative"))


def merge_states(first: DataFrame, *others: DataFrame) -> DataFrame:
    """One state of several over different reviews."""
    out = first
    for s in others:
        out = out.unionByName(s)
    return out.groupBy("app_name", "date").agg(*[F.sum(c).alias(c) for c in SUMS])


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The state, or an empty one when there is none yet."""
    try:
        return spark.read.schema(STATE).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STATE)


def refresh_days(reviews: DataFrame, path: str, days: list[str] | None = None) -> None:
    """Writes the state of the given days anew from all their reviews; other days' files stay.

    ``days`` (yyyy-MM-dd) reach the review scan as a filter and a day is a partition of the state, so
    the work is that of the touched days. A day whose reviews are all gone must be deleted by the
    caller. Without ``days`` all days are written, those without a date too.
    """
    if days is not None:
        reviews = reviews.filter(F.col("date").isin([F.lit(d).cast("date") for d in days]))
    (daily_state(reviews).repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("date").parquet(path))


def _mean(where: Column | None = None) -> Column:
    part = (lambda c: F.col(c)) if where is None else (lambda c: F.when(where, F.col(c)))
    return F.try_divide(F.sum(part("stars")), F.sum(part("rated")))


def _negative() -> Column:
    return F.try_divide(F.sum("negative"), F.sum("n"))


def app_metrics(state: DataFrame, window_days: int = 30) -> DataFrame:
    """``aggregates.app_metrics`` from the state."""
    age = F.datediff(state.agg(F.max("date")).scalar(), F.col("date"))
    change = _mean(age.between(0, window_days - 1)) - _mean(age.between(window_days, 2 * window_days - 1))
    return state.filter(F.col("app_name").isNotNull()).groupBy("app_name").agg(
        F.sum("n").alias("review_count"), _mean().alias("avg_rating"), _negative().alias("negative_ratio"), change.alias("recent30d_rating_change"))


def kpi_row(state: DataFrame) -> DataFrame:
    """``aggregates.kpi_row`` from the state."""
    row = state.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("review_count"), F.coalesce(F.round(_mean(), 2), F.lit(0.0)).alias("avg_rating"),
                    F.coalesce(_negative(), F.lit(0.0)).alias("negative_ratio"))
    return ag.with_tones(row)


def rating_trend(state: DataFrame, max_daily_span: int = 70) -> DataFrame:
    """``aggregates.rating_trend`` from the state."""
    dated = state.filter(F.col("date").isNotNull())
    return dated.groupBy(ag.trend_period(dated, max_daily_span).alias("period")).agg(
        F.sum("n").alias("review_count"), _mean().alias("avg_rating")).orderBy("period")


def period_benchmark(state: DataFrame, start: str, end: str) -> DataFrame:
    """``aggregates.period_benchmark`` from the state: only the period's days are read."""
    known = ag.in_period(state, start, end).filter(F.col("app_name").isNotNull())
    return known.groupBy("app_name").agg(F.sum("n").alias("review_count"), _mean().alias("avg_rating"), _negative().alias("negative_ratio"))
