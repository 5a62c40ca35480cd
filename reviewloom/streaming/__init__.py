"""Streams of raw reviews: row-wise cleaning and tagging, first row per key, and rating windows.

The row-wise steps hold no state, so the batch expressions run on ``readStream`` unchanged. The two
stateful steps keep state for ``delay`` of event time only: what is later than that is left to the
batch step over the landed table, which compares with all earlier rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions import fixed_values as fv
from reviewloom.functions.rules import IssueRules
from reviewloom.operators import cleaning as cl
from reviewloom.operators import issues

EVENT_TIME = "event_time"


def tag_stream(raw: DataFrame, rules: IssueRules | None = None) -> DataFrame:
    """Blank filter, typing, masking, clean text, length filter, issue types and severity."""
    typed = cl.with_typed_columns(cl.drop_blank(cl.require_columns(raw)))
    return issues.classify(cl.keep_long_enough(cl.mask_and_clean(typed)), rules or IssueRules())


def with_event_time(typed: DataFrame, delay: str) -> DataFrame:
    """Rows with a date, their time of day 0, and a watermark. Rows without a date have no event time and leave."""
    dated = typed.filter(F.col("date").isNotNull()).withColumn(EVENT_TIME, F.col("date").cast("timestamp"))
    return dated.withWatermark(EVENT_TIME, delay)


def first_per_key(typed: DataFrame, keys: list[str] = fv.DEDUPE_KEY, delay: str = "7 days") -> DataFrame:
    """One row per key among rows whose dates lie within ``delay`` of each other: the first to arrive.

    State is one digest per key, kept until the watermark has passed it. Null key parts are equal.
    """
    keyed = with_event_time(typed, delay).withColumns({f"_k{i}": c for i, c in enumerate(cl.key_columns(keys))})
    names = [f"_k{i}" for i in range(len(keys))]
    return keyed.dropDuplicatesWithinWatermark(names).drop(*names)


def rating_windows(typed: DataFrame, window: str = "1 day", delay: str = "7 days") -> DataFrame:
    """(period, review_count, avg_rating) per event-time window; in append mode a window comes once it is closed."""
    return with_event_time(typed, delay).groupBy(F.window(EVENT_TIME, window).alias("_w")).agg(
        F.count(F.lit(1)).alias("review_count"), F.avg("rating").alias("avg_rating")).select(
        F.date_format("_w.start", "yyyy-MM-dd").alias("period"), "review_count", "avg_rating")
