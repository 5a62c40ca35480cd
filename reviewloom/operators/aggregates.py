"""App metrics, trends, distributions and display rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions import fixed_values as fv
from reviewloom.functions import labels as lb
from reviewloom.functions import text as tx

def _rows() -> Column:
    return F.count(F.lit(1))


def negative_share(rating: Column) -> Column:
    """Share of ratings <= 2; rows without a rating count in the denominator."""
    return F.avg(F.when(lb.is_negative(rating), 1.0).otherwise(0.0))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(_rows().alias("n"))


def facet_values(df: DataFrame, columns: Sequence[str] = ("app_name", "store")) -> DataFrame:
    """Distinct values per facet, sorted."""
    facets = F.explode(F.array(*[
        F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    pairs = df.select(facets.alias("f")).select("f.facet", "f.value")
    return pairs.filter(F.col("value").isNotNull()).distinct().orderBy("facet", "value")


def date_span(df: DataFrame) -> DataFrame:
    return df.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def distinct_apps(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("app_name").alias("app_count"))


def app_metrics(df: DataFrame, window_days: int = 30) -> DataFrame:
    """Reviews, mean rating, negative share and recent change per app.

    The change is the mean of (ref - d, ref] minus the mean of (ref - 2d, ref - d], where ref is
    the newest date in the table, which enters as a scalar subquery.
    """
    ref = df.agg(F.max("date")).scalar()
    known = df.filter(F.col("app_name").isNotNull()).select("app_name", "rating", "date")
    age = F.datediff(ref, F.col("date"))
    recent = F.when(age.between(0, window_days - 1), F.col("rating"))
    previous = F.when(age.between(window_days, 2 * window_days - 1), F.col("rating"))
    return known.groupBy("app_name").agg(
        _rows().alias("review_count"),
        F.avg("rating").alias("avg_rating"),
        negative_share(F.col("rating")).alias("negative_ratio"),
        (F.avg(recent) - F.avg(previous)).alias("recent30d_rating_change"),
    )


def sorted_by_rating(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(F.col("avg_rating").desc_nulls_last(), "app_name")


def feature_mention_rates(df: DataFrame, features: Mapping[str, Sequence[str]] = fv.FEATURE_KEYWORDS,
                          text_col: str = "clean_text") -> DataFrame:
    """One column per feature: share of the app's reviews that mention it."""
    norm = df.filter(F.col("app_name").isNotNull()).select(
        "app_name", tx.normalize(F.col(text_col)).alias("_norm"))
    rates = [
        F.avg(tx.contains_any(F.col("_norm"), words).cast("double")).alias(f"feat_{name}_mention_rate")
        for name, words in features.items()
    ]
    return norm.groupBy("app_name").agg(*rates)


def sentiment_distribution(df: DataFrame, label: Column) -> DataFrame:
    return df.select(label.alias("sentiment")).filter(F.col("sentiment").isNotNull()).groupBy(
        "sentiment").agg(_rows().alias("n"))


def class_share(df: DataFrame, label: Column) -> DataFrame:
    """Label counts with their share of all labelled rows."""
    dist = sentiment_distribution(df, label)
    total = dist.agg(F.sum("n")).scalar()
    return dist.withColumn("share", F.col("n") / total)


def kpi_row(df: DataFrame) -> DataFrame:
    """Reviews, mean rating and negative share with their tone bands; one row, also for no reviews."""
    row = df.agg(
        _rows().alias("review_count"),
        F.coalesce(F.round(F.avg("rating"), 2), F.lit(0.0)).alias("avg_rating"),
        F.coalesce(negative_share(F.col("rating")), F.lit(0.0)).alias("negative_ratio"))
    return with_tones(row)


def with_tones(row: DataFrame) -> DataFrame:
    avg, neg = F.col("avg_rating"), F.col("negative_ratio")
    return row.withColumns({
        "avg_tone": F.when(avg >= 3.5, "ok").when(avg >= 2.5, "warn").otherwise("bad"),
        "negative_tone": F.when(neg >= 0.5, "bad").when(neg >= 0.3, "warn").otherwise("ok"),
    })


def trend_period(dated: DataFrame, max_daily_span: int) -> Column:
    """The day, or the month when the dates span more than ``max_daily_span`` days."""
    daily = dated.agg(F.datediff(F.max("date"), F.min("date")) <= max_daily_span).scalar()
    return F.when(daily, F.date_format("date", "yyyy-MM-dd")).otherwise(F.date_format("date", "yyyy-MM"))


def rating_trend(df: DataFrame, max_daily_span: int = 70) -> DataFrame:
    """Reviews and mean rating per day, or per month when the dates span more than 70 days."""
    dated = df.filter(F.col("date").isNotNull())
    return dated.groupBy(trend_period(dated, max_daily_span).alias("period")).agg(
        _rows().alias("review_count"), F.avg("rating").alias("avg_rating")).orderBy("period")


def app_mean_compare(df: DataFrame, base: str, competitors: Sequence[str]) -> DataFrame:
    """Mean rating of the base app and chosen competitors with their role."""
    chosen = df.filter(F.col("app_name").isin([base, *competitors]))
    return chosen.groupBy("app_name").agg(F.avg("rating").alias("avg_rating")).withColumn(
        "role", F.when(F.col("app_name") == base, "base").otherwise("competitor"))


def in_period(df: DataFrame, start: str, end: str, include_next_day: bool = False) -> DataFrame:
    """Reviews dated start..end, both included; undated reviews drop out.

    ``include_next_day`` also keeps the day after the end, as the dashboard filter does.
    """
    last = F.date_add(F.lit(end).cast("date"), 1) if include_next_day else F.lit(end).cast("date")
    return df.filter(F.col("date").between(F.lit(start).cast("date"), last))


def period_benchmark(df: DataFrame, start: str, end: str) -> DataFrame:
    """Reviews, mean rating and negative share per app within a period."""
    known = in_period(df, start, end).filter(F.col("app_name").isNotNull())
    return known.groupBy("app_name").agg(
        _rows().alias("review_count"), F.avg("rating").alias("avg_rating"),
        negative_share(F.col("rating")).alias("negative_ratio"))


def display_view(df: DataFrame, columns: Sequence[str], percent_columns: Sequence[str] = (),
                 value_maps: Mapping[str, Mapping[str, str]] | None = None,
                 headers: Mapping[str, str] = fv.COLUMN_DISPLAY) -> DataFrame:
    """Rows as shown to people: dates and percents as text, mapped values, localised headers."""
    value_maps = value_maps if value_maps is not None else {
        "store": fv.STORE_DISPLAY, "sentiment": fv.SENTIMENT_DISPLAY}
    types = dict(df.dtypes)
    out = []
    for name in columns:
        c = F.col(name)
        if types[name] in ("date", "timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd")
        elif name in percent_columns:
            c = lb.percent_text(c)
        elif name in value_maps:
            pairs = [F.lit(x) for kv in value_maps[name].items() for x in kv]
            c = F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)
        out.append(c.alias(name))
    return df.select(*out).withColumnsRenamed({c: headers[c] for c in columns if c in headers})
