"""Ratings, dates and star-based sentiment labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom.functions import fixed_values as fv

DATE_FORMATS = (
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "yyyy.MM.dd",
    "yyyyMMdd", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-M-d",
)


def to_rating(c: Column) -> Column:
    """Number or null; text that is no number, and NaN, give null."""
    number = c.try_cast("double")
    return F.when(~F.isnan(number), number)


def to_review_date(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """First format that fits the whole text; null otherwise."""
    text = F.trim(c.cast("string"))
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])


def _three_way(r: Column) -> Column:
    return F.when(r <= fv.NEGATIVE_RATING_MAX, "negative").when(r == 3, "neutral").otherwise("positive")


def weak_label_train(rating: Column) -> Column:
    """Training label: rating truncated to an integer first; a missing rating has no label."""
    r = rating.cast("double")
    # Cutting off decimals moves no rating over 3 or 4, and a comparison fits any size of number.
    cut = F.when(r < fv.NEGATIVE_RATING_MAX + 1, "negative").when(r < 4, "neutral").otherwise("positive")
    return F.when(r.isNotNull() & ~F.isnan(r), cut)


def weak_label_serving(rating: Column) -> Column:
    """Serving label: not truncated; a missing rating counts as neutral."""
    return F.when(rating.isNull(), "neutral").otherwise(_three_way(rating))


def is_negative(rating: Column) -> Column:
    return F.coalesce(rating <= fv.NEGATIVE_RATING_MAX, F.lit(False))


def percent_text(ratio: Column, digits: int = 1) -> Column:
    """0.1234 -> '12.3%'. Rounded first, so the text never depends on the formatter's tie rule."""
    return F.when(ratio.isNotNull(), F.format_string(f"%.{digits}f%%", F.round(ratio * 100, digits)))
