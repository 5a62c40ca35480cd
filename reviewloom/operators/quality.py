"""Quality summary and quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions import fixed_values as fv
from reviewloom.functions import labels as lb
from reviewloom.functions import text as tx
from reviewloom.operators import cleaning as cl


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def quality_summary(raw: DataFrame, min_len: int = fv.MIN_REVIEW_LEN) -> DataFrame:
    """One row of cleaning counts and rates.

    Null and duplicate rates are over the input rows, the others over the output rows; masked rows
    are counted before the length filter. A blank text counts once.
    """
    present = tx.not_blank(F.col("review_text"))
    source = raw.agg(F.count(F.lit(1)).alias("n"), F.count_if(~present).alias("blank"))
    staged = cl.mask_and_clean(cl.with_typed_columns(cl.deduplicated(raw)))
    out = F.col("review_len") >= min_len
    # Lengths are few: one pre-aggregate by length carries every count and the quantile histogram.
    by_len = staged.groupBy("review_len").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("has_pii_masked").alias("masked"),
        F.count_if(F.col("date").isNull()).alias("date_fail"))
    totals = by_len.agg(
        F.sum("n").alias("kept"),
        F.coalesce(F.sum(F.when(out, F.col("n"))), F.lit(0)).alias("output_rows"),
        F.sum("masked").alias("pii_masked_rows"),
        F.coalesce(F.sum(F.when(out, F.col("masked"))), F.lit(0)).alias("needs_human_review_rows"),
        F.coalesce(F.sum(F.when(out, F.col("date_fail"))), F.lit(0)).alias("date_parse_failed_rows"),
        F.percentile(F.when(out, F.col("review_len")), F.array(F.lit(0.25), F.lit(0.75)),
                     F.col("n")).alias("q"))
    iqr = F.col("q")[1] - F.col("q")[0]
    low, high = F.greatest(F.lit(0.0), F.col("q")[0] - 1.5 * iqr), F.col("q")[1] + 1.5 * iqr
    fences = totals.select(F.struct(low.alias("low"), high.alias("high"))).scalar()
    outside = (F.col("review_len") < fences["low"]) | (F.col("review_len") > fences["high"])
    outliers = by_len.agg(F.coalesce(F.sum(F.when(out & outside, F.col("n"))), F.lit(0))).scalar()
    src = source.select(F.struct("n", "blank")).scalar()
    return totals.withColumns({"_s": src, "outlier_rows": outliers}).select(
        F.col("_s.n").alias("input_rows"),
        "output_rows",
        (F.col("_s.n") - F.col("output_rows")).alias("removed_rows"),
        F.col("_s.blank").alias("null_text_rows"),
        (F.col("_s.n") - F.col("_s.blank") - F.col("kept")).alias("duplicate_rows_removed"),
        (F.col("kept") - F.col("output_rows")).alias("too_short_rows_removed"),
        "pii_masked_rows", "needs_human_review_rows", "date_parse_failed_rows", "outlier_rows",
    ).withColumns({
        "null_text_rate": _ratio(F.col("null_text_rows"), F.col("input_rows")),
        "duplicate_rate": _ratio(F.col("duplicate_rows_removed"), F.col("input_rows")),
        "date_parse_fail_rate": _ratio(F.col("date_parse_failed_rows"), F.col("output_rows")),
        "pii_masked_rate": _ratio(F.col("pii_masked_rows"), F.col("output_rows")),
        "outlier_rate": _ratio(F.col("outlier_rows"), F.col("output_rows")),
    })


def duplicate_count(df: DataFrame, keys: list[str] = fv.DEDUPE_KEY) -> DataFrame:
    """One row: rows beyond the first of each key (missing key parts are equal)."""
    groups = df.groupBy(*cl.key_columns(keys)).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def quality_gate(df: DataFrame, own_app: str, min_total: int = fv.MIN_TOTAL_REVIEWS,
                 min_competitors: int = fv.MIN_COMPETITORS) -> DataFrame:
    """Seven rows (check_no, check_id, name, passed, detail).

    One pass: counts per (app, store, text digest) first, which folds copies on the map side, then
    per app, then in total. Distinct keys and apps come out as row counts of those levels.
    """
    missing = cl.missing_columns(df)
    names = [title.replace("{own}", own_app) for _, title in fv.GATE_CHECKS]
    if missing:
        total = df.agg(F.count(F.lit(1)).alias("n"))
        n = F.col("n")
        results = [(F.lit(False), F.lit(f"{fv.GATE_COLUMNS_MISSING}{missing}"))]
        results += [(F.lit(False), F.lit(fv.GATE_NO_DATA))] * 4
        results += [(n >= min_total, F.format_string("총 %d건", n)), (F.lit(False), F.lit(fv.GATE_NO_DATA))]
        return _check_rows(total, names, results)

    typed = cl.with_typed_columns(df)
    bad_rating = ~F.coalesce(F.col("rating").between(fv.RATING_MIN, fv.RATING_MAX), F.lit(False))
    by_key = typed.groupBy(*cl.key_columns(fv.DEDUPE_KEY)).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~tx.not_blank(F.col("review_text"))).alias("blank"),
        F.count("date").alias("dated"),
        F.count_if(bad_rating).alias("bad_rating"))
    by_app = by_key.groupBy(F.col("_k_app_name").alias("app")).agg(
        F.count(F.lit(1)).alias("keys"),
        *[F.sum(c).alias(c) for c in ("n", "blank", "dated", "bad_rating")])
    total = by_app.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "blank", "dated", "bad_rating", "keys")],
        F.coalesce(F.bool_or(F.col("app") == own_app), F.lit(False)).alias("has_own"),
        F.count_if(F.col("app") != own_app).alias("competitors"),
        F.count("app").alias("apps"))
    n = F.col("n")
    some = n > 0
    dup = n - F.col("keys")

    def rated(passed: Column, detail: Column) -> tuple[Column, Column]:
        return F.coalesce(some & passed, F.lit(False)), F.when(some, detail).otherwise(fv.GATE_NO_DATA)

    def pct(part: Column) -> Column:
        return lb.percent_text(part / n, 2)

    results = [
        (F.lit(True), F.lit(fv.GATE_COLUMNS_OK)),
        rated(F.col("blank") / n <= fv.MAX_NULL_RATE,
              F.format_string("결측률 %s (결측 %d건 / %d건)", pct(F.col("blank")), F.col("blank"), n)),
        rated(F.col("dated") / n >= fv.MIN_DATE_PARSE_RATE,
              F.format_string("성공률 %s (성공 %d건 / %d건)", pct(F.col("dated")), F.col("dated"), n)),
        rated(dup / n <= fv.MAX_DUP_RATE,
              F.format_string("중복률 %s (중복 %d건 / %d건)", pct(dup), dup, n)),
        rated(F.col("bad_rating") == 0,
              F.when(F.col("bad_rating") == 0, fv.GATE_RATING_OK).otherwise(
                  F.format_string("범위 이탈/결측 %d건", F.col("bad_rating")))),
        (n >= min_total, F.format_string("총 %d건", n)),
        rated(F.col("has_own") & (F.col("competitors") >= min_competitors),
              F.format_string("%s 포함=%s, 경쟁 앱 %d개 (전체 %d개)", F.lit(own_app),
                              F.when(F.col("has_own"), "True").otherwise("False"),
                              F.col("competitors"), F.col("apps"))),
    ]
    return _check_rows(total, names, results)


def _check_rows(total: DataFrame, names: list[str], results: list[tuple[Column, Column]]) -> DataFrame:
    rows = [
        F.struct(F.lit(i + 1).alias("check_no"), F.lit(fv.GATE_CHECKS[i][0]).alias("check_id"),
                 F.lit(names[i]).alias("name"), passed.alias("passed"), detail.alias("detail"))
        for i, (passed, detail) in enumerate(results)
    ]
    return total.select(F.inline(F.array(*rows)))


def gate_verdict(checks: DataFrame) -> DataFrame:
    return checks.agg(F.bool_and("passed").alias("passed"))
