"""Rule tags per review and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reviewloom.functions import labels as lb
from reviewloom.functions import text as tx
from reviewloom.functions.rules import IssueRules


def tag_issues(df: DataFrame, rules: IssueRules, text_col: str = "clean_text") -> DataFrame:
    """Adds ``issue_types``; the text is normalised once per row."""
    keep = [F.col(c) for c in df.columns]
    norm = tx.with_once(df, "_norm", tx.normalize(F.col(text_col)))
    matched = norm.select(*keep, "_norm", rules.matched_types(F.col("_norm")).alias("_matched"))
    return matched.select(*keep, "_norm", rules.or_other(F.col("_matched")).alias("issue_types"))


def classify(df: DataFrame, rules: IssueRules, text_col: str = "clean_text") -> DataFrame:
    """Adds ``issue_types`` and ``severity``."""
    return with_severity(tag_issues(df, rules, text_col), rules).drop("_norm")


def with_severity(tagged: DataFrame, rules: IssueRules) -> DataFrame:
    return tagged.withColumn(
        "severity", rules.severity(F.col("_norm"), F.col("rating"), F.col("issue_types")))


def issue_type_counts(df: DataFrame, rules: IssueRules, by: list[Column] | None = None,
                      text_col: str = "clean_text") -> DataFrame:
    """Reviews per issue type (and group), without the catch-all type."""
    by = by or []
    norm = df.select(*by, tx.normalize(F.col(text_col)).alias("_norm"))
    names = [c for c in norm.columns if c != "_norm"]
    exploded = norm.select(*names, F.explode(rules.matched_types(F.col("_norm"))).alias("issue_type"))
    return exploded.groupBy(*names, "issue_type").agg(F.count(F.lit(1)).alias("n"))


def top_per_group(counts: DataFrame, group: list[str], n: int, measure: str = "n",
                  tie: str = "issue_type", rank_name: str = "rank") -> DataFrame:
    """The n largest per group; equal values in name order. Input is already aggregated, and the
    rank limit is applied before the shuffle (window group limit)."""
    w = W.partitionBy(*group).orderBy(F.col(measure).desc(), F.col(tie))
    return counts.withColumn(rank_name, F.row_number().over(w)).filter(F.col(rank_name) <= n)


def top_complaints(df: DataFrame, rules: IssueRules, n: int = 5, text_col: str = "clean_text") -> DataFrame:
    """Top issue types per app on negative reviews."""
    negative = df.filter(lb.is_negative(F.col("rating")) & F.col("app_name").isNotNull())
    return top_per_group(
        issue_type_counts(negative, rules, [F.col("app_name")], text_col), ["app_name"], n)


def top_issues_by_app(df: DataFrame, rules: IssueRules, n: int = 5) -> DataFrame:
    known = df.filter(F.col("app_name").isNotNull())
    return top_per_group(issue_type_counts(known, rules, [F.col("app_name")]), ["app_name"], n)


def top_issues_by_period(df: DataFrame, rules: IssueRules, n: int = 5,
                         period_format: str = "yyyy-MM") -> DataFrame:
    dated = df.filter(F.col("date").isNotNull())
    period = F.date_format("date", period_format).alias("period")
    return top_per_group(issue_type_counts(dated, rules, [period]), ["period"], n)


def top_issues_global(df: DataFrame, rules: IssueRules, n: int = 10) -> DataFrame:
    return issue_type_counts(df, rules).orderBy(F.col("n").desc(), "issue_type").limit(n)


def severity_distribution(classified: DataFrame) -> DataFrame:
    return classified.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def matched_keywords(df: DataFrame, rules: IssueRules, text_col: str = "clean_text") -> DataFrame:
    """One row per (review, issue type, keyword found): containment against the dictionary compiled
    into the expression, so no review x keyword join is formed."""
    keep = [F.col(c) for c in df.columns if c != text_col]
    norm = df.select(*keep, tx.normalize(F.col(text_col)).alias("_norm"))
    pairs = [
        (F.col("_norm").contains(tx.normalize_word(w)), F.concat_ws("\t", F.lit(t), F.lit(w)))
        for t, words in rules.issue_types.items() for w in words
    ]
    found = norm.select(*keep, F.explode(tx.flag_array(pairs)).alias("_hit"))
    return found.select(*keep, F.split_part("_hit", F.lit("\t"), F.lit(1)).alias("issue_type"),
                        F.split_part("_hit", F.lit("\t"), F.lit(2)).alias("keyword"))
