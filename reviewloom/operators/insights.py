"""Comparison of the own app with its competitors, benchmark table and report rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions import fixed_values as fv
from reviewloom.functions import labels as lb
from reviewloom.functions.rules import IssueRules
from reviewloom.operators import aggregates as ag
from reviewloom.operators import issues
from reviewloom.operators import search
from reviewloom.operators import terms


def own_value(metrics: DataFrame, own_app: str, column: str) -> Column:
    """One figure of the own app as a scalar subquery (null when the app is missing)."""
    return metrics.filter(F.col("app_name") == own_app).select(column).scalar()


def rating_rank(metrics: DataFrame, own_app: str) -> DataFrame:
    """The own app's place by mean rating: average rank of ties, then truncated.

    Counted against the own value; no ordering of all apps in one task.
    """
    rated = metrics.filter(F.col("avg_rating").isNotNull())
    own = own_value(metrics, own_app, "avg_rating")
    row = rated.agg(F.count_if(F.col("avg_rating") > own).alias("above"),
                    F.count_if(F.col("avg_rating") == own).alias("ties"))
    total = metrics.agg(F.count(F.lit(1))).scalar()
    return row.filter(F.col("ties") > 0).select(
        F.lit(own_app).alias("app_name"), own.alias("avg_rating"),
        F.floor(F.col("above") + (F.col("ties") + 1) / 2).cast("int").alias("rating_rank"),
        total.alias("app_count"))


def competitor_strengths(metrics: DataFrame, own_app: str) -> DataFrame:
    """(app_name, metric, value, own_value): competitors with a higher mean rating or a lower
    negative share. The own figures are scalars, so this is a plain filter."""
    others = metrics.filter(F.col("app_name") != own_app)

    def ahead(metric: str, better) -> DataFrame:
        own = own_value(metrics, own_app, metric)
        rows = others.select("app_name", F.lit(metric).alias("metric"), F.col(metric).alias("value"),
                             own.alias("own_value"))
        return rows.filter(better(F.col("value"), F.col("own_value")))

    return ahead("avg_rating", lambda v, o: v > o).unionByName(ahead("negative_ratio", lambda v, o: v < o))


def better_competitors(metrics: DataFrame, own_app: str, n: int = 3) -> DataFrame:
    own = own_value(metrics, own_app, "avg_rating")
    ahead = metrics.filter((F.col("app_name") != own_app) & (F.col("avg_rating") > own))
    return ahead.orderBy(F.col("avg_rating").desc(), "app_name").limit(n)


def worst_competitor_issue(complaints: DataFrame, own_app: str) -> DataFrame:
    """The issue type with most mentions over the competitors' top complaints (first in name order
    on a tie): one row, or none."""
    sums = complaints.filter(F.col("app_name") != own_app).groupBy("issue_type").agg(F.sum("n").alias("n"))
    return sums.orderBy(F.col("n").desc(), "issue_type").limit(1)


def gap_analysis(metrics: DataFrame, complaints: DataFrame, own_app: str) -> DataFrame:
    """Insight rows (kind, app_name, metric, value, reference_value).

    Kinds: competitor_strength, own_weakness, opportunity; the default texts where a kind is empty;
    a single 'error' row when the own app is not in the metrics.
    """
    num = "double"
    strengths = competitor_strengths(metrics, own_app).select(
        F.lit("competitor_strength").alias("kind"), "app_name", "metric",
        F.col("value").cast(num), F.col("own_value").cast(num).alias("reference_value"))
    weak = complaints.filter((F.col("app_name") == own_app) & (F.col("rank") <= 3)).select(
        F.lit("own_weakness").alias("kind"), "app_name", F.col("issue_type").alias("metric"),
        F.col("n").cast(num).alias("value"), F.col("rank").cast(num).alias("reference_value"))
    rank = rating_rank(metrics, own_app).select(
        F.lit("opportunity").alias("kind"), "app_name", F.lit("rating_rank").alias("metric"),
        F.col("rating_rank").cast(num).alias("value"), F.col("app_count").cast(num).alias("reference_value"))
    worst = worst_competitor_issue(complaints, own_app).select(
        F.lit("opportunity").alias("kind"), F.lit(None).cast("string").alias("app_name"),
        F.concat(F.lit("competitor_issue:"), F.col("issue_type")).alias("metric"),
        F.col("n").cast(num).alias("value"), F.lit(None).cast(num).alias("reference_value"))
    found = strengths.unionByName(weak).unionByName(rank).unionByName(worst)

    # Defaults and the error row hang on counts of the parts: one one-row frame.
    own_rows = metrics.filter(F.col("app_name") == own_app).agg(F.count(F.lit(1)).alias("own"))
    state = own_rows.withColumns({
        "s": strengths.agg(F.count(F.lit(1))).scalar(), "w": weak.agg(F.count(F.lit(1))).scalar()})

    def note(kind: str, text: str, cond: Column) -> Column:
        return F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(text).alias("metric")))

    has_own = F.col("own") > 0
    notes = state.select(F.explode(F.array_compact(F.array(
        note("competitor_strength", fv.NO_COMPETITOR_AHEAD, has_own & (F.col("s") == 0)),
        note("own_weakness", fv.NO_COMPLAINT_DATA, has_own & (F.col("w") == 0)),
        note("error", f"{own_app} 데이터 없음", ~has_own)))).alias("x"))
    notes = notes.select(
        "x.kind", F.lit(None).cast("string").alias("app_name"), "x.metric",
        F.lit(None).cast(num).alias("value"), F.lit(None).cast(num).alias("reference_value"))
    own_known = own_value(metrics, own_app, "app_name").isNotNull()
    return found.filter(own_known).unionByName(notes)


def joined_complaints(complaints: DataFrame) -> DataFrame:
    """Per app 't:n | t:n' in rank order (at most top-n entries per app)."""
    items = F.array_sort(F.collect_list(F.struct("rank", "issue_type", "n")))
    text = F.transform(items, lambda x: F.concat(x["issue_type"], F.lit(":"), x["n"].cast("string")))
    return complaints.groupBy("app_name").agg(F.array_join(text, " | ").alias("top_complaint_types"))


def joined_terms(top_terms: DataFrame) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return top_terms.groupBy("app_name").agg(
        F.array_join(F.transform(items, lambda x: x["term"]), " | ").alias("top_topic_keywords"))


def split_complaints(summary: DataFrame, column: str = "top_complaint_types") -> DataFrame:
    """'t:n | t:n' back to (app_name, issue_type, n); parts without a whole number are skipped."""
    parts = summary.select("app_name", F.explode(F.split(column, r"\|")).alias("part"))
    out = parts.select(
        "app_name", F.trim(F.regexp_extract("part", "^(.*):([^:]*)$", 1)).alias("issue_type"),
        F.trim(F.regexp_extract("part", "^(.*):([^:]*)$", 2)).try_cast("int").alias("n"))
    return out.filter(F.col("n").isNotNull())


def benchmark_summary(clean: DataFrame, rules: IssueRules,
                      features: Mapping[str, Sequence[str]] = fv.FEATURE_KEYWORDS,
                      top_n: int = 5, top_terms: DataFrame | None = None) -> DataFrame:
    """One row per app: metrics, feature rates, top complaints and top terms ('-' when none).

    All four inputs are one row per app already; the joins carry no review rows. ``top_terms`` are
    those of ``app_top_terms`` where they are known already.
    """
    metrics = ag.app_metrics(clean)
    rates = ag.feature_mention_rates(clean, features)
    complaints = joined_complaints(issues.top_complaints(clean, rules, top_n))
    keywords = joined_terms(terms.app_top_terms(clean, top_n) if top_terms is None else top_terms)
    out = metrics.join(rates, "app_name", "left").join(complaints, "app_name", "left").join(
        keywords, "app_name", "left")
    return out.na.fill("-", ["top_complaint_types", "top_topic_keywords"])


def report_inputs(clean: DataFrame, rules: IssueRules, own_app: str, whole: bool = True,
                  topics: DataFrame | None = None) -> DataFrame:
    """Everything a report needs as (section, item_no, name, value, text) rows.

    KPI figures (the total of all reviews; mean rating, negative share and rank of the own app),
    sentiment counts and evidence over all reviews, complaints of the own app, benchmark figures,
    and topics where given. ``whole=False`` is the own app's variant: its own counts and evidence.
    """
    own = clean.filter(F.col("app_name") == own_app)
    told = clean if whole else own
    none_d, none_s = F.lit(None).cast("double"), F.lit(None).cast("string")

    def rows(section: str, df: DataFrame, no: Column, name: Column, value: Column, text: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), no.cast("int").alias("item_no"),
                         name.alias("name"), value.cast("double").alias("value"), text.alias("text"))

    figures = ("review_count", "avg_rating", "negative_ratio")
    facts = ag.kpi_row(own)
    if whole:
        rank = rating_rank(ag.app_metrics(clean), own_app).select("rating_rank").scalar()
        facts = facts.withColumns({"total_reviews": clean.agg(F.count(F.lit(1))).scalar(), "rating_rank": rank})
        figures = ("total_reviews", "avg_rating", "negative_ratio", "rating_rank")
    kpi = facts.select(F.posexplode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in figures])))
    complaints = issues.top_complaints(own, rules)
    sentiment = (ag.sentiment_distribution(told.filter(F.col("rating").isNotNull()), lb.weak_label_train(F.col("rating")))
                 if whole else ag.sentiment_distribution(own, lb.weak_label_serving(F.col("rating"))))
    bench = ag.app_metrics(clean).select("app_name", F.posexplode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value"))
        for n in ("review_count", "avg_rating", "negative_ratio")])))
    listed = [] if topics is None else [rows("topics", topics, F.col("topic_id"), F.col("auto_label"), F.col("size"), none_s)]
    out = (
        rows("kpi", kpi, F.col("pos") + 1, F.col("col.name"), F.col("col.value"), none_s)
        .unionByName(rows("sentiment", sentiment, F.lit(None), F.col("sentiment"), F.col("n"), none_s))
        .unionByName(rows("complaints", complaints, F.col("rank"), F.col("issue_type"), F.col("n"), none_s))
        .unionByName(rows("benchmark", bench, F.col("pos") + 1, F.col("col.name"), F.col("col.value"),
                          F.col("app_name")))
        .unionByName(rows("evidence", search.evidence(told), F.col("evidence_no"), F.col("source"), none_d,
                          F.col("text")))
    )
    for part in listed:
        out = out.unionByName(part)
    return out


# Own wording; pass any text with the same placeholders instead.
REPORT_PROMPT = """Write a report on app reviews for the service team. Use only the figures and quotes below.
Figures: {kpi}
Sentiment: {sentiment}
Complaints: {complaints}
Topics: {topics}
Apps compared: {benchmark}
Quotes: {evidence}
"""
REPORT_BLOCKS = ("kpi", "sentiment", "complaints", "topics", "benchmark", "evidence")


def json_blocks(inputs: DataFrame) -> DataFrame:
    """(section, block): the rows of each section of ``report_inputs`` as a JSON list, empty ones too.

    Sections are bounded summaries; numbers have six decimals, so the text is the same everywhere.
    """
    item = F.struct(
        F.coalesce("item_no", F.lit(0)).alias("no"), F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce(F.col("value").cast("decimal(30,6)").cast("string"), F.lit("")).alias("value"),
        F.coalesce("text", F.lit("")).alias("text"))
    made = inputs.groupBy("section").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("block"))
    names = inputs.sparkSession.createDataFrame([(b,) for b in REPORT_BLOCKS], "section string")
    return names.join(made, "section", "left").select("section", F.coalesce("block", F.lit("[]")).alias("block"))


def report_prompt(inputs: DataFrame, template: str = REPORT_PROMPT) -> DataFrame:
    """One row: the prompt text for a report, its placeholders filled with the JSON blocks."""
    blocks = json_blocks(inputs).agg(F.map_from_entries(F.collect_list(F.struct("section", "block"))).alias("b"))
    prompt = F.lit(template)
    for name in REPORT_BLOCKS:  # quotes last: a placeholder inside them stays as written
        prompt = F.replace(prompt, F.lit("{" + name + "}"), F.element_at("b", name))
    return blocks.select(prompt.alias("prompt"))


def fill(template: str, **values: Column | str) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        v = F.lit(value) if isinstance(value, str) else value
        out = F.replace(out, F.lit("{" + name + "}"), v)
    return out


def report_rows(clean: DataFrame, rules: IssueRules, own_app: str,
                topics: DataFrame | None = None, whole: bool = True) -> DataFrame:
    """Rule-based report as (section, line_no, text) rows.

    Every part is a bounded summary (one row, or a top-n); ``topics`` adds the label line. Total,
    sentiment and evidence are of all reviews; ``whole=False`` takes those of the own app.
    """
    fmt = fv.REPORT_FORMATS
    own = clean.filter(F.col("app_name") == own_app)
    told = clean if whole else own
    metrics = ag.app_metrics(clean)
    own_m = metrics.filter(F.col("app_name") == own_app).withColumn("_total", told.agg(F.count(F.lit(1))).scalar())
    complaints = issues.top_complaints(own, rules)
    listed = complaints.agg(F.array_sort(F.collect_list(F.struct("rank", "issue_type", "n"))).alias("items"))

    def lines(section: int, df: DataFrame, line: Column, text: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), line.cast("int").alias("line_no"), text.alias("text"))

    avg_text = F.coalesce(F.format_string("%.2f", F.round("avg_rating", 2)), F.lit("N/A"))
    kpi = lines(1, own_m, F.lit(1), fill(
        fmt["summary_kpi"], total=F.col("_total").cast("string"), app=own_app, avg=avg_text,
        neg=lb.percent_text(F.col("negative_ratio"))))
    rank = lines(1, rating_rank(metrics, own_app), F.lit(2), fill(
        fmt["summary_rank"], rank=F.col("rating_rank").cast("string")))
    dist = ag.sentiment_distribution(told, lb.weak_label_train(F.col("rating"))).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "sentiment", "n"))).alias("d"))
    dist_text = F.array_join(F.transform(
        "d", lambda x: F.concat_ws(" ", x["sentiment"], x["n"].cast("string"))), ", ")
    sentiment = lines(1, dist, F.lit(3), fill(fmt["summary_sentiment"], dist=dist_text))
    all_c = F.array_join(F.transform("items", lambda x: F.concat(
        x["issue_type"], F.lit("("), x["n"].cast("string"), F.lit(")"))), ", ")
    summary = lines(1, listed, F.lit(4), fill(
        fmt["summary_complaints"],
        complaints=F.when(F.size("items") > 0, all_c).otherwise(fv.COMPLAINTS_NONE)))

    top3 = complaints.filter(F.col("rank") <= 3)
    none = listed.filter(F.size("items") == 0)
    causes = lines(2, top3, F.col("rank"), fill(
        fmt["cause"], type=F.col("issue_type"), n=F.col("n").cast("string")))
    causes = causes.unionByName(lines(2, none, F.lit(1), F.lit(fmt["cause_none"])))
    if topics is not None:
        labels = topics.orderBy("topic_id").limit(3).agg(
            F.array_sort(F.collect_list(F.struct("topic_id", "auto_label"))).alias("t"))
        labels = labels.filter(F.size("t") > 0)
        causes = causes.unionByName(lines(2, labels, F.lit(4), fill(
            fmt["cause_topics"], topics=F.array_join(F.transform("t", lambda x: x["auto_label"]), ", "))))
    words = F.array(*[F.lit(w) for w in fv.PRIORITY_WORDS])
    priorities = lines(3, top3, F.col("rank"), fill(
        fmt["priority"], prio=F.element_at(words, F.col("rank")), type=F.col("issue_type"),
        n=F.col("n").cast("string")))
    priorities = priorities.unionByName(lines(3, none, F.lit(1), F.lit(fmt["priority_none"])))

    ahead = better_competitors(metrics, own_app).agg(F.collect_list(F.struct(
        (-F.col("avg_rating")).alias("o"), "app_name", "avg_rating", "negative_ratio")).alias("b"))
    ahead = ahead.select(F.array_sort("b").alias("b"))
    each = ahead.select(F.posexplode("b")).select(
        (F.col("pos") + 1).alias("no"), "col.app_name", "col.avg_rating", "col.negative_ratio")
    better = lines(4, each, F.col("no"), fill(
        fmt["better"], comp=F.col("app_name"), avg=F.format_string("%.2f", F.round("avg_rating", 2)),
        neg=lb.percent_text(F.col("negative_ratio")), app=own_app))
    better = better.unionByName(lines(
        4, ahead.filter(F.size("b") == 0), F.lit(1), fill(fmt["better_none"], app=own_app)))
    better = better.unionByName(lines(4, ahead, F.lit(4), F.lit(fmt["better_note"])))

    ev = search.evidence(told)
    shown = lines(5, ev, F.col("evidence_no"), fill(
        fmt["evidence"], i=F.col("evidence_no").cast("string"), source=F.col("source"), text=F.col("text")))
    ev_count = ev.agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") == 0)
    shown = shown.unionByName(lines(5, ev_count, F.lit(1), F.lit(fmt["evidence_none"])))
    limits = listed.select(F.posexplode(F.array(*[F.lit(fmt[f"limit_{i}"]) for i in range(1, 5)])))
    limits = lines(6, limits, F.col("pos") + 1, F.col("col"))
    out = kpi
    for part in (rank, sentiment, summary, causes, priorities, better, shown, limits):
        out = out.unionByName(part)
    return out
