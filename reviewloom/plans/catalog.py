"""Named queries over the test tables: one per operator, each on whole tables.

Results are flat (arrays joined, dates as text, floating sums rounded) so they compare by value.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions import fixed_values as fv
from reviewloom.functions import labels as lb
from reviewloom.functions import text as tx
from reviewloom.operators import aggregates as ag
from reviewloom.operators import cleaning as cl
from reviewloom.operators import daily as dl
from reviewloom.operators import evaluation as ev
from reviewloom.operators import grams as gr
from reviewloom.operators import increments as inc
from reviewloom.operators import insights as ins
from reviewloom.operators import issues as iss
from reviewloom.operators import quality as qu
from reviewloom.operators import replies as rp
from reviewloom.operators import sampling as sp
from reviewloom.operators import search as se
from reviewloom.operators import setops as so
from reviewloom.operators import terms as te
from reviewloom.plans import adapters as ad
from reviewloom.plans import sentiment as sm
from reviewloom.plans import topics as tp
from reviewloom.plans.stages import materialize
from reviewloom.sources import registry as rg
from reviewloom.sources import reviews as rv
from reviewloom.sources import sinks as sk

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RULES, POLICY, OWN, EV_OWN = ad.LATIN_RULES, ad.LATIN_POLICY, ad.DOC_OWN_APP, ad.EVENT_OWN_APP
SEQ, SRC = cl.SEQ, cl.SRC


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def rounded(df: DataFrame) -> DataFrame:
    """Every double to six digits."""
    return df.select(*[
        r6(f"`{n}`").alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return ad.document_reviews(spark, sf)


_SHARED: dict[tuple, object] = {}


def shared(kind: str, spark: SparkSession, sf: str, make: Callable[[], object]):
    """Made once per application and data folder, then used by every query on it."""
    key = (kind, spark.sparkContext.applicationId, sf)
    if key not in _SHARED:
        _SHARED[key] = make()
    return _SHARED[key]


def clean_docs(spark: SparkSession, sf: str) -> DataFrame:
    """The clean-review stage table that all analyses start from."""
    return shared("clean", spark, sf, lambda: materialize(cl.clean_reviews(docs(spark, sf)), "clean"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return ad.event_reviews(spark, sf)


def classified_docs(spark: SparkSession, sf: str) -> DataFrame:
    return iss.classify(clean_docs(spark, sf), RULES)


def scored_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return rp.score_replies(ad.conversation_drafts(spark, sf), POLICY)


# --- cleaning and quality -------------------------------------------------------------------

@query
def clean_reviews(spark, sf):
    """The whole cleaning chain, not the stage table."""
    return cl.clean_reviews(docs(spark, sf)).select(
        SEQ, "app_name", "store", "rating", day("date"), "review_text", "clean_text", "review_len",
        "has_pii_masked", "needs_human_review")


@query
def pii_flag_counts(spark, sf):
    return clean_docs(spark, sf).groupBy("has_pii_masked").agg(F.count(F.lit(1)).alias("n"))


@query
def keep_first_by_text(spark, sf):
    return cl.deduplicated(docs(spark, sf), ["review_text"]).select(SEQ, "app_name", "store")


@query
def quality_summary(spark, sf):
    return rounded(qu.quality_summary(docs(spark, sf)))


@query
def length_distribution(spark, sf):
    return cl.length_fences(clean_docs(spark, sf))


@query
def length_outliers(spark, sf):
    return cl.flag_length_outliers(clean_docs(spark, sf)).filter("len_outlier").select(SEQ, "review_len")


@query
def duplicate_count(spark, sf):
    return qu.duplicate_count(docs(spark, sf), ["review_text"])


@query
def quality_gate_documents(spark, sf):
    return qu.quality_gate(docs(spark, sf), OWN)


@query
def quality_gate_events(spark, sf):
    return qu.quality_gate(events(spark, sf), EV_OWN)


@query
def quality_gate_missing_column(spark, sf):
    return qu.quality_gate(docs(spark, sf).drop("version"), OWN)


@query
def quality_gate_verdict(spark, sf):
    return qu.gate_verdict(qu.quality_gate(events(spark, sf), EV_OWN))


@query
def clean_export(spark, sf):
    return cl.clean_export(clean_docs(spark, sf)).select(SEQ, "date", "store", "review_len")


# --- counts and facets ----------------------------------------------------------------------

@query
def value_counts_store(spark, sf):
    return ag.value_counts(docs(spark, sf), "store")


@query
def value_counts_app(spark, sf):
    return ag.value_counts(docs(spark, sf), "app_name")


@query
def facet_values(spark, sf):
    return ag.facet_values(docs(spark, sf))


@query
def date_span(spark, sf):
    return ag.date_span(events(spark, sf)).select(day("first_date"), day("last_date"))


@query
def distinct_apps(spark, sf):
    return ag.distinct_apps(docs(spark, sf))


@query
def other_apps(spark, sf):
    return so.other_apps(docs(spark, sf), OWN)


@query
def weak_label_dist_train(spark, sf):
    return ag.sentiment_distribution(docs(spark, sf), lb.weak_label_train(F.col("rating")))


@query
def weak_label_dist_serving(spark, sf):
    return ag.sentiment_distribution(docs(spark, sf), lb.weak_label_serving(F.col("rating")))


@query
def class_share(spark, sf):
    return rounded(ag.class_share(docs(spark, sf), lb.weak_label_train(F.col("rating"))))


# --- issue rules ----------------------------------------------------------------------------

@query
def classified_reviews(spark, sf):
    return classified_docs(spark, sf).select(
        SEQ, F.array_join("issue_types", ",").alias("issue_types"), "severity")


@query
def matched_keywords(spark, sf):
    return iss.matched_keywords(clean_docs(spark, sf).select(SEQ, "clean_text"), RULES)


@query
def matched_keywords_table(spark, sf):
    """A dictionary of thousands of words, made from the benchmark's texts; the type is the word's length."""
    word = F.explode(F.split(F.lower("text"), "[^\\p{L}]+")).alias("keyword")
    words = ad.table(spark, sf, "benchmark").select(word).filter(F.length("keyword") >= 5).distinct()
    keywords = words.select(F.concat(F.lit("length "), F.length("keyword")).alias("issue_type"), "keyword")
    return gr.keyword_matches(clean_docs(spark, sf).select(SEQ, "clean_text"), keywords)


@query
def severity_dist(spark, sf):
    return iss.severity_distribution(classified_docs(spark, sf))


@query
def top_issues_by_app(spark, sf):
    return iss.top_issues_by_app(clean_docs(spark, sf), RULES)


@query
def top_issues_by_period(spark, sf):
    return iss.top_issues_by_period(clean_docs(spark, sf), RULES)


@query
def top_issues_by_day(spark, sf):
    return iss.top_issues_by_period(clean_docs(spark, sf), RULES, 1, "yyyy-MM-dd")


@query
def top_issues_global(spark, sf):
    return iss.top_issues_global(clean_docs(spark, sf), RULES)


@query
def top_complaints_by_app(spark, sf):
    return iss.top_complaints(clean_docs(spark, sf), RULES)


@query
def complaint_text_roundtrip(spark, sf):
    text = ins.joined_complaints(iss.top_complaints(clean_docs(spark, sf), RULES))
    return ins.split_complaints(text)


@query
def csv_round_trip(spark, sf):
    """The clean rows written as CSV files and read back; multi-line and quoted texts survive."""
    path = f"{inc.base_folder(spark)}/csv-{uuid.uuid4().hex}"
    sk.export_csv(clean_docs(spark, sf).select(SEQ, "app_name", "store", "date", "review_len", "review_text"), path)
    back = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return back.select(F.col(SEQ).cast("long").alias(SEQ), "app_name", "store", "date", F.col("review_len").cast("int").alias("review_len"),
                       F.md5(F.col("review_text").cast("binary")).alias("text_md5"))


# --- app metrics ----------------------------------------------------------------------------

@query
def app_metrics(spark, sf):
    return rounded(ag.sorted_by_rating(ag.app_metrics(docs(spark, sf))))


@query
def recent_change(spark, sf):
    return rounded(ag.app_metrics(events(spark, sf), 7).select("app_name", "recent30d_rating_change"))


@query
def recent_change_default(spark, sf):
    return rounded(ag.app_metrics(events(spark, sf)).select("app_name", "recent30d_rating_change"))


@query
def rating_rank(spark, sf):
    return rounded(ins.rating_rank(ag.app_metrics(docs(spark, sf)), OWN))


@query
def feature_mention_rate(spark, sf):
    return rounded(ag.feature_mention_rates(clean_docs(spark, sf), ad.LATIN_FEATURES))


@query
def competitor_strengths(spark, sf):
    return rounded(ins.competitor_strengths(ag.app_metrics(docs(spark, sf)), OWN))


@query
def gap_insights(spark, sf):
    clean = clean_docs(spark, sf)
    return rounded(ins.gap_analysis(ag.app_metrics(clean), iss.top_complaints(clean, RULES), OWN))


@query
def worst_competitor_issue(spark, sf):
    return ins.worst_competitor_issue(iss.top_complaints(clean_docs(spark, sf), RULES), OWN)


@query
def benchmark_summary(spark, sf):
    return rounded(ins.benchmark_summary(clean_docs(spark, sf), RULES, ad.LATIN_FEATURES))


@query
def better_competitors(spark, sf):
    return rounded(ins.better_competitors(ag.app_metrics(docs(spark, sf)), OWN).select(
        "app_name", "avg_rating", "negative_ratio"))


@query
def app_mean_compare(spark, sf):
    return rounded(ag.app_mean_compare(events(spark, sf), EV_OWN, ["click", "view", "error"]))


@query
def kpi_row(spark, sf):
    return rounded(ag.kpi_row(docs(spark, sf).filter(F.col("app_name") == OWN)))


@query
def trend_daily(spark, sf):
    return rounded(ag.rating_trend(events(spark, sf)))


@query
def trend_monthly(spark, sf):
    return rounded(ag.rating_trend(docs(spark, sf)))


@query
def period_benchmark(spark, sf):
    return rounded(ag.period_benchmark(events(spark, sf), "2024-01-08", "2024-01-21"))


@query
def period_filter_next_day(spark, sf):
    rows = ag.in_period(events(spark, sf), "2024-01-08", "2024-01-21", include_next_day=True)
    return rows.groupBy(day("date")).agg(F.count(F.lit(1)).alias("n"))


def _state(spark, sf, kind: str) -> DataFrame:
    rows = {"docs": docs, "events": events}[kind]
    return shared(f"daily {kind}", spark, sf, lambda: materialize(dl.daily_state(rows(spark, sf)), f"daily-{kind}"))


@query
def app_metrics_state(spark, sf):
    return rounded(ag.sorted_by_rating(dl.app_metrics(_state(spark, sf, "docs"))))


@query
def recent_change_state(spark, sf):
    return rounded(dl.app_metrics(_state(spark, sf, "events"), 7).select("app_name", "recent30d_rating_change"))


@query
def kpi_row_state(spark, sf):
    return rounded(dl.kpi_row(_state(spark, sf, "docs").filter(F.col("app_name") == OWN)))


@query
def trend_daily_state(spark, sf):
    return rounded(dl.rating_trend(_state(spark, sf, "events")))


@query
def trend_monthly_state(spark, sf):
    return rounded(dl.rating_trend(_state(spark, sf, "docs")))


@query
def period_benchmark_state(spark, sf):
    return rounded(dl.period_benchmark(_state(spark, sf, "events"), "2024-01-08", "2024-01-21"))


# --- search, listings, display --------------------------------------------------------------

@query
def review_search(spark, sf):
    found = se.faceted_search(clean_docs(spark, sf), stores=["en", "de"], rating_min=2, rating_max=4,
                              keyword="TH(ing|er)[a-z]+")
    return found.select(SEQ, "app_name", "store", "rating")


@query
def review_search_literal(spark, sf):
    found = se.faceted_search(clean_docs(spark, sf), keyword="the th", literal=True)
    return found.select(SEQ, "rating")


def _text_index(spark, sf) -> DataFrame:
    return shared("text index", spark, sf, lambda: gr.text_index(clean_docs(spark, sf)))


@query
def review_search_indexed(spark, sf):
    found = gr.indexed_search(clean_docs(spark, sf), _text_index(spark, sf), "the TH[a-z]+ (on|of)",
                              stores=["en", "de"], rating_min=2, rating_max=4)
    return found.select(SEQ, "app_name", "store", "rating")


@query
def negative_listing(spark, sf):
    return se.negative_listing(clean_docs(spark, sf)).select(
        SEQ, "app_name", "rating", day("date"), "clean_text")


@query
def evidence_rows(spark, sf):
    return se.evidence(clean_docs(spark, sf))


@query
def display_view(spark, sf):
    rows = events(spark, sf).groupBy("app_name", "store").agg(
        F.max("date").alias("date"), F.count(F.lit(1)).alias("review_count"),
        ag.negative_share(F.col("rating")).alias("negative_ratio"))
    return ag.display_view(rows, ["app_name", "store", "date", "review_count", "negative_ratio"],
                           ["negative_ratio"], {"store": {"google_play": "구글플레이"}})


@query
def reply_candidates_latest(spark, sf):
    return se.latest_candidates(clean_docs(spark, sf)).select(SEQ, "app_name", day("date"))


@query
def reply_candidates_priority(spark, sf):
    return se.priority_candidates(clean_docs(spark, sf), RULES).select(
        SEQ, "severity", "rating", day("date"))


# --- set operations -------------------------------------------------------------------------

def _restored(spark, sf) -> DataFrame:
    """A second load of the documents that files everything under one store."""
    return docs(spark, sf).withColumn("store", F.lit("en"))


@query
def union_sources(spark, sf):
    both = so.union_sources(docs(spark, sf), events(spark, sf).drop("version"))
    return both.groupBy("app_name", "store").agg(F.count(F.lit(1)).alias("n"))


@query
def merge_reviews(spark, sf):
    merged = so.merge_reviews(docs(spark, sf), _restored(spark, sf))
    return merged.select(SEQ, "app_name", "store", "rating", F.col(SRC)[0].alias("source_no"))


@query
def overwrite_apply(spark, sf):
    return so.apply_new_reviews(docs(spark, sf), _restored(spark, sf), "overwrite").select(
        SEQ, "app_name", "store", "clean_text")


@query
def merge_apply(spark, sf):
    return so.apply_new_reviews(docs(spark, sf), _restored(spark, sf), "merge").select(
        SEQ, F.col(SRC)[0].alias("source_no"), "app_name", "store", "review_len", "has_pii_masked")


def _keyed_base(spark, sf) -> DataFrame:
    def make() -> DataFrame:
        name = f"review_base_{zlib.crc32(sf.encode())}"
        inc.write_base(inc.clean_keyed(docs(spark, sf)), name, buckets=8)
        return spark.table(name)
    return shared("keyed base", spark, sf, make)


@query
def merge_incremental(spark, sf):
    """merge_apply against a base that is already clean, bucketed and sorted by key."""
    return inc.merged(_keyed_base(spark, sf), _restored(spark, sf)).select(
        SEQ, F.col(SRC)[0].alias("source_no"), "app_name", "store", "review_len", "has_pii_masked")


@query
def collect_and_clean(spark, sf):
    """Three landed sources whose numbers collide, cleaned as one: the first source's row of a key stays."""
    d = docs(spark, sf)
    frames = [d.filter(F.col("rating").isNotNull()), d.filter(F.col("store") == "en"), _restored(spark, sf)]
    return cl.clean_reviews(rv.collect_all(frames)).select(
        SEQ, F.col(SRC)[0].alias("source_no"), "app_name", "store", "review_len")


@query
def rating_labels(spark, sf):
    """Training and serving labels of ratings far outside 1..5."""
    scale = F.element_at(F.array(*[F.lit(x) for x in (1.0, -3.5, 0.5, 1e11, 1e300)]), (F.col(SEQ) % 5 + 1).cast("int"))
    rated = events(spark, sf).withColumn("rating", F.col("rating") * scale)
    return rated.select(SEQ, lb.weak_label_train(F.col("rating")).alias("train"), lb.weak_label_serving(F.col("rating")).alias("serving"))


@query
def standard_columns(spark, sf):
    trimmed = docs(spark, sf).drop("source_url", "date")
    return so.to_standard_columns(trimmed).groupBy("app_name").agg(
        F.count("date").alias("dates"), F.count("source_url").alias("urls"),
        F.count("review_text").alias("texts"))


# --- tokens and terms -----------------------------------------------------------------------

@query
def tokens(spark, sf):
    toks = te.with_tokens(clean_docs(spark, sf))
    return toks.select(SEQ, F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@query
def token_filter(spark, sf):
    return te.min_token_filter(clean_docs(spark, sf), fv.TOPIC_MIN_TOKENS).select(SEQ, "n_tokens")


@query
def ngram_counts(spark, sf):
    return te.ngram_counts(clean_docs(spark, sf), 2)


@query
def app_top_terms(spark, sf):
    return rounded(te.app_top_terms(clean_docs(spark, sf)))


@query
def tfidf_terms(spark, sf):
    weights = te.tfidf(clean_docs(spark, sf), [], tx.topic_tokens, 1, 2, min_df=3, max_df=0.4, sublinear=True)
    return weights.groupBy("term").agg(
        F.count(F.lit(1)).alias("n_docs"), F.round(F.sum("weight"), 5).alias("weight"))


# --- replies --------------------------------------------------------------------------------

@query
def reply_type_choice(spark, sf):
    return rp.choose_reply(classified_docs(spark, sf), POLICY).select(SEQ, "sentiment", "severity", "reply_type")


@query
def forced_review(spark, sf):
    return rp.choose_reply(classified_docs(spark, sf), POLICY).select(
        SEQ, F.array_join("force_flags", "; ").alias("force_flags"))


@query
def rule_drafts(spark, sf):
    return rp.rule_drafts(classified_docs(spark, sf), POLICY).select(
        SEQ, "reply_draft", "reply_type", F.array_join("safety_flags", ", ").alias("safety_flags"),
        "needs_human_review", "reason")


@query
def draft_batch(spark, sf):
    return sk.flat_columns(rp.draft_batch(clean_docs(spark, sf), RULES, POLICY, 30))


@query
def reply_prompts(spark, sf):
    return rp.reply_prompts(classified_docs(spark, sf), POLICY).select(SEQ, "prompt")


def _answered(spark, sf) -> DataFrame:
    """Conversation pairs as reviews with a raw model answer: plain JSON, JSON inside other text,
    text without JSON, or none."""
    pairs = ad.conversation_drafts(spark, sf).withColumn("clean_text", F.col("review_text"))
    body = F.to_json(F.struct(
        "reply_draft", F.lit("thanks_positive").alias("reply_type"),
        (F.col("rating") >= 4).alias("needs_human_review")))
    case = F.pmod(F.col(SEQ) % 1000 + F.floor(F.col(SEQ) / 1000), F.lit(4))
    answer = (F.when(case == 0, body).when(case == 1, F.concat(F.lit("Here it is: "), body, F.lit(" done.")))
              .when(case == 2, F.concat(F.lit("no json "), F.col("reply_draft"))))
    base = pairs.select(SEQ, "app_name", "rating", "clean_text", answer.alias("response"))
    return iss.classify(base, RULES)


@query
def response_merge(spark, sf):
    return rp.merge_responses(_answered(spark, sf), POLICY).select(
        SEQ, "reply_draft", "reply_type", F.array_join("safety_flags", ", ").alias("safety_flags"),
        "needs_human_review", "reason")


@query
def draft_batch_stats(spark, sf):
    return rp.draft_batch_stats(rp.merge_responses(_answered(spark, sf), POLICY))


@query
def draft_lookup(spark, sf):
    """Drafts exist for the user texts of the conversations; all texts are looked up."""
    texts = ad.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias(SEQ), F.col("text").alias("clean_text"),
        (F.col("conv_id") % 5 + 1).cast("double").alias("rating"))
    drafts = ad.conversation_drafts(spark, sf).select(
        SEQ, "review_text", F.array(F.lit("drafted")).alias("issue_types"), "severity")
    return rp.lookup_drafts(texts, drafts, RULES).select(SEQ, "issue_types", "severity", "from_draft")


@query
def reply_safety(spark, sf):
    return scored_conversations(spark, sf).select(SEQ, "safety_flags_eval", "is_safe")


@query
def reply_scores(spark, sf):
    return scored_conversations(spark, sf).select(SEQ, "tone_score", "safety_score", "helpfulness_score")


@query
def reply_eval_avgs(spark, sf):
    return rounded(rp.evaluation_summary(scored_conversations(spark, sf)))


@query
def score_histogram(spark, sf):
    return rp.score_histogram(scored_conversations(spark, sf))


@query
def reply_type_dist(spark, sf):
    return rp.reply_type_distribution(ad.conversation_drafts(spark, sf))


@query
def risk_cases(spark, sf):
    return rp.risk_cases(scored_conversations(spark, sf))


@query
def eval_sample(spark, sf):
    return rp.evaluation_sample(scored_conversations(spark, sf)).select(
        SEQ, "reply_type", "tone_score", "safety_score", "helpfulness_score", "human_comment")


# --- samples and evaluation -----------------------------------------------------------------

@query
def review_sample(spark, sf):
    return sp.review_sample(clean_docs(spark, sf), rules=RULES)


@query
def stratified_pick(spark, sf):
    return sp.pick_per_stratum(docs(spark, sf), ["app_name", "store"], 2).select(SEQ, "app_name", "store")


@query
def manual_sample(spark, sf):
    return sp.manual_label_sample(sm.labelled_dataset(clean_docs(spark, sf))).select(
        SEQ, "star_label", "rating", "sentiment_manual", "issue_manual")


@query
def stratified_split(spark, sf):
    labelled = docs(spark, sf).withColumn("label", lb.weak_label_train(F.col("rating")))
    split = sp.stratified_split(labelled.filter(F.col("label").isNotNull()))
    return split.select(SEQ, "label", "is_test")


def _judged(spark, sf) -> DataFrame:
    """Star label against the human quality label."""
    human = ad.table(spark, sf, "labels").select(
        F.col("doc_id").alias(SEQ), F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("human"))
    return docs(spark, sf).join(human, SEQ).select(
        SEQ, lb.weak_label_train(F.col("rating")).alias("prediction"), F.col("human").alias("label"))


@query
def confusion_matrix(spark, sf):
    return ev.confusion_matrix(_judged(spark, sf))


@query
def macro_metrics(spark, sf):
    return rounded(ev.macro_metrics(_judged(spark, sf)))


@query
def human_label_rows(spark, sf):
    rows = docs(spark, sf).join(
        ad.table(spark, sf, "labels").select(F.col("doc_id").alias(SEQ), "quality"), SEQ, "left")
    manual = F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative").otherwise("")
    return sm.human_labelled(rows.withColumn("sentiment_manual", manual)).select(SEQ, "sentiment_manual")


@query
def majority_baseline(spark, sf):
    """The commonest training label for every test row of the exact split, scored."""
    labelled = docs(spark, sf).withColumn("label", lb.weak_label_train(F.col("rating")))
    split = sp.stratified_split(labelled.filter(F.col("label").isNotNull()).select(SEQ, "label"))
    train, test = split.filter(~F.col("is_test")), split.filter("is_test")
    return rounded(ev.macro_metrics(sm.majority_predictions(train, test), "label", "pred_label"))


@query
def score_selection(spark, sf):
    """Model selection over a score table made of the sources: each is a model, its share of rated rows the score."""
    scores = docs(spark, sf).groupBy(F.col("app_name").alias("model")).agg(F.avg(F.col("rating").isNotNull().cast("int")).alias("f1_macro"))
    scores = scores.withColumn("model_no", F.substring("model", 4, 9).cast("int"))
    return rounded(sm.select_model(scores, ["src0", "src1"], 0.03))


@query
def error_table(spark, sf):
    """Rows whose star label is not the human one, as a model's error table."""
    rows = docs(spark, sf).withColumn("clean_text", F.col("review_text")).join(_judged(spark, sf), SEQ)
    return sm.misclassified(rows.withColumnRenamed("prediction", "pred_label"))


def _assigned(spark, sf) -> tp.TopicModel:
    """Clean documents with a given topic each, one topic of eight left empty."""
    topic = (F.col(SEQ) % 7).cast("int")
    return tp.TopicModel(clean_docs(spark, sf).withColumn("topic_id", topic), None, [], 8, None)


@query
def topic_sizes(spark, sf):
    return rounded(tp.topic_sizes(_assigned(spark, sf)))


@query
def topic_shares(spark, sf):
    return rounded(tp.topic_metrics(_assigned(spark, sf)))


# --- models (no SQL counterpart) ------------------------------------------------------------

def _trained(spark, sf) -> sm.Trained:
    return shared("sentiment", spark, sf, lambda: sm.train_models(
        sm.labelled_dataset(clean_docs(spark, sf)), [sm.BASELINE, *sm.EXPERIMENTS]))


def _topics(spark, sf) -> tp.TopicModel:
    return shared("topics", spark, sf, lambda: tp.fit_topics(clean_docs(spark, sf), k=10))


@query
def sentiment_models(spark, sf):
    return rounded(_trained(spark, sf).scores)


@query
def model_selection(spark, sf):
    return rounded(sm.select_model(_trained(spark, sf).scores, [sm.MAJORITY_NAME, sm.BASELINE.name]))


@query
def misclassified(spark, sf):
    trained = _trained(spark, sf)
    return sm.misclassified(sm.predict(trained.models[trained.final], trained.test))


@query
def human_label_eval(spark, sf):
    """Every human-labelled review, judged by the selected model."""
    human = ad.table(spark, sf, "labels").select(
        F.col("doc_id").alias(SEQ),
        F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("sentiment_manual"))
    trained = _trained(spark, sf)
    model = trained.models[trained.final]
    return rounded(sm.evaluate_on_human_labels(model, clean_docs(spark, sf).join(human, SEQ)))


@query
def topic_summary(spark, sf):
    return tp.topic_summary(_topics(spark, sf))


@query
def topic_keywords(spark, sf):
    return rounded(tp.topic_keywords(_topics(spark, sf)))


@query
def representative_docs(spark, sf):
    return rounded(tp.representative_reviews(_topics(spark, sf)))


@query
def topic_metrics(spark, sf):
    return rounded(tp.topic_metrics(_topics(spark, sf)))


# --- sources and sinks ----------------------------------------------------------------------

@query
def play_store_normalise(spark, sf):
    """Documents written as store records, then normalised."""
    d = ad.table(spark, sf, "documents")
    stamp = F.date_format(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 250).cast("int")), "yyyy-MM-dd HH:mm:ss")
    line = F.to_json(F.struct(
        F.concat(F.lit("pkg."), "source").alias("app_id"), F.col("source").alias("app_name"),
        (F.col("doc_id") % 5 + 1).alias("score"), stamp.alias("at"), F.col("text").alias("content"),
        F.when(F.col("doc_id") % 3 == 0, "1.0").alias("reviewCreatedVersion")))
    parsed = d.select(F.col("doc_id").alias(SEQ), F.from_json(line, rv.PLAY_SCHEMA).alias("r")).select(SEQ, "r.*")
    return rv.normalize_play_records(parsed).drop(SEQ)


@query
def feed_normalise(spark, sf):
    """Documents written as feed pages of about 50 entries, then exploded and normalised."""
    d = ad.table(spark, sf, "documents")
    rated = F.struct((F.col("doc_id") % 5 + 1).cast("string").alias("label"))

    def lab(c: Column) -> Column:
        return F.struct(c.cast("string").alias("label"))

    entry = F.struct(
        rated.alias("im:rating"), lab(F.lit("2.0")).alias("im:version"),
        lab(F.lit("2024-05-01T10:00:00-07:00")).alias("updated"),
        lab(F.concat(F.lit("title "), F.col("lang"))).alias("title"), lab(F.col("text")).alias("content"))
    pages = d.groupBy("source", F.floor(F.col("doc_id") / 1000).cast("int").alias("page")).agg(
        F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("e")))).alias("es"))
    line = F.to_json(F.struct(
        F.col("source").alias("app_id"), F.col("source").alias("app_name"), "page",
        F.struct(F.transform("es", lambda x: x["e"]).alias("entry")).alias("feed")))
    parsed = pages.select(F.from_json(line, rv.FEED_SCHEMA).alias("r")).select("r.*")
    return rv.normalize_feed_pages(parsed, "kr", None).drop(SEQ)


@query
def store_csv_normalise(spark, sf):
    d = ad.table(spark, sf, "documents").select(
        F.col("doc_id").alias(SEQ), F.col("text").alias("review"),
        F.lit("2024-05-01 10:00").alias("date"), (F.col("doc_id") % 5 + 1).alias("rating"))
    return rv.normalize_store_csv(d, "my app")


@query
def manual_fill(spark, sf):
    """A table without apps or stores: the app is filled because it is blank everywhere."""
    d = ad.table(spark, sf, "documents").select(
        F.col("doc_id").alias(SEQ), F.col("text").alias("review_text"), F.lit(" ").alias("app_name"),
        F.when(F.col("lang") == "en", "google_play").otherwise("").alias("store"))
    return rv.normalize_manual(d, "my app").drop("review_text")


def _apps(spark, sf) -> DataFrame:
    """An app registry made of the document sources: only two-digit ones have a play-store id."""
    names = ad.table(spark, sf, "documents").select("source").distinct()
    return names.select(
        F.concat(F.lit(" "), "source", F.lit("  ")).alias("name"),
        F.when(F.length("source") > 4, F.concat(F.lit(" pkg."), "source")).alias("google_play"),
        F.substring("source", 4, 9).cast("long").alias("app_store"),
        (F.col("source") == OWN).alias("is_our_app"))


@query
def apps_dimension(spark, sf):
    return rg.clean_apps(_apps(spark, sf))


@query
def collection_report(spark, sf):
    requested = ad.table(spark, sf, "documents").select(F.col("source").alias("app")).union(
        ad.table(spark, sf, "events").select("event_type")).distinct()
    stores = F.when(F.col("store") == "en", "google_play").otherwise("app_store")
    loaded = docs(spark, sf).filter(F.col("rating").isNotNull()).withColumn("store", stores)
    return rg.collection_report(requested, _apps(spark, sf), loaded)


@query
def source_manifest(spark, sf):
    return rg.validated_manifest(rg.manifest_records(events(spark, sf), "2024-02-01T00:00:00+00:00"))


def _metric_history(spark, sf) -> DataFrame:
    return events(spark, sf).groupBy("app_name", "store", "date").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("app_name").alias("section"), F.concat(F.lit("rows_"), "store").alias("metric"),
        F.col("n").cast("string").alias("value"), F.date_format("date", "yyyy-MM-dd").alias("updated_at"))


@query
def metrics_latest(spark, sf):
    return sk.latest_metrics(_metric_history(spark, sf))


@query
def metrics_upsert(spark, sf):
    """Event metrics, with the own app's section replaced and one section per language added."""
    existing = sk.latest_metrics(_metric_history(spark, sf))
    own = events(spark, sf).filter(F.col("app_name") == EV_OWN).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(EV_OWN).alias("section"), F.lit("total").alias("metric"), F.col("n").cast("string").alias("value"))
    langs = ag.value_counts(docs(spark, sf), "store").select(
        F.col("store").alias("section"), F.lit("reviews").alias("metric"), F.col("n").cast("string").alias("value"))
    new = own.unionByName(langs).withColumn("updated_at", F.lit("2024-02-01"))
    return sk.upsert_metrics(existing, new)


@query
def run_log_latest(spark, sf):
    """Conversations as runs: turns are replies, text length stands for the time, each assistant
    turn is an error entry."""
    turns = ad.table(spark, sf, "conversations")
    runs = turns.groupBy(F.col("conv_id").alias("run_id")).agg(
        F.count(F.lit(1)).alias("total"), (F.sum(F.length("text")) / 100).alias("elapsed_sec")).select(
        "run_id", F.concat(F.lit("kind"), (F.col("run_id") % 3).cast("string")).alias("kind"),
        F.lpad(F.col("run_id").cast("string"), 12, "0").alias("timestamp"), "total", "elapsed_sec")
    errors = turns.filter(F.col("role") == "assistant").select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("error_no"), F.col("text").alias("error"))
    return rounded(sk.flat_columns(sk.latest_runs(sk.run_entries(runs, errors))))


# --- reports --------------------------------------------------------------------------------

@query
def report_inputs(spark, sf):
    return rounded(ins.report_inputs(clean_docs(spark, sf), RULES, OWN))


@query
def report_rows(spark, sf):
    return ins.report_rows(clean_docs(spark, sf), RULES, OWN)


@query
def report_blocks(spark, sf):
    return ins.json_blocks(ins.report_inputs(clean_docs(spark, sf), RULES, OWN))


@query
def report_prompt(spark, sf):
    """The prompt over the whole corpus, with two sections in short form."""
    inputs = ins.report_inputs(clean_docs(spark, sf), RULES, OWN)
    return ins.report_prompt(inputs, "{kpi} | {sentiment} | {topics} | {evidence}")


@query
def own_report_inputs(spark, sf):
    return rounded(ins.report_inputs(clean_docs(spark, sf), RULES, OWN, whole=False))


@query
def own_report_rows(spark, sf):
    return ins.report_rows(clean_docs(spark, sf), RULES, OWN, whole=False)


@query
def success_gate(spark, sf):
    gate = qu.gate_verdict(qu.quality_gate(events(spark, sf), EV_OWN)).scalar()
    f1 = ev.macro_metrics(_judged(spark, sf)).select("f1_macro").scalar()
    replies = rp.evaluation_summary(scored_conversations(spark, sf)).select(
        F.struct("safety_pass", "quality_pass")).scalar()
    total = docs(spark, sf).agg(F.count(F.lit(1)).alias("total_reviews"))
    facts = total.withColumns({"data_quality_pass": gate, "f1_macro": f1, "_r": replies}).select(
        "total_reviews", "data_quality_pass", "f1_macro", "_r.safety_pass", "_r.quality_pass")
    return ev.success_gate(facts)
