"""Reply drafts, model-response merge, reply scoring and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reviewloom.functions import fixed_values as fv
from reviewloom.functions import labels as lb
from reviewloom.functions import text as tx
from reviewloom.functions.rules import IssueRules, ReplyPolicy
from reviewloom.functions.sampling import order_key
from reviewloom.operators import issues
from reviewloom.operators import search
from reviewloom.operators.cleaning import SEQ

# A flag is read as text: what is neither absent nor a plain false asks for review.
RESPONSE_SCHEMA = "reply_draft string, reply_type string, needs_human_review string"

# Own wording; pass any text with the same placeholders instead.
DEFAULT_PROMPT = """Draft an answer to a public app review. It is a draft: a person checks it before use.
app: {app_name}
review: {review}
sentiment: {sentiment}
issues: {issue_types}
severity: {severity}
kind of reply: {reply_type}
tone: {tone}
Never write: {banned_phrases}
Contact text when one is needed: {contact_guidance}
Operator guidance: {extra_guidance}
Answer with one JSON object: reply_draft, reply_type, needs_human_review."""


def serving_sentiment(rating: Column) -> Column:
    """Sentiment given to the reply step: training label, neutral without a rating."""
    return F.coalesce(lb.weak_label_train(rating), F.lit("neutral"))


def choose_reply(classified: DataFrame, policy: ReplyPolicy) -> DataFrame:
    """Adds sentiment, reply_type and the forced-review flags."""
    base = classified.withColumns({
        "sentiment": serving_sentiment(F.col("rating")),
        "_norm": tx.normalize(F.col("clean_text")),
    })
    return base.withColumns({
        "reply_type": policy.reply_type(F.col("severity"), F.col("sentiment")),
        "force_flags": policy.force_review_flags(F.col("_norm"), F.col("severity"), F.col("issue_types")),
    }).drop("_norm")


def with_safety(df: DataFrame, policy: ReplyPolicy, reply: str = "reply_draft",
                out: str = "safety_flags") -> DataFrame:
    text = F.coalesce(F.col(reply), F.lit(""))
    flagged = df.withColumn("_reply_norm", tx.normalize(text))
    return flagged.withColumn(out, policy.safety_flags(text, F.col("_reply_norm"))).drop("_reply_norm")


def rule_drafts(classified: DataFrame, policy: ReplyPolicy, guidance: str = "") -> DataFrame:
    """Template draft per review with safety flags, review need and the reason text.

    Where an operator's ``guidance`` is set, the reason says that only a model would follow it.
    """
    chosen = choose_reply(classified, policy)
    drafted = with_safety(
        chosen.withColumn("reply_draft", policy.draft(F.col("reply_type"), F.col("app_name"))), policy)
    forced = F.size("force_flags") > 0
    by_type = policy.type_needs_review(F.col("reply_type"))
    unsafe = F.size("safety_flags") > 0
    parts = tx.flag_array([
        (forced, F.concat(F.lit(fv.REASON_FORCED_RULE), F.array_join("force_flags", "; "))),
        (by_type, F.replace(F.lit(fv.REASON_TYPE), F.lit("{type}"), F.col("reply_type"))),
        (unsafe, F.concat(F.lit(fv.REASON_UNSAFE), F.array_join("safety_flags", ", "))),
    ])
    text = F.array_join(parts, " / ")
    return drafted.withColumns({
        "needs_human_review": forced | by_type | unsafe,
        "reason": F.concat(F.lit(fv.RULE_PREFIX),
                           F.when(F.length(text) > 0, text).otherwise(fv.REASON_RULE_NONE),
                           F.lit(fv.REASON_GUIDANCE if guidance.strip() else "")),
    })


def parse_response(raw: Column) -> Column:
    """Model answer as a struct. The whole text is tried first, then its first '{' to last '}';
    fields fall through one by one because a malformed text gives a struct of nulls."""
    whole = F.from_json(F.when(F.trim(raw).startswith("{"), raw), RESPONSE_SCHEMA)
    list_like = F.trim(raw).startswith("[")
    braces = F.from_json(F.when(~list_like, F.regexp_extract(raw, r"(?s)\{.*\}", 0)), RESPONSE_SCHEMA)
    field = lambda name: F.coalesce(whole[name], braces[name])
    flag = field("needs_human_review")
    return F.struct(field("reply_draft").alias("reply_draft"), field("reply_type").alias("reply_type"),
                    F.when(flag.isNotNull(), ~F.lower(flag).isin("false", "")).alias("needs_human_review"))


def merge_responses(classified: DataFrame, policy: ReplyPolicy, response: str = "response",
                    guidance: str = "") -> DataFrame:
    """Drafts from a table of raw model answers; an unusable answer falls back to the rule draft.

    Rows without an answer (null) get the plain rule draft; a blank or malformed answer gets it with
    an error note.
    """
    ruled = rule_drafts(classified, policy).withColumn("_m", parse_response(F.col(response)))
    draft = tx.unicode_trim(F.coalesce(F.col("_m.reply_draft"), F.lit("")))
    rows = ruled.withColumn("_draft", draft)
    rows = with_safety(rows, policy, "_draft", "_flags")
    usable = F.length("_draft") > 0
    forced = F.size("force_flags") > 0
    unsafe = F.size("_flags") > 0
    asked = F.coalesce(F.col("_m.needs_human_review"), F.lit(False))
    parts = F.array_join(tx.flag_array([
        (forced, F.concat(F.lit(fv.REASON_FORCED_MODEL), F.array_join("force_flags", "; "))),
        (unsafe, F.concat(F.lit(fv.REASON_UNSAFE), F.array_join("_flags", ", "))),
        (asked, F.lit(fv.REASON_MODEL_FLAG)),
    ]), " / ")
    model_reason = F.concat(
        F.lit(fv.MODEL_PREFIX), F.when(F.length(parts) > 0, parts).otherwise(fv.REASON_MODEL_NONE))
    rule_reason = F.when(F.col(response).isNull(), F.concat("reason", F.lit(fv.REASON_GUIDANCE if guidance.strip() else ""))).otherwise(
        F.concat("reason", F.lit(fv.REASON_MODEL_ERROR + "reply_draft")))
    by_type = policy.type_needs_review(F.col("reply_type"))
    others = [c for c in ruled.columns
              if c not in ("_m", "reply_draft", "reply_type", "safety_flags", "needs_human_review", "reason")]
    return rows.select(
        *others,
        F.when(usable, F.col("_draft")).otherwise(F.col("reply_draft")).alias("reply_draft"),
        F.when(usable, F.coalesce("_m.reply_type", "reply_type")).otherwise(
            F.col("reply_type")).alias("reply_type"),
        F.when(usable, F.col("_flags")).otherwise(F.col("safety_flags")).alias("safety_flags"),
        F.when(usable, forced | by_type | asked | unsafe).otherwise(
            F.col("needs_human_review")).alias("needs_human_review"),
        F.when(usable, model_reason).otherwise(rule_reason).alias("reason"))


def reply_prompts(classified: DataFrame, policy: ReplyPolicy, template: str = DEFAULT_PROMPT,
                  guidance: str = "") -> DataFrame:
    """Prompt text per review: the input of an offline batch of model calls."""
    chosen = choose_reply(classified, policy)
    contact = F.when(F.col("reply_type") == "security_sensitive", policy.contact_security).otherwise(
        policy.contact_default)
    # The review text is filled in last: a placeholder inside a review stays as written.
    values = [
        ("app_name", F.col("app_name")), ("sentiment", F.col("sentiment")),
        ("issue_types", F.array_join("issue_types", ", ")), ("severity", F.col("severity")),
        ("reply_type", F.col("reply_type")), ("tone", F.lit(policy.tone)),
        ("banned_phrases", F.lit(", ".join(policy.banned_phrases))), ("contact_guidance", contact),
        ("extra_guidance", F.lit(guidance.strip() or fv.NO_GUIDANCE)), ("review", F.col("clean_text")),
    ]
    prompt = F.lit(template)
    for name, value in values:
        prompt = F.replace(prompt, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return chosen.withColumn("prompt", prompt)


def draft_batch(df: DataFrame, rules: IssueRules, policy: ReplyPolicy, n: int | None = None) -> DataFrame:
    """Drafts for the first n (or all) reviews; classified first where tags are missing."""
    rows = search.first_rows(df, n) if n is not None else df
    if not {"issue_types", "severity"} <= set(rows.columns):
        rows = issues.classify(rows, rules)
    drafts = merge_responses(rows, policy) if "response" in rows.columns else rule_drafts(rows, policy)
    return drafts.select(
        SEQ, "app_name", "rating", F.col("clean_text").alias("review_text"), "sentiment",
        "issue_types", "severity", "reply_draft", "reply_type", "safety_flags",
        "needs_human_review", "reason")


def draft_batch_stats(drafts: DataFrame) -> DataFrame:
    model = F.startswith("reason", F.lit(fv.MODEL_PREFIX.strip()))
    return drafts.agg(
        F.count(F.lit(1)).alias("total_replies"), F.count_if(model).alias("model_replies"),
        F.count_if(~model).alias("fallback_replies"),
        F.count_if(F.contains("reason", F.lit(fv.REASON_MODEL_ERROR.strip()))).alias("error_replies"),
        F.count_if("needs_human_review").alias("needs_review"))


def _salts(reviews: DataFrame, digest: Column, hot_rows: int) -> Column:
    """Number of salts per text digest, one unless its measured share of the reviews is large.

    Only digests with a thousandth of all rows or more, and over ``hot_rows`` of them, are listed,
    so the map has a thousand entries at most.
    """
    total = reviews.agg(F.count(F.lit(1))).scalar()
    counts = reviews.select(digest.alias("_h")).filter("_h IS NOT NULL").groupBy("_h").agg(F.count(F.lit(1)).alias("n"))
    hot = counts.filter((F.col("n") * 1000 >= total) & (F.col("n") > hot_rows))
    listed = hot.agg(F.map_from_entries(F.collect_list(F.struct("_h", F.ceil(F.col("n") * 1000 / total).cast("int"))))).scalar()
    return F.coalesce(F.try_element_at(listed, F.col("_h")), F.lit(1))


def lookup_drafts(reviews: DataFrame, drafts: DataFrame, rules: IssueRules, hot_rows: int = 1000) -> DataFrame:
    """Severity and issue types of each review: from an earlier draft of the same text (the first
    one), else classified now.

    Copies of one text may be a large share of all reviews: digests with more than ``hot_rows`` of
    them are salted on the review side, by their measured counts, and their drafts - one row per
    text after the minimum - repeated. Only reviews without a draft are classified.
    """
    first = drafts.groupBy(F.sha2("review_text", 256).alias("_h")).agg(
        F.min_by(F.struct(F.array_join("issue_types", ", ").alias("t"), F.col("severity").alias("s")),
                 F.col(SEQ)).alias("_d"))
    digest = F.sha2("clean_text", 256)
    salts = _salts(reviews, digest, hot_rows)
    first = first.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    salted = reviews.withColumn("_h", digest).withColumn("_salt", F.pmod(F.xxhash64(SEQ), salts).cast("int"))
    joined = salted.join(first, ["_h", "_salt"], "left")
    # A null text costs nothing to classify, and nothing reads the outcome where a draft is there.
    open_text = joined.withColumn("_open", F.when(F.col("_d").isNull(), F.col("clean_text")))
    tagged = issues.classify(open_text, rules, "_open")
    return tagged.select(
        *[F.col(c) for c in reviews.columns],
        F.coalesce("_d.t", F.array_join("issue_types", ", ")).alias("issue_types"),
        F.coalesce("_d.s", "severity").alias("severity"),
        F.col("_d").isNotNull().alias("from_draft"))


def score_replies(drafts: DataFrame, policy: ReplyPolicy) -> DataFrame:
    """Adds safety flags, is_safe and the tone, safety and helpfulness scores (0..3)."""
    flagged = with_safety(drafts, policy, "reply_draft", "_flags")
    safe = F.size("_flags") == 0
    return flagged.withColumns({
        "safety_flags_eval": F.array_join("_flags", ", "),
        "is_safe": safe,
        "tone_score": policy.tone_score(F.col("reply_draft")),
        "safety_score": F.when(safe, 3).otherwise(0),
        "helpfulness_score": policy.helpfulness_score(F.col("reply_draft")),
    }).drop("_flags")


def evaluation_summary(scored: DataFrame, threshold: float = fv.QUALITY_THRESHOLD) -> DataFrame:
    row = scored.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_safe")).alias("violations"),
        F.avg("tone_score").alias("tone_avg"), F.avg("helpfulness_score").alias("helpfulness_avg"),
        F.avg("safety_score").alias("safety_avg"),
        (F.avg(F.col("tone_score") + F.col("helpfulness_score")) / 2).alias("quality_avg"))
    return row.withColumns({
        "safety_pass": F.col("violations") == 0,
        "quality_pass": F.coalesce(F.col("quality_avg") >= threshold, F.lit(False)),
    })


def reply_type_distribution(drafts: DataFrame) -> DataFrame:
    return drafts.groupBy("reply_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("needs_human_review").alias("needs_review"))


def score_histogram(scored: DataFrame) -> DataFrame:
    """(metric, score 0..3, n) with zeros, from one aggregate."""
    cells = [
        F.struct(F.lit(name).alias("metric"), F.lit(score).alias("score"),
                 F.count_if(F.col(f"{name}_score") == score).alias("n"))
        for name in ("tone", "safety", "helpfulness") for score in range(4)
    ]
    return scored.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def risk_cases(scored: DataFrame) -> DataFrame:
    """Unsafe drafts only."""
    wanted = [SEQ, "app_name", "rating", "review_text", "reply_draft", "reply_type",
              "safety_flags_eval", "needs_human_review"]
    return scored.filter(~F.col("is_safe")).select(*[c for c in wanted if c in scored.columns])


def evaluation_sample(scored: DataFrame, size: int = fv.EVAL_SAMPLE_SIZE, seed: int = fv.RANDOM_SEED) -> DataFrame:
    """All drafts when few; else an equal quota per reply type, topped up from the rest.

    Both parts rank at most ``size`` rows per task and type.
    """
    keyed = scored.withColumn("_key", order_key(F.col(SEQ), seed))
    totals = scored.agg(F.struct(F.count(F.lit(1)).alias("n"),
                                 F.count_distinct("reply_type").alias("types"))).scalar()
    w = W.partitionBy("reply_type").orderBy("_key")
    ranked = keyed.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= size)
    ranked = ranked.withColumn("_tot", totals)
    quota = F.greatest(F.lit(1), F.floor(F.lit(size) / F.col("_tot.types")))
    picked = ranked.filter((F.col("_tot.n") <= size) | (F.col("_rn") <= quota)).drop("_rn", "_tot")
    n_picked = picked.agg(F.count(F.lit(1))).scalar()
    rest = keyed.join(picked.select(SEQ), SEQ, "left_anti").orderBy("_key").limit(size)
    rest = rest.withColumn("_rn", F.row_number().over(W.orderBy("_key"))).filter(
        F.col("_rn") <= size - n_picked).drop("_rn")
    wanted = [SEQ, "app_name", "rating", "review_text", "reply_draft", "reply_type", "severity",
              "needs_human_review", "tone_score", "safety_score", "helpfulness_score"]
    cols = [c for c in wanted if c in scored.columns]
    return picked.select(*cols).unionByName(rest.select(*cols)).withColumn("human_comment", F.lit(""))
