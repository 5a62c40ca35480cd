"""Review-shaped views over the general test tables, with a Latin-script dictionary for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.rules import IssueRules, ReplyPolicy
from reviewloom.operators.cleaning import SEQ

DOC_OWN_APP = "src0"
EVENT_OWN_APP = "purchase"

LATIN_RULES = IssueRules(
    issue_types={
        "login": ["ththha", "chlich", "ciónci"],
        "auth": ["thanth", "erung", "ciónes"],
        "speed": ["therhe", "enheit"],
        "error": ["thheti", "chkeit", "lement", "ciónas"],
        "benefit": ["theron", "nicht", "oument"],
        "transfer": ["thorth", "enlich"],
        "invest": ["thintion", "outre"],
        "ux": ["Than edble", "ouelle"],
        "security": ["thnder", "chsch", "ciónue"],
    },
    high_triggers=["thersh", "einsch", "ouier"],
    negative_signals=["thndly", "enach", "oueau", "ciónque"],
    positive_signals=["tioner", "der", "que"],
    risky_types=["login", "error", "security", "transfer"],
    complaint_types=["login", "auth", "speed", "error", "security", "transfer"],
    other="other",
)

LATIN_FEATURES = {
    "benefit": ["theron", "nicht"],
    "auth": ["thanth", "erung", "ciónes"],
    "transfer": ["thorth", "enlich"],
    "invest": ["thintion", "outre"],
    "design": ["thanedbl", "ouelle"],
    "event": ["thrend", "einung"],
}

LATIN_POLICY = ReplyPolicy(
    severity_to_type={
        "positive": "thanks_positive", "high": "security_sensitive", "medium": "apology_and_guidance",
    },
    templates={
        "thanks_positive": "Thank you. We keep improving {app}.",
        "apology_and_guidance": "We are sorry. Please contact support inside {app}. We will look into it.",
        "security_sensitive": "We are sorry for the worry. Please contact support inside {app}.",
        "fallback_general": "Thank you for writing. Please contact support inside {app}.",
    },
    reviewed_types=["security_sensitive"],
    force_severities=["high"],
    force_types=["security", "transfer", "error"],
    force_keywords=["thersh", "ein sch", "ciónue"],
    banned_phrases=["thble", "sich", "the ther"],
    safety_patterns={
        "personal_info_request": [["(thing|ein )", "(erin|mit)"]],
        "definitive_promise": [["(thre|den).{0,10}(tion|ver)"], [r"(que|der)(\s*die|\s*los)"]],
        "investment_advice": [["(ment|ing).{0,6}(the|la)"], ["(thst|ung).{0,10}(on|und)"]],
    },
    polite_pattern="(tion|ung|ment)",
    empathy_words=["the", "sich", "que"],
    action_words=["tion", "ver", "ment"],
    contact_default="Use the help page.",
    contact_security="Use the help page; never share a password.",
    tone="polite, 2~4 sentences",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents + labels as reviews: app = source, store = lang, rating from the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").hint("shuffle_hash")
    rating = (F.when(F.col("toxic") == 1, F.lit(1)).when(F.col("quality") == 0, 2)
              .when(F.col("quality") == 1, 3 + F.col("doc_id") % 3))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias(SEQ), F.col("source").alias("app_name"), F.col("lang").alias("store"),
        rating.cast("double").alias("rating"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 250).cast("int")).alias("date"),
        F.col("text").alias("review_text"), F.lit(None).cast("string").alias("version"),
        F.lit(None).cast("string").alias("source_url"))


def event_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as reviews: app = event type, rating from the id, text = properties."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias(SEQ), F.col("event_type").alias("app_name"),
        F.when(F.col("user_id") % 2 == 0, "google_play").otherwise("app_store").alias("store"),
        (F.col("event_id") % 5 + 1).cast("double").alias("rating"), F.col("ts").cast("date").alias("date"),
        F.col("props").alias("review_text"), F.lit(None).cast("string").alias("version"),
        F.lit(None).cast("string").alias("source_url"))


def conversation_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn after it, as a reply draft."""
    turns = table(spark, sf_dir, "conversations")
    user = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("review_text"))
    reply = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply_draft"))
    kinds = F.array(*[F.lit(t) for t in (
        "thanks_positive", "apology_and_guidance", "security_sensitive", "fallback_general")])
    return user.join(reply, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias(SEQ),
        F.concat(F.lit("app"), (F.col("conv_id") % 5).cast("string")).alias("app_name"),
        (F.col("conv_id") % 5 + 1).cast("double").alias("rating"), "review_text", "reply_draft",
        F.element_at(kinds, (F.col("conv_id") % 4 + 1).cast("int")).alias("reply_type"),
        F.when(F.col("conv_id") % 3 == 0, "high").otherwise("medium").alias("severity"),
        (F.col("conv_id") % 4 == 2).alias("needs_human_review"))
