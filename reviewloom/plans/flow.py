"""The whole analysis as one graph: raw reviews to summaries, drafts, report and verdict."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions import fixed_values as fv
from reviewloom.functions.rules import IssueRules, ReplyPolicy
from reviewloom.operators import aggregates as ag
from reviewloom.operators import cleaning as cl
from reviewloom.operators import evaluation as ev
from reviewloom.operators import insights as ins
from reviewloom.operators import issues as iss
from reviewloom.operators import quality as qu
from reviewloom.operators import replies as rp
from reviewloom.operators import terms as te
from reviewloom.plans import sentiment as sm
from reviewloom.plans.stages import materialize
from reviewloom.sources import sinks


@dataclass
class Analysis:
    """Lazy result frames over one stage table of classified clean reviews."""

    classified: DataFrame
    quality: DataFrame
    gate: DataFrame
    metrics: DataFrame
    complaints: DataFrame
    severity: DataFrame
    gaps: DataFrame
    benchmark: DataFrame
    top_terms: DataFrame
    topics: DataFrame | None
    drafts: DataFrame
    reply_scores: DataFrame
    report: DataFrame
    success: DataFrame


def analyse(raw: DataFrame, own_app: str, rules: IssueRules | None = None, policy: ReplyPolicy | None = None,
            features: Mapping[str, Sequence[str]] = fv.FEATURE_KEYWORDS, reply_rows: int | None = None, topics: DataFrame | None = None,
            trained: sm.Trained | None = None, stage_folder: str | None = None) -> Analysis:
    """Cleaning and classification run once, into a stage table; everything else fans out from it.

    ``topics`` (a topic summary) and ``trained`` (fitted sentiment models) are optional because they
    are iterative jobs; without models the F1 check of the verdict is not met.
    """
    rules, policy = rules or IssueRules(), policy or ReplyPolicy()
    classified = materialize(iss.classify(cl.clean_reviews(raw), rules), "classified", stage_folder)
    metrics = ag.app_metrics(classified)
    complaints = iss.top_complaints(classified, rules)
    top_terms = materialize(te.app_top_terms(classified, folder=stage_folder), "top-terms", stage_folder)
    gate = qu.quality_gate(classified, own_app)
    drafts = rp.draft_batch(classified, rules, policy, reply_rows)
    scored = rp.score_replies(drafts, policy)
    f1 = (F.lit(None).cast("double") if trained is None
          else trained.scores.filter(F.col("model") == trained.final).select("f1_macro").scalar())
    passes = rp.evaluation_summary(scored).select(F.struct("safety_pass", "quality_pass")).scalar()
    facts = classified.agg(F.count(F.lit(1)).alias("total_reviews")).withColumns({
        "data_quality_pass": qu.gate_verdict(gate).scalar(), "f1_macro": f1, "_r": passes,
    }).select("total_reviews", "data_quality_pass", "f1_macro", "_r.safety_pass", "_r.quality_pass")
    return Analysis(
        classified=classified, quality=qu.quality_summary(raw), gate=gate,
        metrics=ag.sorted_by_rating(metrics), complaints=complaints,
        severity=iss.severity_distribution(classified),
        gaps=ins.gap_analysis(metrics, complaints, own_app),
        benchmark=ins.benchmark_summary(classified, rules, features, top_terms=top_terms), top_terms=top_terms,
        topics=topics, drafts=drafts, reply_scores=scored,
        report=ins.report_rows(classified, rules, own_app, topics), success=ev.success_gate(facts))


def run_entry(analysis: Analysis, run_id: str, timestamp: str, elapsed_sec: float) -> DataFrame:
    """The run log's row for an analysis: replies drafted, seconds, and the first reasons that name a model error."""
    runs = analysis.drafts.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(run_id).alias("run_id"), F.lit("analysis").alias("kind"), F.lit(timestamp).alias("timestamp"), "total",
        F.lit(float(elapsed_sec)).alias("elapsed_sec"))
    failed = analysis.drafts.filter(F.contains("reason", F.lit(fv.REASON_MODEL_ERROR.strip())))
    errors = failed.select(F.lit(run_id).alias("run_id"), F.col(cl.SEQ).alias("error_no"), F.col("reason").alias("error"))
    return sinks.run_entries(runs, errors.orderBy("error_no").limit(10))
