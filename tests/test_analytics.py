import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewloom.functions import text as tx
from reviewloom.functions.rules import IssueRules
from reviewloom.operators import aggregates as ag
from reviewloom.operators import cleaning as cl
from reviewloom.operators import daily as dl
from reviewloom.operators import evaluation as ev
from reviewloom.operators import insights as ins
from reviewloom.operators import sampling as sp
from reviewloom.operators import search as se
from reviewloom.operators import terms as te
from reviewloom.plans.flow import analyse, run_entry

RULES = IssueRules()


@pytest.fixture(scope="module")
def typed(make_reviews):
    return lambda rows: cl.with_typed_columns(make_reviews(rows))


def test_app_metrics_and_windows(typed):
    df = typed([
        ("a", "s", "5", "2026-03-31", "t"), ("a", "s", "1", "2026-03-02", "t"), ("a", "s", "3", "2026-03-01", "t"),
        ("a", "s", None, "2026-03-15", "t"), ("b", "s", "2", "2026-03-30", "t"), (None, "s", "1", "2026-03-30", "t")])
    m = {r.app_name: r for r in ag.app_metrics(df).collect()}
    assert set(m) == {"a", "b"}
    assert m["a"].review_count == 4 and m["a"].avg_rating == 3.0 and m["a"].negative_ratio == 0.25
    # 31 March back 30 days starts on 2 March; 1 March belongs to the window before.
    assert m["a"].recent30d_rating_change == 0.0 and m["b"].recent30d_rating_change is None


def test_rank_uses_average_ties(spark):
    m = spark.createDataFrame([("a", 4.0), ("b", 4.0), ("c", 3.0), ("d", None)], "app_name string, avg_rating double")
    assert [ins.rating_rank(m, x).first().rating_rank for x in "abc"] == [1, 1, 3]
    assert ins.rating_rank(m, "a").first().app_count == 4
    assert ins.rating_rank(m, "d").count() == 0


def test_trend_grain(typed):
    near = [("a", "s", "4", f"2026-01-{d:02d}", "t") for d in (1, 1, 20)]
    assert [r.period for r in ag.rating_trend(typed(near)).collect()] == ["2026-01-01", "2026-01-20"]
    assert [r.period for r in ag.rating_trend(typed(near + [("a", "s", "4", "2026-03-13", "t")])).collect()] == [
        "2026-01", "2026-03"]
    assert len(ag.rating_trend(typed(near + [("a", "s", "4", "2026-03-12", "t")])).collect()) == 3


def test_kpi_and_period(typed):
    df = typed([("a", "s", "5", "2026-01-01", "t"), ("a", "s", "2", "2026-01-02", "t"), ("a", "s", "2", None, "t")])
    k = ag.kpi_row(df).first()
    assert (k.review_count, k.avg_rating, k.avg_tone, k.negative_tone) == (3, 3.0, "warn", "bad")
    empty = ag.kpi_row(df.filter("false")).first()
    assert (empty.review_count, empty.avg_rating, empty.negative_ratio, empty.negative_tone) == (0, 0.0, 0.0, "ok")
    assert ag.in_period(df, "2026-01-01", "2026-01-01").count() == 1
    assert ag.in_period(df, "2026-01-01", "2026-01-01", include_next_day=True).count() == 2


def test_gap_defaults_and_missing_own(spark):
    m = spark.createDataFrame([("own", 10, 4.0, 0.1), ("b", 5, 3.0, 0.5)],
                              "app_name string, review_count long, avg_rating double, negative_ratio double")
    c = spark.createDataFrame([("b", "속도", 3, 1), ("b", "오류", 3, 2)], "app_name string, issue_type string, n long, rank int")
    rows = ins.gap_analysis(m, c, "own").collect()
    kinds = Counter(r.kind for r in rows)
    assert kinds == {"competitor_strength": 1, "own_weakness": 1, "opportunity": 2}
    assert any(r.metric == "competitor_issue:속도" and r.value == 3 for r in rows)
    missing = ins.gap_analysis(m, c, "nobody").collect()
    assert [r.kind for r in missing] == ["error"]


def test_complaint_text_round_trip(spark):
    df = spark.createDataFrame([("a", "x:y:3 | z:2 | bad | w:q")], "app_name string, top_complaint_types string")
    assert {tuple(r) for r in ins.split_complaints(df).collect()} == {("a", "x:y", 3), ("a", "z", 2)}


def test_search_and_candidates(make_reviews):
    df = cl.clean_reviews(make_reviews([
        ("a", "s", "1", "2026-01-01", "해킹 당했어요 정말"), ("a", "s", "5", "2026-01-03", "정말 편리하고 최고입니다"),
        ("b", "t", "3", "2026-01-02", "Where is THE menu"), ("b", "t", None, None, "rating missing here")]))
    assert [r.ingest_seq for r in se.faceted_search(df, keyword="the m.nu").collect()] == [2]
    assert se.faceted_search(df, keyword="the m.nu", literal=True).count() == 0
    assert se.faceted_search(df, apps=["a"], rating_min=2).count() == 1
    assert [r.ingest_seq for r in se.latest_candidates(df).collect()] == [1, 2, 0, 3]
    assert [r.ingest_seq for r in se.priority_candidates(df, RULES).collect()] == [0, 2, 3, 1]
    assert [r.ingest_seq for r in se.priority_candidates(df, RULES, pool=2).collect()] == [2, 1]
    ev_rows = se.evidence(df, width=4).collect()
    assert [(r.evidence_no, r.source, r.text) for r in ev_rows] == [(1, "a 리뷰", "해킹 당")]


def brute_tfidf(docs, min_df, max_df, sublinear):
    def grams(t):
        toks = [x for x in t.lower().split() if len(x) >= 2]
        return toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])]
    counts = {i: Counter(grams(t)) for i, t in docs.items()}
    df = Counter(t for c in counts.values() for t in c)
    n = len(docs)
    out = {}
    for i, c in counts.items():
        w = {t: (1 + math.log(k) if sublinear else k) * (math.log((1 + n) / (1 + df[t])) + 1)
             for t, k in c.items() if min_df <= df[t] <= max_df * n}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.update({(i, t): x / norm for t, x in w.items()})
    return out


@pytest.mark.parametrize("sublinear", [False, True])
def test_tfidf_against_brute_force(spark, sublinear):
    rnd = random.Random(1)
    docs = {i: " ".join(rnd.choice(["aa", "bb", "cc", "dd", "ee", "x"]) for _ in range(12)) for i in range(30)}
    docs[29] = "aa aa aa"
    df = spark.createDataFrame([("app", i, t) for i, t in docs.items()], "app_name string, ingest_seq long, clean_text string")
    got = {(r.ingest_seq, r.term): r.weight for r in te.tfidf(
        df, ["app_name"], low=1, high=2, min_df=2, max_df=0.9, sublinear=sublinear).collect()}
    want = brute_tfidf(docs, 2, 0.9, sublinear)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_app_top_terms_needs_enough_texts(spark):
    rows = [("big", i, f"login fails w{i}") for i in range(8)] + [("big", 8 + i, f"slow w{i}{i}{i}") for i in range(9)]
    rows += [("small", 100 + i, "login fails") for i in range(4)]
    df = spark.createDataFrame(rows, "app_name string, ingest_seq long, clean_text string")
    top = te.app_top_terms(df).collect()
    assert {r.app_name for r in top} == {"big"}
    assert {r.term for r in top} == {"login", "fails", "login fails"}


def test_stratified_split_is_exact(spark):
    rows = [(i, "hot" if i % 10 < 7 else f"c{i % 3}") for i in range(1003)]
    df = spark.createDataFrame(rows, "ingest_seq long, label string")
    split = sp.stratified_split(df)
    assert split.count() == 1003
    sizes = Counter(l for _, l in rows)
    tests = {r.label: r.n for r in split.filter("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert tests == {k: round(v * 0.2) for k, v in sizes.items()}
    assert sp.stratified_split(df.repartition(7)).exceptAll(split).count() == 0


def test_rank_limit_comes_before_the_shuffle(spark):
    df = spark.range(1000).select(F.col("id").alias("ingest_seq"), (F.col("id") % 3).alias("g"))
    picked = sp.pick_per_stratum(df, ["g"], 5)
    assert picked.count() == 15
    assert "WindowGroupLimit" in picked._jdf.queryExecution().executedPlan().toString()


def test_macro_metrics_against_brute_force(spark):
    rnd = random.Random(2)
    labels = ["negative", "neutral", "positive"]
    rows = [(rnd.choice(labels), rnd.choice(labels[::2])) for _ in range(200)]
    df = spark.createDataFrame(rows, "label string, prediction string")
    m = ev.macro_metrics(df).first()
    f1s, ps, rs = [], [], []
    for lab in labels:
        tp = sum(t == p == lab for t, p in rows)
        t_n, p_n = sum(t == lab for t, _ in rows), sum(p == lab for _, p in rows)
        ps.append(tp / p_n if p_n else 0)
        rs.append(tp / t_n if t_n else 0)
        f1s.append(2 * tp / (t_n + p_n))
    assert abs(m.f1_macro - sum(f1s) / 3) < 1e-12
    assert abs(m.precision_macro - sum(ps) / 3) < 1e-12 and abs(m.recall_macro - sum(rs) / 3) < 1e-12
    cells = {(r.label, r.prediction): r.n for r in ev.confusion_matrix(df).collect()}
    assert len(cells) == 9 and cells == {(a, b): rows.count((a, b)) for a in labels for b in labels}
    only = ev.macro_metrics(df.filter("label = 'positive' and prediction = 'positive'")).first()
    assert only.f1_macro == 1.0


def test_success_gate_ignores_f1(spark):
    facts = spark.createDataFrame([(2000, True, 0.1, True, True)],
                                  "total_reviews long, data_quality_pass boolean, f1_macro double, safety_pass boolean, quality_pass boolean")
    got = {r.check_name: r.passed for r in ev.success_gate(facts).collect()}
    assert got["overall_pass"] and not got["sentiment_f1_target"]
    assert not {r.check_name: r.passed for r in ev.success_gate(facts.withColumn("quality_pass", F.lit(None).cast("boolean"))).collect()}["overall_pass"]


def test_flow_end_to_end(spark, make_reviews):
    texts = ["로그인이 안 되고 오류만 나요", "정말 편리하고 만족합니다", "송금 한도가 너무 낮아요", "메뉴가 복잡해서 불편합니다"]
    rows = [(["own", "b", "c", "d"][i % 4], "google_play", str(i * 7 % 5 + 1), f"2026-0{i % 3 + 1}-{i % 27 + 1:02d}",
             f"{texts[(i // 4) % 4]} {i}") for i in range(1200)]
    a = analyse(make_reviews(rows), "own")
    assert all(r.passed for r in a.gate.collect())
    assert a.drafts.count() == a.classified.count() == 1200
    assert {r.section for r in a.report.collect()} == {1, 2, 3, 4, 5, 6}
    assert {r.check_name for r in a.success.collect()} >= {"overall_pass"}
    assert a.quality.first().output_rows == 1200
    assert a.gaps.count() > 0 and a.severity.count() > 1 and a.metrics.count() == 4
    bench = {r.app_name: r for r in a.benchmark.collect()}
    words = {r.app_name for r in a.top_terms.collect()}
    assert len(bench) == 4 and words == {k for k, r in bench.items() if r.top_topic_keywords != "-"} and words
    assert a.topics is None
    run = run_entry(a, "r1", "2026-03-01T00:00:00", 600.0).first()
    assert (run.run_id, run.total, run.avg_sec_per_reply, run.errors) == ("r1", 1200, 0.5, [])
    a.classified.unpersist()


def test_first_rows_of_a_hot_group_meet_in_no_single_sort(spark):
    """Ranks are taken per (group, bucket) first, whatever k is, and give the same rows as one sort."""
    df = spark.range(5000).select(F.col("id").alias("ingest_seq"), F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("g"))
    for k in (3, 1500):
        picked = sp.pick_per_stratum(df, ["g"], k)
        plan = picked._jdf.queryExecution().executedPlan().toString()
        assert "_bucket" in plan
        keyed = sorted((r["g"], r["_key"], r["ingest_seq"]) for r in sp.with_key(df).collect())
        want = {g: {s for x, _, s in keyed if x == g and s in [t for y, _, t in keyed if y == g][:k]} for g in ("hot", "rare")}
        got = {g: {r["ingest_seq"] for r in picked.filter(F.col("g") == g).collect()} for g in ("hot", "rare")}
        assert got == want


@pytest.mark.parametrize("raw,usable", [('{"reply_draft": "hi"}', True), ('text {"reply_draft": "hi"} text', True), ('[{"reply_draft": "hi"}]', False), ('"hi"', False), ("", False)])
def test_only_objects_are_answers(spark, raw, usable):
    from reviewloom.operators import replies as rp
    parsed = spark.createDataFrame([(raw,)], "r string").select(rp.parse_response(F.col("r")).alias("m")).first().m
    assert (parsed.reply_draft == "hi") == usable


def test_guidance_note_and_flags_of_answers(make_reviews):
    from reviewloom.functions.rules import ReplyPolicy
    from reviewloom.operators import issues as iss
    from reviewloom.operators import replies as rp
    classified = iss.classify(cl.clean_reviews(make_reviews([("a", "s", "5", "2026-01-01", f"정말 편리하고 좋아요 {i}") for i in range(4)])), RULES)
    plain = rp.rule_drafts(classified, ReplyPolicy(), "be brief").first().reason
    assert plain.endswith(" | 추가 지침은 LLM 사용 시에만 반영(현재 fallback)") and "지침" not in rp.rule_drafts(classified, ReplyPolicy()).first().reason
    answers = F.element_at(F.array(F.lit('{"reply_draft": "ok", "needs_human_review": "yes"}'), F.lit('{"reply_draft": "ok", "needs_human_review": false}'),
                                   F.lit('{"reply_draft": "ok", "needs_human_review": true}'), F.lit(None)), (F.col("ingest_seq") + 1).cast("int"))
    got = {r.ingest_seq: r for r in rp.merge_responses(classified.withColumn("response", answers), ReplyPolicy(), guidance="x").collect()}
    assert [got[i].needs_human_review for i in range(3)] == [True, False, True] and "지침" in got[3].reason and "지침" not in got[0].reason


def test_hot_texts_are_salted_by_their_counts(spark, make_reviews):
    from reviewloom.operators import replies as rp
    texts = ["같은 글입니다 로그인 오류"] * 3000 + [f"다른 글 {i} 번입니다" for i in range(1500)]
    reviews = make_reviews([("a", "s", "1", "2026-01-01", t) for t in texts]).withColumn("clean_text", F.col("review_text"))
    drafts = reviews.filter("ingest_seq % 1000 = 0").withColumns({"issue_types": F.array(F.lit("x")), "severity": F.lit("low")})
    got = rp.lookup_drafts(reviews, drafts, RULES).groupBy("from_draft").count().collect()
    assert {r.from_draft: r["count"] for r in got} == {True: 3002, False: 1498}


def test_sketch_never_drops_a_frequent_term(spark):
    """Narrow sketches let rare terms through, but the weights stay those of the exact limits."""
    texts = [(i, "abc"[i % 3], " ".join(f"word{(i * k) % 37}" for k in range(1, 9)) + f" only{i}") for i in range(60)]
    df = spark.createDataFrame(texts, "ingest_seq long, app_name string, clean_text string")
    toks = df.select("app_name", "ingest_seq", tx.tokens(F.lower("clean_text")).alias("tokens"))
    shown = toks.select("app_name", F.explode(F.array_distinct(tx.terms(F.col("tokens"), 1, 2))).alias("term"))
    frequent = {tuple(r) for r in shown.groupBy("app_name", "term").count().filter("count >= 3").select("app_name", "term").collect()}
    for width, depth in ((64, 1), (256, 2), (1 << 14, 4)):
        keep = te.frequent_terms(toks, ["app_name"], 1, 2, 3, width=width, depth=depth)
        kept = {tuple(r) for r in shown.filter(keep(F.col("term"))).distinct().collect()}
        assert frequent <= kept
    assert len(kept) < 1.2 * len(frequent) < shown.distinct().count()
    rows = lambda **x: {(r.app_name, r.ingest_seq, r.term): round(r.weight, 9) for r in te.tfidf(df, ["app_name"], min_df=3, **x).collect()}
    with_sketch, without = rows(), rows(sketch=False)
    assert with_sketch == without and {k[::2] for k in with_sketch} == frequent


def test_rare_terms_leave_before_their_rows_are_shuffled(spark):
    df = spark.createDataFrame([(i, f"some words here {i}") for i in range(20)], "ingest_seq long, clean_text string")
    plan = te.tfidf(df, [], min_df=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("getbit") > plan.index("BroadcastHashJoin")  # the test sits below the join, next to the explode
    assert plan.count("hashpartitioning(ingest_seq") == 1 and "hashpartitioning(term" not in plan


def test_daily_state_gives_the_figures_of_the_reviews(spark, typed, tmp_path):
    rows = [(["a", "b", None][i % 3], "s", [None, "1", "2", "4", "5"][i % 5], f"2026-0{i % 2 + 1}-{i % 28 + 1:02d}" if i % 7 else None, "t") for i in range(300)]
    df, path = typed(rows), str(tmp_path / "state")
    same = lambda x, y: sorted(map(str, x.collect())) == sorted(map(str, y.collect()))

    def check(reviews, state):
        assert same(dl.app_metrics(state), ag.app_metrics(reviews)) and same(dl.kpi_row(state), ag.kpi_row(reviews))
        assert same(dl.rating_trend(state), ag.rating_trend(reviews)) and same(dl.rating_trend(state, 5), ag.rating_trend(reviews, 5))
        assert same(dl.period_benchmark(state, "2026-01-05", "2026-02-09"), ag.period_benchmark(reviews, "2026-01-05", "2026-02-09"))

    dl.refresh_days(df, path)
    check(df, dl.read_state(spark, path))
    more = df.unionByName(typed([("a", "s", "1", "2026-01-05", "late"), ("c", "s", "5", "2026-03-01", "new")]))
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "state").glob("date=*/*.parquet")}
    dl.refresh_days(more, path, ["2026-01-05", "2026-03-01"])
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "state").glob("date=*/*.parquet")}
    assert {f.parent.name for f in set(before.items()) ^ set(after.items()) for f in [f[0]]} == {"date=2026-01-05", "date=2026-03-01"}
    check(more, dl.read_state(spark, path))
    check(df.limit(0), dl.read_state(spark, str(tmp_path / "none")))
    halves = [dl.daily_state(more.filter(F.col("ingest_seq") % 2 == k)) for k in (0, 1)]
    check(more, dl.merge_states(*halves))


def test_terms_of_a_group_do_not_meet_in_one_task(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, "a" if i % 5 else "b", f"alpha beta{i % 4} gamma{i % 3}") for i in range(40)],
                               "ingest_seq long, app_name string, clean_text string")
    plans, kept = {}, te.materialize

    def watch(frame, name, folder=None):
        plans[name] = frame._jdf.queryExecution().executedPlan().toString()
        return kept(frame, name, folder)
    monkeypatch.setattr(te, "materialize", watch)
    top = te.app_top_terms(df, max_df=1.0, folder=str(tmp_path))
    assert not re.findall(r"hashpartitioning\(app_name#\d+, \d+\)", plans["vocabulary"])
    assert {r.app_name for r in top.collect()} == {"a", "b"}
