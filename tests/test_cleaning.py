from pyspark.sql import functions as F

from reviewloom.operators import cleaning as cl
from reviewloom.operators import quality as qu
from reviewloom.operators import setops as so
import pytest

OWN = "own"
APPS = [OWN, "rival a", "rival b", "rival c"]


def valid_rows(n=1200):
    return [(APPS[i % 4], ["app_store", "google_play"][i % 2], str(i % 5 + 1), f"2026-01-{i % 28 + 1:02d}",
             f"review text number {i}") for i in range(n)]


def checks(df, own=OWN):
    return {r.check_id: r.passed for r in qu.quality_gate(df, own).collect()}


def test_keep_first(make_reviews):
    df = make_reviews([
        ("a", "s", "1", "d", "same"), ("a", "s", "2", "d", "same"), ("b", "s", "3", "d", "same"),
        (None, "s", "4", "d", "same"), (None, "s", "5", "d", "same"), ("a", "s", "1", "d", "  ")])
    kept = cl.deduplicated(df)
    assert sorted(r.ingest_seq for r in kept.collect()) == [0, 2, 3]
    assert sorted(r.ingest_seq for r in cl.keep_first(kept).collect()) == [0, 2, 3]


def test_keep_first_against_brute_force_with_one_hot_text(make_reviews):
    rows = [("a", "s", "1", "d", "hot text" if i % 3 == 0 else f"text {i % 50}") for i in range(600)]
    first = {}
    for i, r in enumerate(rows):
        first.setdefault(r[4], i)
    got = {r.ingest_seq for r in cl.keep_first(make_reviews(rows)).collect()}
    assert got == set(first.values())


def test_clean_reviews(make_reviews):
    df = make_reviews([
        ("a", "s", "5", "2026-01-02", "Great app 👍 call 010-1234-5678"), ("a", "s", "x", "later", "so slow today"),
        ("a", "s", "1", "2026-01-02", "bad"), ("a", "s", "1", "2026-01-02", "")])
    rows = {r.ingest_seq: r for r in cl.clean_reviews(df).collect()}
    assert set(rows) == {0, 1}
    assert rows[0].clean_text == "Great app call [MASKED]" and rows[0].has_pii_masked and rows[0].needs_human_review
    assert rows[0].review_len == len(rows[0].clean_text) and str(rows[0].date) == "2026-01-02"
    assert rows[1].rating is None and rows[1].date is None and not rows[1].has_pii_masked


def test_cheap_filters_reach_the_scan_and_costly_ones_run_once(spark, make_reviews, tmp_path):
    make_reviews(valid_rows(20)).write.parquet(str(tmp_path / "r"))
    clean = cl.keep_long_enough(cl.mask_and_clean(cl.with_typed_columns(spark.read.parquet(str(tmp_path / "r")))))
    plan = clean.filter(F.col("app_name") == OWN)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(app_name,own)" in plan
    assert plan.count("rrn") == 0 and plan.count("[1-4]") == 1


def test_missing_columns(make_reviews):
    df = make_reviews(valid_rows(4)).drop("version")
    assert cl.missing_columns(df) == ["version"]
    with pytest.raises(ValueError):
        cl.clean_reviews(df)


def test_length_outliers(make_reviews):
    rows = [("a", "s", "3", "2026-01-01", "x" * n + str(n)) for n in [20, 21, 22, 23, 24, 25, 300]]
    flagged = cl.flag_length_outliers(cl.clean_reviews(make_reviews(rows)))
    assert [r.review_len for r in flagged.filter("len_outlier").collect()] == [303]
    f = cl.length_fences(cl.clean_reviews(make_reviews(rows))).first()
    assert (f.q1, f.median, f.q3, f.low_fence) == (23.5, 25.0, 26.5, 19.0)


def test_quality_summary(make_reviews):
    df = make_reviews([
        ("a", "s", "5", "2026-01-02", "hello there a@b.co"), ("a", "s", "5", "2026-01-02", "hello there a@b.co"),
        ("a", "s", "5", "never", "another text"), ("a", "s", "5", "2026-01-02", "hm"), ("a", "s", "5", "d", None),
        ("a", "s", "5", "d", "  ")])
    r = qu.quality_summary(df).first()
    assert (r.input_rows, r.output_rows, r.removed_rows) == (6, 2, 4)
    assert (r.null_text_rows, r.duplicate_rows_removed, r.too_short_rows_removed) == (2, 1, 1)
    assert (r.pii_masked_rows, r.date_parse_failed_rows, r.outlier_rows) == (1, 1, 0)
    assert abs(r.null_text_rate - 2 / 6) < 1e-12 and r.date_parse_fail_rate == 0.5


def test_gate_passes_valid_data(make_reviews):
    assert all(checks(make_reviews(valid_rows())).values())
    assert qu.gate_verdict(qu.quality_gate(make_reviews(valid_rows()), OWN)).first().passed


@pytest.mark.parametrize("fault,check", [
    ("few", "min_reviews"), ("blank", "null_rate"), ("copies", "duplicate_rate"), ("stars", "rating_range"),
    ("dates", "date_parse_rate"), ("one app", "app_coverage"), ("no own", "app_coverage")])
def test_gate_finds_faults(make_reviews, fault, check):
    rows = valid_rows()
    if fault == "few":
        rows = rows[:500]
    for i in range(len(rows)):
        a, s, r, d, t = rows[i]
        if fault == "blank" and i % 10 == 0:
            t = "  "
        if fault == "copies" and i % 10 == 0:
            a, s, t = OWN, "app_store", "copied"
        if fault == "stars" and i < 5:
            r = "7"
        if fault == "dates" and i % 10 == 0:
            d = "someday"
        if fault == "one app":
            a = OWN
        if fault == "no own" and a == OWN:
            a = "other"
        rows[i] = (a, s, r, d, t)
    df = make_reviews(rows)
    result = checks(df)
    assert result[check] is False
    assert not qu.gate_verdict(qu.quality_gate(df, OWN)).first().passed


def test_gate_missing_column_and_empty(make_reviews):
    result = checks(make_reviews(valid_rows()).drop("version"))
    assert [k for k, v in result.items() if v] == ["min_reviews"]
    assert not any(v for k, v in checks(make_reviews([])).items() if k != "required_columns")


def test_merge_keeps_base(make_reviews):
    base = make_reviews([("a", "s", "1", "d", "same text"), ("a", "s", "2", "d", "base only")])
    new = make_reviews([("a", "s", "5", "d", "new only"), ("a", "s", "5", "d", "same text")])
    merged = so.merge_reviews(base, new)
    assert sorted((r.review_text, r.rating) for r in merged.collect()) == [
        ("base only", "2"), ("new only", "5"), ("same text", "1")]
    assert so.merge_reviews(base, base).count() == 2
    assert so.apply_new_reviews(base, new, "merge").count() == 3
    assert so.apply_new_reviews(base, new, "overwrite").count() == 2
    with pytest.raises(ValueError):
        so.apply_new_reviews(base, new, "append")


def test_merge_order_and_repeated_merges(make_reviews):
    base = make_reviews([("a", "s", "5", "2026-01-01", f"base text {i}") for i in range(3)]).withColumn("ingest_seq", F.col("ingest_seq") + 2**62)
    new = make_reviews([("a", "s", "1", "2026-01-01", f"new text {i}") for i in range(3)])
    rows = so.apply_new_reviews(so.merge_reviews(base, new), new, "merge").orderBy("ingest_source", "ingest_seq").collect()
    assert [r.review_text for r in rows] == ["base text 0", "base text 1", "base text 2", "new text 0", "new text 1", "new text 2"]
