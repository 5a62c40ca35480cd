import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from reviewloom.operators import cleaning as cl
from reviewloom.functions.rules import load_issue_rules, load_reply_policy
from reviewloom.sources import registry as rg
from reviewloom.sources import reviews as rv
from reviewloom.sources import sinks as sk


def test_csv_scan_and_export_round_trip(spark, tmp_path):
    src = tmp_path / "in.csv"
    src.write_text("﻿app_name,store,rating,date,review_text,version,source_url\n"
                   'a,s,5,2026-01-01,"two\nlines, ""quoted""",1.0,u\nb,s,,2026-01-02,plain,,\n', encoding="utf-8")
    rows = rv.read_review_csv(spark, str(src))
    got = rows.orderBy("ingest_seq").collect()
    assert [r.app_name for r in got] == ["a", "b"]
    assert got[0].review_text == 'two\nlines, "quoted"' and got[1].rating is None
    out = str(tmp_path / "out")
    sk.export_csv(rows.drop("ingest_seq").withColumn("tags", F.array(F.lit("x"), F.lit("y"))), out)
    back = spark.read.csv(out, header=True, multiLine=True, escape='"').orderBy("app_name").collect()
    assert back[0].review_text == 'two\nlines, "quoted"' and back[0].tags == "x, y"
    rv.land_reviews(rows, str(tmp_path / "landed"), partition_by_app=True)
    landed = rv.read_review_parquet(spark, str(tmp_path / "landed"))
    assert landed.count() == 2 and "ingest_seq" in landed.columns


def test_play_records(spark, tmp_path):
    path = tmp_path / "play.json"
    recs = [{"app_id": "p.x", "app_name": "x", "score": 5, "at": f"2026-01-0{i} 10:00:00", "content": f" t{i}\nz ",
             "reviewCreatedVersion": None} for i in range(1, 5)]
    path.write_text("\n".join(json.dumps(r) for r in recs))
    rows = rv.normalize_play_records(rv.read_play_records(spark, str(path)), 2).orderBy("date").collect()
    assert [(r.date, r.review_text, r.rating, r.version) for r in rows] == [
        ("2026-01-03", "t3 z", "5", ""), ("2026-01-04", "t4 z", "5", "")]
    assert rows[0].store == "google_play" and rows[0].source_url.endswith("id=p.x")


def test_feed_pages(spark, tmp_path):
    def entry(n):
        return {"im:rating": {"label": str(n)}, "im:version": {"label": "1"}, "title": {"label": f"T{n}"},
                "updated": {"label": "2026-03-04T00:00:00-07:00"}, "content": {"label": f"c{n}\nmore"}}
    pages = [{"app_id": "9", "app_name": "x", "page": 2, "feed": {"entry": [entry(4)]}},
             {"app_id": "9", "app_name": "x", "page": 1,
              "feed": {"entry": [{"title": {"label": "the app"}}, entry(1), entry(2)]}}]
    (tmp_path / "f.json").write_text(json.dumps(pages))
    feed = rv.read_feed_pages(spark, str(tmp_path / "f.json"))
    rows = rv.normalize_feed_pages(feed, "us", 2).orderBy("rating").collect()
    assert [(r.rating, r.review_text) for r in rows] == [("1", "T1 c1 more"), ("2", "T2 c2 more")]
    assert rows[0].date == "2026-03-04" and rows[0].source_url == "https://apps.apple.com/us/app/id9"
    assert rv.normalize_feed_pages(feed, "us", None).select("ingest_seq").distinct().count() == 3


def test_manual_tables(spark):
    df = spark.createDataFrame([("good", " ", "x"), ("bad", "", "y")], "review string, app_name string, extra string")
    out = rv.normalize_store_csv(df, "mine").collect()
    assert {r.store for r in out} == {"app_store"} and {r.review_text for r in out} == {"good", "bad"}
    assert out[0].rating is None and out[0].app_name == " "
    manual = rv.normalize_manual(df.withColumnRenamed("review", "review_text"), "mine").collect()
    assert {(r.app_name, r.store, r.rating) for r in manual} == {("mine", "sample", "")}
    partly = spark.createDataFrame([("t", "a"), ("u", "")], "review_text string, app_name string")
    assert {r.app_name for r in rv.normalize_manual(partly, "mine").collect()} == {"a", ""}


def test_collect_all_keeps_the_order_of_sources(spark, make_reviews, tmp_path):
    empty, one, two = make_reviews([]), make_reviews([("a", "s", "1", "d", "the same text")]), make_reviews([("a", "s", "2", "d", "the same text"), ("b", "s", "2", "d", "another text")])
    assert rv.collect_all([empty, empty]).count() == 0
    both = rv.collect_all([empty, rv.collect_all([one, two]), one])
    assert both.select("ingest_source", "ingest_seq").distinct().count() == 4
    clean = cl.clean_reviews(both)  # numbers collide between sources, the texts decide
    assert sorted((r.app_name, r.rating, list(r.ingest_source)) for r in clean.collect()) == [("a", 1.0, [1, 0]), ("b", 2.0, [1, 1])]
    rv.land_reviews(both, str(tmp_path / "landed"))
    landed = rv.read_review_parquet(spark, str(tmp_path / "landed")).orderBy("ingest_seq").collect()
    assert [(r.app_name, r.rating) for r in landed] == [("a", "1"), ("a", "2"), ("b", "2"), ("a", "1")]


def test_stores_give_every_review_by_default(spark):
    rows = [("id", "app", str(i % 5), f"2026-01-{i % 28 + 1:02d}", f"text {i}", "1") for i in range(400)]
    assert rv.normalize_play_records(spark.createDataFrame(rows, rv.PLAY_SCHEMA)).count() == 400


def test_file_names_with_plus_and_percent(spark, tmp_path):
    for name in ("A+B", "50%", "read me", "README"):
        (tmp_path / f"{name}.md").write_text("text")
    assert {r.app_name for r in rg.competitor_documents(spark, str(tmp_path)).collect()} == {"A+B", "50%", "read me"}


def test_only_a_missing_metrics_table_is_empty(spark, tmp_path):
    assert sk.read_metrics(spark, str(tmp_path / "none")).count() == 0
    spark.range(3).write.parquet(str(tmp_path / "other"))
    with pytest.raises(Exception, match="section"):
        sk.read_metrics(spark, str(tmp_path / "other"))


def test_registry_and_report(spark, make_reviews):
    apps = spark.createDataFrame(
        [(" a ", "p.a", 12, True), ("b", " ", 13, None), ("", "p", 1, False)],
        "name string, google_play string, app_store long, is_our_app boolean")
    assert {tuple(r) for r in rg.clean_apps(apps).collect()} == {
        ("a", "p.a", "12", True), ("b", "", "13", False)}
    assert rg.app_by_name(apps, "a").count() == 1
    reviews = make_reviews([("a", "google_play", "1", "d", "t"), ("a", "google_play", "1", "d", "u")])
    requested = spark.createDataFrame([("a",), ("b",), ("zz",)], "app string")
    assert {tuple(r) for r in rg.collection_report(requested, apps, reviews).collect()} == {
        ("a", "google_play", 2, "수집"), ("a", "app_store", 0, "결과 없음(수동 입력 권장)"),
        ("b", "app_store", 0, "결과 없음(수동 입력 권장)"), ("zz", "-", 0, "미등록")}


def test_manifest(spark, make_reviews, tmp_path):
    reviews = make_reviews([("a", "google_play", "1", "d", "t"), ("a", "sample", "1", "d", "u")])
    path = str(tmp_path / "m")
    rg.write_manifest(rg.manifest_records(reviews, "2026-01-01T00:00:00+00:00"), path)
    rg.append_manifest(rg.manifest_records(reviews, "2026-01-02T00:00:00+00:00"), path)
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 4 and {r.source_type for r in rows} == {"review", "sample"}
    bad = rg.manifest_records(reviews, "x").withColumn("source_type", F.lit("rumour"))
    with pytest.raises(PySparkException):
        rg.validated_manifest(bad).collect()


def test_competitor_documents(spark, tmp_path):
    for name, text in (("앱 하나", "Good  UI"), ("README", "skip"), ("two", "x\ny")):
        (tmp_path / f"{name}.md").write_text(text, encoding="utf-8")
    (tmp_path / "other.txt").write_text("no")
    assert {tuple(r) for r in rg.competitor_documents(spark, str(tmp_path)).collect()} == {
        ("앱 하나", "goodui"), ("two", "xy")}


def test_metrics_table(spark, tmp_path):
    path = str(tmp_path / "metrics")
    assert sk.read_metrics(spark, path).count() == 0
    schema = sk.METRICS_SCHEMA
    sk.append_metrics(spark.createDataFrame([("s", "a", "1", "t1"), ("s", "b", "2", "t1"), ("q", "c", "3", "t1")], schema), path)
    sk.append_metrics(spark.createDataFrame([("s", "a", "9", "t2")], schema), path)
    now = {tuple(r)[:3] for r in sk.latest_metrics(sk.read_metrics(spark, path)).collect()}
    assert now == {("s", "a", "9"), ("q", "c", "3")}
    new = spark.createDataFrame([("q", "z", "0", "t3")], schema)
    up = {tuple(r)[:3] for r in sk.upsert_metrics(sk.latest_metrics(sk.read_metrics(spark, path)), new).collect()}
    assert up == {("s", "a", "9"), ("q", "z", "0")}


def test_run_log(spark, tmp_path):
    runs = spark.createDataFrame([("r1", "reply", "t1", 4, 2.0), ("r2", "reply", "t2", 0, 1.0), ("r3", "report", "t1", 1, 3.0)],
                                 "run_id string, kind string, timestamp string, total long, elapsed_sec double")
    errors = spark.createDataFrame([("r1", i, f"e{i}") for i in range(15)], "run_id string, error_no int, error string")
    entries = sk.run_entries(runs, errors)
    first = entries.filter("run_id = 'r1'").first()
    assert first.errors == [f"e{i}" for i in range(10)] and first.avg_sec_per_reply == 0.5
    sk.append_runs(entries, str(tmp_path / "log"))
    last = {r.kind: r for r in sk.latest_runs(spark.read.parquet(str(tmp_path / "log"))).collect()}
    assert last["reply"].run_id == "r2" and last["reply"].errors == [] and last["reply"].avg_sec_per_reply == 0.0


def test_dictionary_files(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "k.yaml").write_text(
        "issue_types:\n  pay: [Pay Fail, refund]\nhigh_severity_triggers: [stolen]\n", encoding="utf-8")
    rules = load_issue_rules(str(tmp_path / "k.yaml"))
    assert rules.issue_types == {"pay": ("Pay Fail", "refund")} and rules.high_triggers == ("stolen",)
    (tmp_path / "p.yaml").write_text(
        "severity_to_reply_type: {high: security_sensitive}\nreply_types:\n  security_sensitive: {needs_human_review: true}\n"
        "banned_phrases: [always]\nforce_human_review: {severities: [high], issue_types: [pay], keywords: [stolen]}\n"
        "contact_guidance: {default: d, security: s}\n", encoding="utf-8")
    policy = load_reply_policy(str(tmp_path / "p.yaml"))
    assert policy.reviewed_types == ("security_sensitive",) and policy.force_keywords == ("stolen",)


def test_manifest_names_manual_files(make_reviews):
    rows = make_reviews([("a", "app_store", "1", "d", "t"), ("a", "google_play", "1", "d", "t"), ("b", "app_store", "1", "d", "t")])
    got = {(r.app_name, r.collection_method, r.url_or_file) for r in rg.validated_manifest(rg.manifest_records(rows, "now", {"a": "a.csv"})).collect()}
    assert got == {("a", "app_store_manual_csv", "a.csv"), ("a", "google_play_scraper", "url"), ("b", "manual_download", "url")}


def test_sections_are_replaced_side_by_side(spark, tmp_path):
    path = str(tmp_path / "metrics")
    rows = lambda *r: spark.createDataFrame(r, sk.METRICS_SCHEMA)
    sk.replace_sections(rows(("kpi", "n", "1", "t1"), ("kpi", "m", "2", "t1"), ("reply", "n", "3", "t1")), path)
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda r: sk.replace_sections(rows(r), path), [("kpi", "n", "9", "t2"), ("topics", "k", "10", "t2")]))
    got = {tuple(r) for r in sk.read_metrics(spark, path).collect()}
    assert got == {("kpi", "n", "9", "t2"), ("reply", "n", "3", "t1"), ("topics", "k", "10", "t2")}


def test_large_csv_is_read_by_many_tasks(spark, tmp_path):
    from reviewloom.functions import fixed_values as fv
    from reviewloom.sources.reviews import read_large_review_csv, read_review_csv
    for k in range(2):
        rows = ["\ufeff" + ",".join(fv.REVIEW_COLUMNS)]
        for i in range(400):
            text = ['plain', '"two\nlines, ""quoted"""', '"a\n\n\nb"', '""', '"' + "long line\n" * 40 + '"'][i % 5]
            rows.append(",".join(f"c{i}-{k}" if c != "review_text" else text for c in fv.REVIEW_COLUMNS))
        (tmp_path / f"part{k}.csv").write_text("\n".join(rows) + "\n", encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        want = read_review_csv(spark, str(tmp_path)).drop("ingest_seq").collect()
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        df = read_large_review_csv(spark, str(tmp_path))
        got = df.collect()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    plain = lambda rows: sorted(tuple(x or "" for x in r) for r in rows)
    assert plain(tuple(r)[:-2] for r in got) == plain(map(tuple, want)) and len(got) == 800
    assert all(r["bad_record"] is None for r in got)
    order = [r["app_name"] for r in sorted(got, key=lambda r: r["ingest_seq"])]
    assert order == [f"c{i}-{k}" for k in range(2) for i in range(400)]


def test_large_csv_keeps_bad_records(spark, tmp_path):
    from reviewloom.functions import fixed_values as fv
    from reviewloom.sources.reviews import read_large_review_csv
    n = len(fv.REVIEW_COLUMNS)
    (tmp_path / "a.csv").write_text(",".join(fv.REVIEW_COLUMNS) + "\r\n" + ",".join("x" * n) + "\r\n\r\nonly,three,fields\r\n")
    rows = sorted(read_large_review_csv(spark, str(tmp_path)).collect(), key=lambda r: r["ingest_seq"])
    assert [r["bad_record"] for r in rows] == [None, "only,three,fields"]
    assert [rows[0][c] for c in fv.REVIEW_COLUMNS] == ["x"] * n
