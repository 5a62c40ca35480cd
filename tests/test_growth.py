"""Plans and passes that must not grow faster than their input."""

import time

from pyspark.sql import functions as F

from reviewloom.operators import cleaning as cl
from reviewloom.operators import grams as gr
from reviewloom.operators import issues as iss
from reviewloom.operators import sampling as sp
from reviewloom.operators import terms as te
from reviewloom.plans import adapters as ad
from reviewloom.plans.stages import materialize


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_first_rows_are_found_without_sorting_the_texts(spark, make_reviews):
    raw = make_reviews([("a", "s", "1", "2026-01-01", f"some text {i % 4}") for i in range(9)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        kept = cl.deduplicated(raw, ["review_text"])
        assert "ShuffledHashJoin" in plan(kept) and "SortMergeJoin" not in plan(kept)
        assert sorted(r.ingest_seq for r in kept.collect()) == [0, 1, 2, 3]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stage_tables_are_zstandard_files(spark, tmp_path):
    materialize(spark.range(5), "five", str(tmp_path))
    assert list(tmp_path.glob("stage-five-*/*.zstd.parquet"))


def test_only_the_sample_is_classified(spark, make_reviews):
    rows = [("a", "s", str(i % 5 + 1), "2026-01-01", f"chlich nicht ouelle number {i}") for i in range(40)]
    clean = cl.clean_reviews(make_reviews(rows))
    got = sp.review_sample(clean, 7, rules=ad.LATIN_RULES)
    assert got.collect() == sp.review_sample(iss.classify(clean, ad.LATIN_RULES), 7).collect()
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_norm" in text and "_norm" not in text[text.index("GlobalLimit"):]


def test_keywords_of_common_pairs_are_no_candidates(spark):
    texts = spark.createDataFrame([(i, "there hereth reherthe ethere") for i in range(20)], "ingest_seq long, _norm string")
    words = spark.createDataFrame([("a", w, w) for w in ("therehe", "ether", "hethe", "re", "therex")], "issue_type string, keyword string, needle string")
    got = gr.likely_keywords(texts, words).collect()  # each of the others has pairs that every text holds
    assert {r.keyword for r in got} == {"ether", "re"} and len(set(got)) == 40
    assert gr.likely_keywords(texts, words.limit(0)).collect() == []


def test_the_text_index_cuts_each_text_once_and_shuffles_nothing(spark, monkeypatch):
    monkeypatch.setattr(gr, "materialize", lambda df, *_: df)
    texts = spark.createDataFrame([(1, "x", 3.0, "a😀Bc😀d"), (2, "x", 3.0, "a😀b c😀d"), (3, "x", 3.0, None)],
                                  "ingest_seq long, app_name string, rating double, clean_text string")
    index = gr.text_index(texts)
    assert "Exchange" not in plan(index) and "Sort" in plan(index)
    for word in ("😀bC", "bc😀", "Bc😀D"):
        assert [r.ingest_seq for r in gr.indexed_search(texts, index, word, literal=True).collect()] == [1]


def test_tokens_are_laid_out_by_document_once(spark, monkeypatch):
    stages = {}
    monkeypatch.setattr(te, "materialize", lambda df, name, *_: stages.setdefault(name, df.persist()))
    docs = spark.createDataFrame([(i, f"one word{i % 3} two") for i in range(9)], "ingest_seq long, clean_text string")
    weights = te.tfidf(docs, [], min_df=2)
    assert "Exchange" not in plan(stages["tokens"])
    assert {r.ingest_seq for r in weights.collect()} == set(range(9))
    for df in stages.values():
        df.unpersist()


def test_what_a_stage_shuffled_does_not_stay(spark, tmp_path):
    def shuffles():
        return spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()

    def step(i):
        materialize(spark.range(1000).groupBy((F.col("id") % 7 + i).alias("k")).count(), "counts", str(tmp_path))
    step(0)
    before = shuffles()
    for i in range(12):
        step(i)
    for _ in range(20):  # the cleaner has its own thread
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before
