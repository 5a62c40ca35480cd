import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from reviewloom.llm import quality
from reviewloom.llm.catalog import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
M = quality.BUCKETS


def h(word, seed=42):
    return xxhash.xxh64(word.encode(), seed=seed).intdigest()


def features(text):
    w = WORD.findall(text or "")
    return [h(x) % M for x in w] + [h(b, h(a)) % M for a, b in zip(w, w[1:])]


def brute_rules(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    seen = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))
    return (*n, n[0] < 50 or 100 * n[4] > 50 * n[0])


def brute(docs, labels):
    trusted = {i for i, q in labels if q == 1 and i is not None}
    raw, target = Counter(), Counter()
    for r in docs:
        raw.update(features(r["text"]))
        if r["doc_id"] in trusted:
            target.update(features(r["text"]))
    a, b = raw.total() + M, target.total() + M
    out = []
    for r in docs:
        f = features(r["text"])
        score = sum(math.log((target[x] + 1) / b) - math.log((raw[x] + 1) / a) for x in f) / len(f) if f else None
        out.append((r["doc_id"], *brute_rules(r["text"]), score))
    own = [r[-1] for r in out if r[0] in trusted and r[1] >= 50]
    least = -math.inf
    if own:
        median, low = np.quantile(own, [0.5, quality.QUANTILE])
        least = median - quality.MARGIN * (median - low)
    return [(*r[:7], not r[6] and r[7] >= least, r[7]) for r in out]


def same(got, want):
    key = lambda r: str(tuple(r[:8]))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:8] for r in got] == [r[:8] for r in want]
    for a, b in zip(got, want, strict=True):
        assert (a[8] is None) == (b[8] is None) and (a[8] is None or abs(a[8] - b[8]) < 1e-9)


TEXTS = ["", "\n\n", "a a a a", "a a", "x y z\nx y z\n\nx y z\r", "one\ntwo\none\n one", "# * $ % & | < > #", "a b c d a b c e b c d", "tab\tand\x0bvt\x0cff\x1cfs\xa0nbsp", "ÄÖ ü 中文字 🙂 🙂",
         "w " * 300, " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i % 40}" for i in range(100)), " ".join(f"w{i % 70}" for i in range(93))]


def test_rules_equal_brute_force(spark, make_docs, odd_docs):
    docs = make_docs([(100 + i, t, "en") for i, t in enumerate(TEXTS)]).union(odd_docs)
    got = quality.rules(docs).select("doc_id", *quality.RULES, quality.base_failed().alias("base_failed")).collect()
    want = [(r["doc_id"], *brute_rules(r["text"])) for r in docs.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r[-1] for r in want} == {True, False}


def test_judge_equals_brute_force(spark, make_docs, odd_docs):
    rng = np.random.RandomState(3)
    text = lambda vocabulary: " ".join(f"{vocabulary}{rng.randint(300)}" for _ in range(rng.randint(60, 200)))
    docs = make_docs([(100 + i, text("g" if i % 4 else "junk"), "en") for i in range(80)]).union(odd_docs).withColumns({"row": F.lit("x"), "bucket": F.lit(1), "kept": F.lit(2)})
    labels = [(100 + i, int(i % 4 > 0)) for i in range(0, 80, 3)] + [(None, 1), (1, None), (5, 1), (6, 1), (103, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    good = {i for i, q in labels if q == 1 and i and i >= 100}
    got = quality.judge(docs, table)
    assert got.columns == ["doc_id", *quality.RULES, "base_failed", "kept", "score"]
    rows = got.collect()
    same(rows, brute(docs.collect(), labels))
    assert {r.kept for r in rows if r.doc_id in good} == {True}
    assert {r.kept for r in rows if r.doc_id and r.doc_id >= 100 and not r.doc_id % 4} == {False}


def test_no_trusted_documents_and_empty_tables(spark, make_docs, odd_docs):
    none = spark.createDataFrame([(1, 0), (None, 1)], "doc_id long, quality int")
    rows = quality.judge(odd_docs, none).collect()
    assert all(r.kept == (not r.base_failed) for r in rows) and len(rows) == odd_docs.count()
    assert quality.judge(odd_docs.limit(0), none).collect() == []


def test_sample_is_bounded_and_repeatable(spark):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    few = {r[0] for r in quality.trusted_ids(labels.union(labels), 700).collect()}
    assert 690 <= len(few) <= 700
    assert few == {r[0] for r in quality.trusted_ids(labels, 700).collect()}
    assert quality.trusted_ids(labels).count() == 5000


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    same(QUERIES["op11_quality"](spark, sf).collect(), brute(docs, labels))


def test_no_python_in_the_plan(spark, odd_docs):
    table = spark.createDataFrame([(1, 0.5)], "bucket int, weight double")
    plan = quality.score(odd_docs, table)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_every_trusted_document_counts(spark, monkeypatch):
    monkeypatch.setattr(quality, "BROADCAST", 1000)
    texts = ["alpha beta " * 30 if i % 2 else f"word{i} gamma " * 30 for i in range(1 << 17)]
    docs = spark.createDataFrame([(i, t[:12]) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    trusted = quality.trusted_ids(labels)
    assert trusted.count() == 1 << 17  # more than the 65,536 that were taken once
    assert {round(r.weight, 9) for r in quality.weights(docs, trusted).collect()} == {0.0}  # both sides count the same


def test_quantiles_are_exact(spark):
    rng = np.random.RandomState(1)
    for x in (np.round(rng.randn(500), 2), rng.randn(501) / 1000, np.array([0.25])):
        got = quality.quantiles(spark.createDataFrame([(float(v),) for v in x], "score double"), [0.5, 0.05])
        assert np.allclose(got, np.quantile(x, [0.5, 0.05]), atol=1e-12)
    assert quality.quantiles(spark.createDataFrame([], "score double"), [0.5]) is None
