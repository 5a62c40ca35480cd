import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import decontaminate, fingerprints, language, toxicity, urls
from reviewloom.llm.catalog import QUERIES
from reviewloom.llm.words import Memo, Words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute_hits(text, items, n=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        k = min(n, len(x))
        wins = {tuple(x[i:i + k]) for i in range(len(x) - k + 1)} if x else set()
        for i in range(len(w) - k + 1):
            if tuple(w[i:i + k]) in wins:
                hit |= set(range(i, i + k))
                found.add(item)
    return len(w), len(hit), len(found - {None})


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short item"), (None, "solo"), (3, None), (4, "..."), (5, "short ITEM")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def test_contamination_equals_brute_force(make_docs, items, odd_docs):
    docs = make_docs([(1, "x ONE, two three four five six seven eight nine ten! eleven y", "en"), (2, "two three four five six seven eight nine ten eleven", "en"),
                      (3, "a short-item solo short item", "en"), (4, "one two three four five six seven eight nine eleven", "en"), (5, "Ünicode éÉ 中文 solo", "en")]).union(odd_docs)
    got = decontaminate.contamination(docs, items).collect()
    want = sorted((r["doc_id"] or -1, *brute_hits(r["text"], ITEMS)) for r in docs.collect())
    assert sorted((r["doc_id"] or -1, r["n_words"], r["n_hit"], r["n_items"]) for r in got) == want
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got)


@pytest.mark.parametrize("limit", [-1, 1 << 20])
def test_a_benchmark_of_any_size_hits_alike(spark, make_docs, items, odd_docs, monkeypatch, limit):
    docs = make_docs([(1, "x ONE, two three four five six seven eight nine ten! eleven y", "en"), (3, "a short-item solo short item", "en"),
                      (3, "a short-item solo short item", "en"), (None, "solo", "en"), (9, "solo " * 3000, "en")]).union(odd_docs)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
    frame = decontaminate.contamination(docs, items)
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], *brute_hits(r["text"], ITEMS)) for r in docs.collect())
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in frame.collect()) == want
    left = decontaminate.clean_documents(docs, items)
    assert left.count() == odd_docs.count()
    assert not re.search("Python|Pandas|InArrow", frame._jdf.queryExecution().toString())


def test_names_with_dots(spark, items):
    docs = spark.createDataFrame([(1, "solo x", "en", 1.0)], "doc_id long, text string, lang string, `a.b` double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert decontaminate.clean_spans(docs, items).first()["a.b"] == 1.0
    assert decontaminate.clean_documents(docs, items.where("item_id = 1")).first()["a.b"] == 1.0
    assert toxicity.score(docs, toxicity.train(docs, none)).first()["a.b"] == 1.0
    assert language.predict(docs, language.train(docs)).first()["a.b"] == 1.0
    assert fingerprints.fingerprint(docs).first()["a.b"] == 1.0


def test_samples_are_bounded_where_one_id_repeats(spark, make_docs):
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5)
    docs = make_docs([(only, f"some text {i} of many", "en") for i in range(3000)] + [(only, "the same text", "en")] * 500)
    held = []
    fit = language.fit
    try:
        language.fit = lambda rows, langs: held.extend(rows) or fit(rows[:20], langs)
        language.train(docs, sample=200)
    finally:
        language.fit = fit
    assert 50 < len(held) < 300


def test_clean_documents_and_spans(make_docs, items, odd_docs):
    docs = make_docs([(21, "keep Short item, keep", "en")]).union(odd_docs)
    left = decontaminate.clean_documents(docs, items)
    assert left.columns == docs.columns and left.count() == odd_docs.count()
    spans = {r["doc_id"]: r["text"] for r in decontaminate.clean_spans(docs, items).collect()}
    assert spans[21] == "keep  , keep" and spans[3] is None and spans[1] == "plain text of seven words or so"
    assert decontaminate.clean_documents(docs, items.limit(0)).count() == docs.count()
    assert decontaminate.contamination(docs.limit(0), items).count() == 0


def test_no_python_in_the_native_plan(spark, sf):
    text = QUERIES["op2_decontamination"](spark, sf)._jdf.queryExecution().toString() + QUERIES["op3_urls"](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", text)


URLS = ["http://A.Example.COM/en/1.html", "https://www.example.com/en/x", "https://x.net/es/1", "https://net/fr/", "ftp://shop.org/a/b?x=1&y=2#f",
        "no scheme", None, "", "http://x.com", "http://x.com?q=/en/", "https://notexample.net/es", "https://xcom/", "http://a\nb.com/en/"]


def test_host_path_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[0], "h")], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, spark.createDataFrame([], "url string, block boolean")).collect()}
    assert got[0] == got[None] == ("a.example.com", "/en/1.html", "example.com/en/", "block")
    assert got[1][2:] == ("www.example.com/en/", "allow") and got[2][2:] == ("net/es/", "block") and got[3][2:] == ("net/fr/", "block")
    assert got[4] == ("shop.org", "/a/b", None, "allow")
    assert got[5] == got[6] == got[7] == ("", "", None, "allow")
    assert got[8] == ("x.com", "", None, "allow") and got[9] == ("x.com", "", None, "allow")
    assert got[10][2:] == (None, "allow") and got[11][2:] == (None, "allow") and got[12] == ("a\nb.com", "/en/", "com/", "allow")


def sure(bad, n, z=urls.Z):
    p = bad / n
    return (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)


def brute_rules(sets):
    """sets: (tokens, block, held) of each labelled url."""
    mined, held = [x for x in sets if not x[2]], [x for x in sets if x[2]]
    every = {frozenset(c) for s, _, _ in mined for k in range(1, len(s) + 1) for c in itertools.combinations(sorted(s), k)}
    rate = lambda rows: sum(b for _, b, _ in rows) / len(rows)
    conf = {}
    for c in every:
        inside, outside = [x for x in mined if c <= x[0]], [x for x in held if c <= x[0]]
        bad = sum(b for _, b, _ in inside)
        if bad >= max(urls.MIN_COUNT, urls.MIN_SUPPORT * len(mined)) and sure(bad, len(inside)) >= max(urls.MIN_CONFIDENCE, urls.MIN_LIFT * rate(mined)):
            if outside and rate(outside) > rate(held):
                conf[c] = sure(bad, len(inside))
    return {tuple(sorted(c)): p for c, p in conf.items() if not any(conf.get(c - {x}, 0) >= p - 1e-12 for x in c)}


def test_mined_rules_equal_brute_force(spark):
    rng = np.random.RandomState(3)
    rows = []
    for i in range(900):
        host, folder, end = f"h{rng.randint(4)}.org", f"f{rng.randint(3)}", rng.choice([".html", ".php"])
        bad = rng.rand() < (0.9 if (host, folder) == ("h1.org", "f2") else 0.7 if end == ".php" and folder == "f0" else 0.1)
        rows.append((f"http://{host}/{folder}/{i}{end}", bool(bad)))
    labelled = spark.createDataFrame(rows, "url string, block boolean")
    got = {tuple(r["items"]): r["confidence"] for r in urls.mine_rules(labelled).collect()}
    held = F.pmod(F.xxhash64("url"), F.lit(urls.HELD)) == 0
    sets = [(set(t), b, h) for t, b, h in labelled.select(urls.tokens(F.col("url")), "block", held).collect()]
    want = brute_rules(sets)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got) and got
    judged = urls.judge(labelled.select(F.monotonically_increasing_id().alias("page_id"), "url"), labelled, []).collect()
    assert len(judged) == 900 and sum(r["verdict"] == "block" for r in judged) == sum(any(set(c) <= s for c in want) for s, _, _ in sets)


def test_rules_need_evidence(spark):
    few = spark.createDataFrame([(f"http://bad.org/x/{i}", True) for i in range(9)] + [(f"http://good.org/x/{i}", False) for i in range(200)], "url string, block boolean")
    assert urls.mine_rules(few).count() == 0  # nine blocked urls are not enough
    rng = np.random.RandomState(1)
    noise = spark.createDataFrame([(f"http://h{rng.randint(9)}.org/f{rng.randint(9)}/{i}", bool(rng.rand() < 0.25)) for i in range(600)], "url string, block boolean")
    assert urls.mine_rules(noise).count() == 0


def test_tokens_of_names_values_and_parents(spark):
    got = spark.createDataFrame([("https://a.b.Example.com/x/Cheap-pills_2024.html?q=1&z",)], "url string").select(urls.tokens(F.col("url"))).first()[0]
    assert set(got) == {"scheme:https", "host:a.b.example.com", "domain:b.example.com", "domain:example.com", "top:com", "folder:x", "name:cheap",
                        "name:pills", "ending:.html", "query:q", "query:z", "value:q=1"}


def test_language_held_out_and_odd_rows(spark, sf, documents, odd_docs):
    got = QUERIES["op9_language"](spark, sf).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(documents) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(documents[r["doc_id"]]["lang"] == r["lang_pred"] for r in held) / len(held) > 0.9
    odd = sorted((r["doc_id"] or -1, r["lang_pred"]) for r in language.identify(odd_docs).collect())
    assert len(odd) == odd_docs.count() and [x for i, x in odd if i in (3, 4, 5, 7)] == ["und"] * 4
    assert all(r["lang_pred"] == "und" for r in language.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect())
    assert language.identify(odd_docs.limit(0)).count() == 0


def test_language_never_reads_labels_of_what_it_predicts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("y"))
    a, b = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(d).collect()} for d in (docs, other))
    assert a == b


def test_toxicity_finds_planted_words(spark, make_docs):
    rng = np.random.RandomState(7)
    plain = ["".join(rng.choice(list("abcdefghiklmnoprst"), rng.randint(2, 8))) for _ in range(400)]
    bad = ["wretchling", "vilemonger", "scumbucket"]
    rows, labels = [], []
    for i in range(900):
        w = [plain[int(rng.zipf(1.4)) % 400] for _ in range(rng.randint(10, 80))]
        toxic = int(i % 5 == 1)
        if toxic:
            for _ in range(3):
                w.insert(rng.randint(len(w)), bad[rng.randint(3)])
        rows.append((i, " ".join(w), "en"))
        labels.append((i, 1, toxic))
    docs, marks = make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, marks).collect()}
    held = [i for i in got if got[i]["held_out"]]
    assert len(got) == 900 and all((zlib.crc32(str(i).encode()) % 5 == 0) == got[i]["held_out"] for i in got)
    assert sum(got[i]["predicted"] == labels[i][2] for i in held) / len(held) > 0.97
    flipped = marks.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, flipped).collect()}
    assert all(abs(again[i] - got[i]["score"]) < 1e-12 for i in got)


def test_toxicity_odd_rows(spark, odd_docs):
    none = spark.createDataFrame([(1, 1, 0), (None, None, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    for marks in (none, none.limit(0)):
        got = toxicity.classify(odd_docs, marks).collect()
        assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert toxicity.classify(odd_docs.limit(0), none).count() == 0


def test_toxic_distances_hold_when_the_word_cache_starts_anew():
    own = toxicity.Distance(b" plain common words of ordinary text ", b" wretchling vilemonger scumbucket ")
    own.memo = Memo(limit=4)
    for text in ("wretchling plain of text common", "wretchling plain new vilemonger", "scumbucket words wretchling plain", "wretchling ordinary vilemonger aa zz qq"):
        w = Words(pa.array([text]))
        assert own.words(w).tolist() == [own.of(x.encode()) for x in text.split()]
