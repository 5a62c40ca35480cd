import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reviewloom.llm import fingerprints as fp
from reviewloom.llm import lm_scoring, packing, token_counts, warc
from reviewloom.llm.catalog import QUERIES, vocabulary
from reviewloom.llm.words import span_hashes


def encoded(name, texts):
    t = Tokenizer.from_file(vocabulary(name))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_counts_equal_the_library(spark, sf, documents, odd_docs):
    got = {r["doc_id"]: r for r in QUERIES["op6_token_counts"](spark, sf).collect()}
    for i, ids in zip(documents, encoded("byte_bpe_50k.json", [r["text"] for r in documents.values()])):
        r = got[i]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(documents[i]["text"].encode()), len(ids), len(ids) > 512)
    odd = [(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(odd_docs, vocabulary("byte_bpe_50k.json")).collect()]
    assert len(odd) == odd_docs.count() and (3, 0, 0) in odd and (4, 0, 0) in odd
    assert token_counts.count_tokens(odd_docs.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def check_pieces(rows, ids_of):
    """rows: pieces; ids_of: doc_id -> ids of each of its rows."""
    docs, bins = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append(r)
    assert docs.keys() == ids_of.keys()
    for i, parts in docs.items():
        want = Counter((s, len(x[s:s + 4096]), zlib.crc32(np.array(x[s:s + 4096], "<u4").tobytes()), len(x)) for x in ids_of[i] for s in range(0, len(x), 4096))
        assert Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in parts) == want
    for parts in bins.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    return len(bins)


def test_packing(spark, sf, documents, odd_docs):
    rows = QUERIES["op4_packing"](spark, sf).collect()
    ids = {i: [x + [2]] for i, x in zip(documents, encoded("word_bpe_49k.json", [r["text"] for r in documents.values()]))}
    n = check_pieces(rows, ids)
    total = sum(len(x) for v in ids.values() for x in v)
    assert n <= -(-total // 4096) + 1
    odd = odd_docs.collect()
    ids = {}
    for r, x in zip(odd, encoded("word_bpe_49k.json", [r["text"] for r in odd])):
        ids.setdefault(r["doc_id"], []).append(x + [2])
    made = packing.pack(odd_docs, vocabulary("word_bpe_49k.json"), with_ids=True).collect()
    check_pieces(made, ids)
    assert all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in made)
    assert packing.pack(odd_docs.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def test_least_slack_equals_brute_force():
    rng = np.random.RandomState(1)
    for _ in range(60):
        counts = {int(x): int(rng.randint(1, 4)) for x in rng.choice(np.arange(1, 30), 5, replace=False)}
        room = int(rng.randint(1, 60))
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        taken = packing.least_slack(room, counts, sorted(counts))
        assert all(k <= counts[x] for x, k in taken.items())
        assert sum(x * k for x, k in taken.items()) == max(s for s in sums if s <= room)


def test_bin_patterns_use_everything_once():
    histogram = {int(x): int(n) for x, n in zip(np.random.RandomState(5).choice(np.arange(1, 4096), 300, replace=False), np.random.RandomState(6).randint(1, 50, 300))}
    patterns = packing.bin_patterns(histogram, 4096)
    used = Counter()
    for times, taken in patterns:
        assert sum(x * k for x, k in taken.items()) <= 4096
        for x, k in taken.items():
            used[x] += times * k
    assert used == Counter(histogram)
    assert sum(t for t, _ in patterns) <= sum(x * n for x, n in histogram.items()) / 4096 * 1.05 + 2  # many lengths over half a window


def brute_scores(rows, k):
    """Interpolated n-gram probabilities by plain counting, 0 standing for the end and the start of a text."""
    tokens = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [0]) for r in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in tokens]
    grams = Counter()
    for (_, t), h in zip(tokens, held):
        s = [0] + t
        if not h:
            grams.update(tuple(s[i - j:i + 1]) for i in range(1, len(s)) for j in range(min(i, len(k)) + 1))
    words = {g: c for g, c in grams.items() if len(g) == 1}
    n, v = sum(words.values()), len(words)
    out = []
    for (i, t), h in zip(tokens, held):
        s, base, full = [0] + t, 0.0, 0.0
        for at in range(1, len(s)):
            p = (grams[(s[at],)] + 1) / (n + v + 1)
            base += math.log10(p)
            for j in range(1, min(at, len(k)) + 1):
                p = (grams[tuple(s[at - j:at + 1])] + k[j - 1] * p) / (grams[tuple(s[at - j:at])] + k[j - 1])
            full += math.log10(p)
        out.append((i, h, len(t), sum((w,) in words for w in t), n, base, full))
    return out


@pytest.mark.parametrize("bucket_bytes, k", [(None, lm_scoring.K), (1 << 12, (200.0,)), (1 << 14, (20.0, 5.0)), (1 << 16, ()), (None, (9.0, 4.0, 2.0))])
def test_lm_scores_equal_brute_force(documents, odd_docs, spark, sf, bucket_bytes, k):
    docs = odd_docs.select("doc_id", "text").union(spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40").select(F.col("doc_id") + 1000, "text"))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got = sorted(map(tuple, lm_scoring.score(docs, bucket_bytes=bucket_bytes, k=k).collect()), key=key)
    want = sorted(brute_scores(docs.collect(), k), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], atol=1e-6)


def automaton(texts, k):
    grams = lm_scoring.Grams(pa.array(texts, pa.large_string()), len(k) + 1)
    sums = [np.bincount(i[at], minlength=len(keys)) for keys, at, i in zip(grams.keys, grams.at, grams.index)]
    return grams, sums, lm_scoring.Automaton(grams, sums, int(sums[0].sum()), len(sums[0]), k)


def test_lanes_carry_the_state_of_one_traversal():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 300))) for _ in range(20)]
    grams, _, own = automaton(texts, (3.0, 2.0))
    whole = own.traverse(grams, 1 << 20)
    assert all(np.allclose(own.traverse(grams, lane), whole, atol=1e-9) for lane in (1, 2, 3, 64))


def test_arcs_and_failures_make_a_distribution():
    grams, sums, own = automaton(["a b c a b d", "b c a a", "d"], (3.0, 2.0))
    v, n = len(sums[0]), int(sums[0].sum())
    words = np.arange(v, dtype=np.int64)
    for state in [0, *(1 + np.arange(v)), *(1 + v + np.arange(len(grams.keys[1])))]:
        weight, _ = own.step(np.full(v, state, np.int64), words)
        unknown, at = 1 / (n + v + 1), state  # the root's share for a word never seen, reached over failure arcs
        while at:
            unknown, at = unknown * 10 ** own.fail_weight[at], own.fail_target[at]
        ends = state == 1 + grams.index[0][0] or state > v and grams.token[grams.seen[1][state - 1 - v]] == lm_scoring._END
        assert ends or abs((10**weight).sum() + unknown - 1) < 1e-9


def test_lm_is_a_distribution_and_odd_tables(odd_docs):
    assert lm_scoring.score(odd_docs.limit(0)).count() == 0
    only_held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:1]
    got = lm_scoring.score(odd_docs.where("doc_id = 1").withColumn("doc_id", F.lit(only_held[0]))).collect()
    assert [(r["held_out"], r["n_known"], r["train_tokens"], r["score"]) for r in got] == [(True, 0, 0, 0.0)]


def test_fingerprints_and_edits(odd_docs):
    rows = sorted(odd_docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    got = fp.edit_trial(odd_docs).collect()
    assert len(got) == len(rows)
    one = {r["doc_id"]: r for r in got}
    text = {r["doc_id"]: r["text"] or "" for r in rows}
    for i, j in ((3, 4), (4, 5), (5, 6), (6, 7), (7, 8)):
        n = len(text[i])
        edited = text[i][:n - n // 2] + text[j][:n // 2]
        assert (one[i]["n_chars"], one[i]["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
    assert {r["fingerprint"] for r in got if r["doc_id"] == 1} <= {r["fingerprint"] for r in got if r["doc_id"] == 2}
    assert one[4]["near_next"] == 1.0 and one[5]["near_next"] == 0.0
    assert fp.edit_trial(odd_docs.limit(0)).count() == 0
    lone = fp.edit_trial(odd_docs.where("doc_id = 1")).collect()
    assert len(lone) == 1 and lone[0]["near_next"] == 1.0
    made = fp.fingerprint(odd_docs)
    assert made.columns == odd_docs.columns + ["fingerprint", "n_shingles"] and made.count() == len(rows)


def test_edits_reach_over_ranges_and_estimates_are_close(spark, sf, documents):
    got = {r["doc_id"]: r for r in QUERIES["op7_fingerprints"](spark, sf).collect()}
    ids = sorted(documents)

    def bag(t):
        w = t.lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    errors = []
    for i, j in zip(ids, ids[1:] + ids[:1]):
        a, b = documents[i]["text"], documents[j]["text"]
        edited = a[:len(a) - len(a) // 2] + b[:len(a) // 2]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors.append(got[i]["near_edited"] - len(bag(a) & bag(edited)) / len(bag(a) | bag(edited)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_sketches_merge():
    rng = np.random.RandomState(2)
    a, b = rng.randint(0, 1 << 62, 5000).astype(np.uint64), rng.randint(0, 1 << 62, 3000).astype(np.uint64)
    both = np.concatenate([a, b, a[:100]])
    assert (fp.merge([fp.sketch(a), fp.sketch(b)]) == fp.sketch(both)).all()
    assert (fp.read(fp.write(fp.sketch(a))) == fp.sketch(a)).all()
    wide = rng.permutation(1 << 20).astype(np.uint64) * np.uint64(1 << 44)
    assert abs(fp.distinct(fp.sketch(wide[:20000], 1024), 1024) / 20000 - 1) < 0.15
    assert abs(fp.containment(fp.sketch(wide[:5000], 1024), fp.sketch(wide[:20000], 1024), 1024) - 1) < 0.2


PAGES = "page_id long, url string, html string, file string, hash string"


def test_audit_finds_each_kind_of_change(spark):
    rows = [(i, f"http://x/{i}", "page " * (i % 7), "f", "h") for i in range(0, 9000, 3)] + [(None, None, None, "f", "h"), (7, "http://x/7", "once", "f", "h"), (7, "http://x/7", "again", "f", "h")]
    pages = spark.createDataFrame(rows, PAGES)
    same = warc.audit(warc.archive(pages), warc.archive(pages))
    assert {r["status"] for r in same.select("status").distinct().collect()} == {"intact"} and same.count() == len(rows)
    hurt = [(i, u, h + "!" if i == 4500 else h, f, x) for i, u, h, f, x in rows if i != 8997] + [(9001, "u", "new", "f", "h")]
    # A change of length moves what follows in its file, so the change here keeps the length.
    hurt = [(i, u, "Page " + h[5:-1] if i == 4500 else h, f, x) for i, u, h, f, x in hurt]
    got = {(r["page_id"], r["status"]) for r in warc.audit(warc.archive(pages), warc.archive(spark.createDataFrame(hurt, PAGES))).where("status <> 'intact'").collect()}
    assert got == {(4500, "damaged"), (8997, "damaged")} or got == {(4500, "damaged"), (8997, "missing"), (9001, "added")}
    empty = warc.archive(pages.limit(0))
    assert warc.audit(empty, empty).count() == 0
    assert {r["status"] for r in warc.audit(warc.archive(pages), empty).collect()} == {"missing"}


def changes(pages, replica):
    rows = warc.audit(warc.archive(pages), warc.archive(replica)).collect()
    return rows, Counter((r["page_id"], r["status"]) for r in rows if r["status"] not in ("intact", "moved"))


def test_audit_matches_records_by_id(spark):
    rows = [(i, f"http://x/{i}", f"page {i}", "f", "h") for i in range(6000)] + [(None, None, None, "f", "h"), (7, "http://x/7", "once", "f", "h"), (7, "http://x/7", "again", "f", "h")]
    hurt = [(i, u, h[:-1] if i == 4500 else "other" if h == "once" else h, f, x) for i, u, h, f, x in rows if i not in (100, 5000)]
    hurt += [(2000, "http://x/2000", "second", "f", "h"), (9001, "u", "new", "f", "h")]
    got, found = changes(spark.createDataFrame(rows, PAGES), spark.createDataFrame(hurt, PAGES))
    assert found == Counter([(7, "damaged"), (100, "missing"), (2000, "added"), (4500, "damaged"), (5000, "missing"), (9001, "added")])
    assert len(got) == len(rows) + 2
    moved = {r["page_id"] for r in got if r["status"] == "moved"}
    # The last file's records behind 4500 lie one byte earlier; those ahead of the first change lie where they were.
    assert set(range(4501, 6000)) - {5000} <= moved and not moved & {*range(7), *range(4096, 4500), None}
    assert all(r["found_sha256"] == r["sha256"] for r in got if r["status"] in ("intact", "moved"))


def test_audit_of_files_with_many_records(spark):
    rows = [(5, "u", f"text {i:05}", "f", "h") for i in range(9000)] + [(6, "u", "same", "f", "h")] * 9000 + [(5000 + i, "u", f"{i:05}", "f", "h") for i in range(40)]
    rows += [(None, "u", "null", "f", "h")] * 9000
    pages = spark.createDataFrame(rows, PAGES)
    made = warc.archive(pages).collect()
    slots = {}
    for r in sorted(made, key=lambda r: (r["file"], r["slot"])):
        n, at = slots.get(r["file"], (0, 0))
        assert (r["slot"], r["offset"]) == (n + 1, at)
        slots[r["file"]] = n + 1, at + r["length"]
    assert len(made) == len(rows) and sorted(n for n, _ in slots.values()) == [40, 9000, 18000]
    hurt = spark.createDataFrame([(i, u, "Text 00123" if h == "text 00123" else "0000x" if h == "00007" else h, f, x) for i, u, h, f, x in rows], PAGES)
    got, found = changes(pages, hurt)
    assert len(got) == len(rows) and found == Counter([(5, "damaged"), (5007, "damaged")])


def test_drill_loses_adds_and_shortens(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i}", "f", "h") for i in range(3000)], PAGES)
    got, found = changes(pages, warc.drill(pages, "00", lose="1a", add="2b", shorten="3c"))
    kind = {"00": "damaged", "1a": "missing", "2b": "added", "3c": "damaged"}
    digest = [(i, hashlib.md5(str(i).encode()).hexdigest()[:2]) for i in range(3000)]
    assert found == Counter((i, kind[d]) for i, d in digest if d in kind) and len(set(found)) > 20


def test_frequent_pre_tokens_of_all_documents(spark):
    path = vocabulary("byte_bpe_50k.json")
    docs = spark.range(0, 9000, 1, 8).selectExpr("id AS doc_id", "concat('w', id, IF(id % 1125 = 7, ' scattered', '')) AS text")
    keys, ids = token_counts.frequent_table(docs, path)
    got = dict(zip(keys.tolist(), ids.tolist()))
    texts = [f"w{i}" for i in range(9000)] + [" scattered"]
    hashes = [int(span_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0]), np.array([len(t)]))[0]) for t in texts]
    assert got == dict(zip(hashes, map(len, encoded("byte_bpe_50k.json", texts))))
    assert token_counts.frequent_table(docs, path, 1)[0].tolist() == hashes[-1:]


def test_heavy_hitters_of_all_tasks(spark):
    """Every pre-token above the summary's share is held with its piece, and the table changes no count."""
    rng = random.Random(5)
    texts = [" ".join([f"hot{rng.randint(0, 4)}" for _ in range(20)] + [f"rare{i}x{j}" for j in range(30)]) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string").repartition(7)
    found = token_counts.heavy_hitters(docs, True, 40)
    assert len(found.keys) <= 40 and {f" hot{k}".encode() for k in range(5)} <= set(found.pieces)
    assert len(token_counts.heavy_hitters(docs.limit(0), True).keys) == 0
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, vocabulary("byte_bpe_50k.json")).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate([*texts, None, ""])}
