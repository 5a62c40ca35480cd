import random
from collections import Counter

import numpy as np
import pyarrow as pa

from reviewloom.llm import near_duplicates as nd
from reviewloom.llm.words import Words
from tests.llm.test_words import thue_morse


def bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a or b else 1.0


def brute(rows):
    """Class of each row: the smallest id that links of 0.8 or more reach."""
    bags = [bag(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if similarity(bags[i], bags[j]) >= nd.SIMILARITY:
                top[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return {rows[i][0]: min(groups[find(i)]) for i in range(len(rows))}


def test_signatures_estimate_weighted_similarity():
    random.seed(2)
    words = [f"w{i}" for i in range(60)]
    errors = []
    for share in (0.2, 0.5, 0.8, 0.95):
        for _ in range(12):
            a = [random.choice(words) for _ in range(300)]
            b = [w if random.random() < share else random.choice(words) for w in a]
            w = Words(pa.array([" ".join(a), " ".join(b)]))
            row, value, count = nd.multisets(w, 1)
            s = nd.bag_minhash(row, value, count, 2)
            errors.append((s[0] == s[1]).mean() - similarity(Counter(a), Counter(b)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_weights_count():
    w = Words(pa.array(["a " * 64 + "b", "a " * 16 + "b " * 49, "a " * 64 + "b"]))
    row, value, count = nd.multisets(w, 1)
    s = nd.bag_minhash(row, value, count, 3, 512)
    assert (s[0] == s[2]).all() and abs((s[0] == s[1]).mean() - 17 / 113) < 0.06


def edited(base, edits, rng):
    w = list(base)
    for i in rng.sample(range(len(w)), edits):
        w[i] = f"new{rng.random()}"
    return " ".join(w)


def test_classes_equal_brute_force_with_a_hot_group(spark, monkeypatch):
    """Copies of one base with more and more edits: some link to the base, some only to each other, some to nothing."""
    monkeypatch.setattr(nd, "BLOCK", 8)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(150)]
    rows = [(i, edited(base, rng.randint(0, 9), rng)) for i in range(60)]
    other = edited(base, 6, rng).split()
    rows += [(100 + i, edited(other, rng.randint(0, 3), rng)) for i in range(15)]
    rows += [(200 + i, " ".join(base)) for i in range(20)] + [(300 + i, f"short text {i % 3}") for i in range(9)]
    got = {r["doc_id"]: r["class_id"] for r in nd.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_odd_rows(odd_docs):
    got = sorted((r["doc_id"] or -1, r["copies"], r["class_id"]) for r in nd.classes(odd_docs).collect())
    assert len(got) == odd_docs.count()
    assert [(i, n) for i, n, _ in got if i in (1, 3, 4, 5, 8)] == [(1, 2), (3, 4), (4, 4), (5, 4), (8, 2), (8, 2)]
    assert {c for i, _, c in got if i in (3, 4, 5)} == {3}
    kept = nd.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(texts) == 7 and (2, "another text under the same id") in texts and sum(i == 8 for i, _ in texts) == 1


def test_empty_table(odd_docs):
    assert nd.classes(odd_docs.limit(0)).count() == 0 and nd.keep_one(odd_docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x", "y")], "a string, b string")
    got = {r["digest"]: r["root"] for r in nd.components(edges).collect()}
    assert len(got) == 63 and {v for k, v in got.items() if k[0] == "n"} == {"n000"} and got["y"] == "x"


def test_long_words_that_are_alike_stay_apart(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(x for n in (1024, 65536) for x in thue_morse(n))], "doc_id long, text string")
    assert sorted(r["class_id"] for r in nd.classes(docs).collect()) == [0, 1, 2, 3]
    assert nd.keep_one(docs).count() == 4
