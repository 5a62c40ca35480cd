import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from reviewloom.llm import manifest


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def coded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return H("".join(coded(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def brute_tree(digests, fanout):
    """(root, siblings of each place from the leaf up as (left, right))."""
    steps, level, place = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        for i, k in enumerate(place):
            run = range(k // fanout * fanout, min(len(level), k // fanout * fanout + fanout))
            steps[i].append(("".join(level[j] for j in run if j < k), "".join(level[j] for j in run if j > k)))
        level = [H("".join(level[j:j + fanout])) for j in range(0, len(level), fanout)]
        place = [k // fanout for k in place]
    return level[0], steps


def brute(rows, fanout=3):
    tampered = lambda r: r["text"].replace("\n", "") if r["text"] and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 else r["text"]
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in sources:
        own = sorted((r for r in rows if r["source"] == source), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees.append((own, *brute_tree([leaf(r, r["text"]) for r in own], fanout)))
    root, above = brute_tree([t[1] for t in trees], fanout)
    out = []
    for (own, subroot, steps), over in zip(trees, above, strict=True):
        for r, s in zip(own, steps, strict=True):
            acc = leaf(r, tampered(r))
            for left, right in s + over:
                acc = H(left + acc + right)
            out.append((r["doc_id"], leaf(r, r["text"]), subroot, root, H("".join(a + b for a, b in s + over)), acc, acc == root))
    return out


def key(rows):
    return sorted(rows, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("fanout", [2, 3])
def test_manifest_equals_brute_force(spark, odd_docs, fanout):
    more = [(i, f"line {i}\nnext\n{'x' * (i % 3)}", "en", [None, "b", "a", "a", "ä", "~"][i % 6], i % 5 or None, 0.5, 1, "t") for i in range(100, 164)]
    docs = odd_docs.union(spark.createDataFrame(more, odd_docs.schema)).withColumns({"tree": F.lit("x"), "root": F.lit(1), "lo": F.lit(2)})
    got = manifest.audit(docs, manifest.stripped(F.col("doc_id"), F.col("text")), fanout)
    assert got.columns == COLUMNS
    want = brute(docs.collect(), fanout)
    assert key(map(tuple, got.collect())) == key(want)
    assert {r[-1] for r in want} == {True, False}


def test_lone_rows_and_empty_tables(spark, odd_docs):
    same = manifest.audit(odd_docs.where("doc_id = 1"), F.col("text")).collect()
    assert [(r.leaf == r.subroot == r.root == r.folded_root, r.verified, r.proof_sha256) for r in same] == [(True, True, H(""))]
    assert manifest.audit(odd_docs.limit(0), F.col("text")).collect() == []
    nulls = spark.createDataFrame([(None,) * 8] * 3, odd_docs.schema)
    assert key(map(tuple, manifest.audit(nulls, F.col("text")).collect())) == key(brute(nulls.collect()))


def test_labels_and_proofs_of_a_hot_source(spark, odd_docs):
    """Intervals tile each tree and proofs grow with the logarithm."""
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    out = manifest.manifest(docs.unionByName(docs.limit(1).withColumn("source", F.lit("rare"))))
    rows = out.where("source = 'hot'").orderBy("lo").collect()
    assert [(r.lo, r.hi, r.n, r.doc_id) for r in rows] == [(i, i + 1, 500, i) for i in range(500)]
    assert {len(r.steps) for r in rows} == {6 + 1}
