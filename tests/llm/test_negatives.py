import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import negatives

COLUMNS = "vec_id long, embedding array<float>, label int, score int, shard string, uid int"


def brute(rows, best=5):
    part = []
    for r in rows:
        i, e, label = r["vec_id"], r["embedding"], r["label"]
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        label = math.fmod(label + 1, 10) if i is not None and i % 7 == 0 else label
        part.append((negatives.LAST if i is None else i, label, [math.floor(256 * x) for x in e]))
    out = []
    for k, (i, label, q) in enumerate(part):
        if i % 100 or i == negatives.LAST:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, o[2])), o[0], o[1] == label) for j, o in enumerate(part) if j != k)
        for p in [x for x in scored if x[2]][:best]:
            fits = [x for x in scored if not x[2] and 80 * -p[0] <= 100 * -x[0] <= 100 * -p[0]]
            out += [(i, p[1], n, x[1], -p[0], -x[0]) for n, x in enumerate(fits[:best], 1)]
    return sorted(tuple(None if v == negatives.LAST else v for v in r) for r in out) if all(r[1] != negatives.LAST and r[3] != negatives.LAST for r in out) else out


def table(spark, rows):
    return spark.createDataFrame([(i, None if e is None else [float(x) if x is not None else None for x in e], label, 1, "s", 2) for i, e, label in rows], COLUMNS)




def test_equals_brute_force(spark):
    rng = np.random.RandomState(1)
    centres = rng.randn(4, 12)
    rows = [(i, (centres[i % 3] + 0.4 * rng.randn(12)) * 0.3, int(rng.randint(4))) for i in range(1, 640)]
    df = table(spark, rows)
    got = sorted(map(tuple, negatives.mine_by_id(df).collect()))
    assert got == brute(df.collect()) and len(got) > 50


def test_odd_rows(spark):
    """Nulls, non-finite components, ties, repeated rows, equal ids, short and empty vectors, negative scores."""
    e = [0.5, 0.25, -0.1]
    rows = [(0, e, 1), (100, e, 2), (100, e, 2), (200, [-0.5, 0.2, 0.0], 1), (300, None, 1), (400, e, None), (500, [0.1, None, 0.2], 1), (600, [math.nan, 0.0, 1.0], 1),
            (700, [math.inf, 0.0, 1.0], 1), (800, [0.5], 3), (900, [], 1), (1000, [0.0, 0.0, 0.0], 2), (None, [0.01, 0.0, 0.0], 7), (-100, e, 9), (-7, e, 9)]
    rows += [(i, e, i % 3) for i in range(1, 30)] + [(i, [0.45, 0.2, 0.0], 2) for i in range(30, 40)] * 2
    df = table(spark, rows)
    assert sorted(map(tuple, negatives.mine_by_id(df).collect())) == brute(df.collect())
    assert negatives.mine_by_id(df.limit(0)).collect() == []
    assert negatives.mine_by_id(df.where("label is null")).collect() == []
    assert negatives.mine_by_id(table(spark, [(0, [], 1), (1, [], 1), (2, [], 2)])).count() == 1
    with pytest.raises(ValueError, match="too large"):
        negatives.mine_by_id(table(spark, [(0, [1e12], 1), (1, [1.0], 1)]))


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = [r.tobytes() for r in negatives.hilbert(cells, bits)]
        path = cells[sorted(range(len(keys)), key=keys.__getitem__)]
        assert len(set(keys)) == len(cells)
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_bounds_hold_every_product():
    rng = np.random.RandomState(2)
    a, x = rng.randint(-200, 200, (9, 16)), rng.randint(-200, 200, (40, 16))
    low, high = negatives.bounds(a, x.min(0)[None], x.max(0)[None])
    s = a @ x.T
    assert (low <= s.min(1)[:, None]).all() and (s.max(1)[:, None] <= high).all()
    exact = negatives.bounds(a, x[:1], x[:1])
    assert (exact[0] == s[:, :1]).all() and (exact[1] == s[:, :1]).all()
    big = rng.randint(-(1 << 26), 1 << 26, (3, 16))
    assert (negatives.products(big, big) == big @ big.T).all()


def test_blocks_that_cannot_matter_are_not_chosen(spark):
    """Far groups of vectors: an anchor's windows touch only its own group's blocks."""
    rng = np.random.RandomState(3)
    group = lambda i: np.eye(8)[i % 8] * 0.9 + 0.02 * rng.rand(8)
    df = table(spark, [(i, group(i), i % 2) for i in range(3200)])
    rows = negatives.prepared(df, F.col("label"), F.col("vec_id") % 100 == 0)
    blocks, zones, dims, shards = negatives.lay_out(rows, 5)
    anchors = blocks.where("anchor").select("uid", F.col("label").alias("a_label"), F.col("vec").alias("a_vec"), F.array("least").alias("above"), F.array(F.lit(1 << 60)).alias("below"))
    chosen = negatives.choose(zones, anchors, negatives._Search(dims, 5, True), shards)
    asked = chosen.where("kind = 'anchor'").agg(F.sum(F.bit_count(F.conv(F.hex("need"), 16, 10).cast("long")))).first()[0]
    assert 0 < asked < 0.4 * zones.count() * anchors.count()
