"""Merkle manifest of a document table: a leaf per row, a tree per source, one root over the sources, proofs by labels.

Every node carries the interval [lo, hi) of the leaf ranks it covers in its tree (a nested-interval label) and the labels
and digests of its parts. A node's ancestors are the nodes whose intervals contain its own; they are attached from the
root down by a join per level on (tree, bucket), where a level's bucket is the rank divided by the width of that level's
nodes, with containment checked. A node's siblings are the parts in what is left of the parent's interval without its
own: those that end before it and those that begin after it.

Ranks come from one range partitioning by (tree, order) and counts per partition, so a source that holds most rows is
spread like any other; levels shrink by the fanout, and no group is larger than it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.shared import cut

FANOUT = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
STEP = "array<struct<left:string,right:string>>"


def leaf(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each `-` where null, else its UTF-8 byte count, a colon and the value."""
    def coded(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*(coded(c) for c in fields)), 256)


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """The rows with lo (from 0 in their tree, by `order`), hi and n (rows of the tree). Rows must stand written (cut)."""
    seq, at = F.col("_seq"), F.shiftright(F.col("_seq"), 33)
    placed = cut(rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("_seq", F.monotonically_increasing_id()))
    parts = placed.groupBy(tree, at.alias("_part")).agg(F.min("_seq").alias("_first"), F.count("*").alias("_rows"))
    own = Window.partitionBy(tree)
    ahead = F.sum("_rows").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(tree, "_part", "_first", F.coalesce(ahead, F.lit(0)).alias("_ahead"), F.sum("_rows").over(own).alias("n"))
    lo = F.col("_ahead") + seq - F.col("_first")
    out = placed.withColumn("_part", at).join(parts, [tree, "_part"]).withColumn("lo", lo).withColumn("hi", lo + 1)
    return out.drop("_seq", "_part", "_first", "_ahead", "_rows")


def build(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of all trees, leaves first: tree, lo, hi, n, digest, parts (lo, hi, digest of what each node is made of).

    leaves: tree, lo, hi, n, digest. A tree has no nodes above its root, the first node that covers all of it.
    """
    none = F.array().cast("array<struct<lo:bigint,hi:bigint,digest:string>>")
    levels = [leaves.select("tree", "lo", "hi", "n", "digest", none.alias("parts"))]
    most, width = leaves.agg(F.max("n")).first()[0] or 0, 1
    while width < most:
        bucket = F.floor(F.col("lo") / F.lit(width * fanout))
        parts = F.array_sort(F.collect_list(F.struct("lo", "hi", "digest")))
        made = levels[-1].where(F.col("n") > width).groupBy("tree", "n", bucket.alias("bucket")).agg(parts.alias("parts"))
        digest = F.sha2(F.array_join(F.transform("parts", lambda p: p["digest"]), ""), 256)
        levels.append(cut(made.select("tree", F.element_at("parts", 1)["lo"].alias("lo"), F.element_at("parts", -1)["hi"].alias("hi"), "n", digest.alias("digest"), "parts")))
        width *= fanout
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, level, digest) of the root of each tree."""
    tops = [x.where("lo = 0 AND hi = n").select("tree", F.lit(i).alias("level"), "digest") for i, x in enumerate(levels)]
    return reduce(DataFrame.unionByName, tops)


def attach(levels: list[DataFrame], above: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Leaves with `steps` (left and right siblings' digests joined, from the leaf's level up) and `top` (their root's).

    above: (tree, level, top, steps) of each root, whose steps go on above it.
    """
    sides = lambda lo, hi: F.struct(*(  # noqa: E731  the parts in the parent's interval without [lo, hi)
        F.array_join(F.transform(F.filter("u_parts", inside), lambda p: p["digest"]), "").alias(side)
        for side, inside in (("left", lambda p: p["hi"] <= lo), ("right", lambda p: p["lo"] >= hi))))
    done = None
    for i in range(len(levels) - 1, -1, -1):
        width = fanout ** (i + 1)
        bucket = F.floor(F.col("lo") / F.lit(width))
        nodes = levels[i].withColumn("bucket", bucket)
        tops = nodes.where("lo = 0 AND hi = n").join(above.where(F.col("level") == i).drop("level"), "tree").drop("bucket")
        if done is not None:
            ancestors = done.select(F.col("tree"), bucket.alias("bucket"), F.col("lo").alias("u_lo"), F.col("hi").alias("u_hi"), F.col("parts").alias("u_parts"), F.col("steps").alias("u_steps"), F.col("top"))
            held = nodes.where("hi - lo < n").join(ancestors, ["tree", "bucket"]).where("u_lo <= lo AND hi <= u_hi")
            steps = F.concat(F.array(sides(F.col("lo"), F.col("hi"))).cast(STEP), F.col("u_steps"))
            tops = tops.unionByName(held.withColumn("steps", steps).select(*tops.columns))
        done = cut(tops) if i else tops
    return done


def fold(digest: Column, steps: Column) -> Column:
    """The root that a leaf's digest and its steps lead to."""
    return F.aggregate(steps, digest, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof(steps: Column) -> Column:
    """SHA-256 of all siblings' digests, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(rows: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Rows (doc_id, source, leaf, any others) with lo, hi, n, subroot, root and steps.

    In a source leaves ascend by doc_id, null first; rows of one id by their leaves, and equal rows, which are
    interchangeable, in any order. A null source is the first one. An empty table gives no rows.
    """
    clash = {"tree", "row", "lo", "hi", "n", "steps", "top", "subroot", "root", "digest", "parts", "level", "bucket"} & set(rows.columns)
    if clash:
        raise ValueError(f"rename or drop {sorted(clash)}")
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias("tree")
    rows = cut(rows.select("*", tree, F.monotonically_increasing_id().alias("row")))
    rows = cut(ranked(rows, "tree", ["doc_id", "leaf", "row"]))
    levels = build(rows.withColumnRenamed("leaf", "digest"), fanout)
    subroots = cut(roots(levels).select(F.col("tree").alias("own"), "level", F.col("digest").alias("subroot"), F.lit("").alias("tree")))
    tops = cut(ranked(subroots, "tree", ["own"]).withColumnRenamed("subroot", "digest"))
    upper = build(tops, fanout)
    first = roots(upper).first()
    root = first["digest"] if first else None
    empty = F.array().cast(STEP).alias("steps")
    over = attach(upper, roots(upper).select("tree", "level", F.col("digest").alias("top"), empty), fanout)
    above = cut(tops.select("own", "lo", "level", "digest").join(over.select("lo", "steps"), "lo")
                .select(F.col("own").alias("tree"), "level", F.col("digest").alias("top"), "steps"))
    steps = attach(levels, above, fanout).select("tree", "lo", F.col("top").alias("subroot"), "steps")
    return rows.join(steps, ["tree", "lo"]).withColumn("root", F.lit(root)).drop("tree", "row")


def audit(docs: DataFrame, found: Column, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of `docs`.

    found: the text as it is now, an expression over doc_id and text. Its leaf and the siblings of the manifest are
    folded up to the root; `verified` tells whether that is the manifest's root. Null ids and texts, repeated rows and
    rows that share an id each keep a row of their own; other columns than the documents' are not read.
    """
    docs = docs.select(*(F.col(c).cast("long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in FIELDS))
    now = [F.col(c) for c in FIELDS[:-1]] + [found]
    rows = docs.select("doc_id", "source", leaf([F.col(c) for c in FIELDS]).alias("leaf"), leaf(now).alias("found"))
    folded = fold(F.col("found"), F.col("steps")).alias("folded_root")
    out = manifest(rows, fanout).select("doc_id", "leaf", "subroot", "root", proof(F.col("steps")).alias("proof_sha256"), folded)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def stripped(doc_id: Column, text: Column) -> Column:
    """The drill's tampering: the text without line feeds where the CRC-32 of the decimal id is even; a null id has none."""
    even = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
