"""Near duplicates by BagMinHash: weighted-Jaccard signatures, bands, and exact overlap of shingle multisets.

Each text is the multiset of its five-word shingles. A shingle with count c takes part in a hierarchy of Poisson
processes, one for each dyadic range of weights (0,1], (1,2], (2,4], ...; a point of a range has a height within it and
counts if that is at most c, and it falls into one of the signature's registers. A register keeps the first point that
falls into it, so two texts agree in a register with the probability of their weighted Jaccard similarity. Points are
only drawn up to the time at which all registers are surely full, so a signature costs shingles + registers, not their
product.

Equal texts are one node from the start. Registers are banded; a bucket of a band links its members to one of them (the
text with most copies), and links are verified on the multisets. Buckets whose members are still in different classes
then compare, block against block, every member outside the bucket's largest class with all members of other classes,
so no pair of a bucket goes unseen unless its ends are in one class already. Signatures are compared first, and a block
passes on its members that have a likely partner; those members meet again with their multisets. Both happens inside
tasks, and only members and links leave them; no group is emitted as all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.shared import cut, done_with, sized
from reviewloom.llm.words import Words, chain, mix, shingles, slices

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5  # a pair at 0.8 meets in some band but for 3 in a million
REGISTERS = BANDS * ROWS
MARGIN = 0.15  # signatures this much below the similarity (over 4 standard errors) are not verified
BLOCK = 2048  # members of a bucket that one group of a comparison has, on either side
BROADCAST_NODES = 1 << 18  # 40 bytes each; beyond that texts are joined by shuffle
_U = np.uint64


def multisets(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count) of each row's different shingles, ordered by row and shingle."""
    value, many = shingles(words, n)
    row = np.repeat(np.arange(len(many)), many)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(np.append(at, len(value)))


def bag_minhash(row: np.ndarray, item: np.ndarray, count: np.ndarray, rows: int, registers: int = REGISTERS) -> np.ndarray:
    """Signatures (rows x registers, 64-bit) of weighted sets; a row without items keeps zeros."""
    out = np.zeros((rows, registers), np.uint64)
    weight = np.bincount(row, count, rows)
    levels = np.ceil(np.log2(count)).astype(np.int64) + 1 if len(count) else np.zeros(0, np.int64)
    which = np.repeat(np.arange(len(row)), levels)
    level = np.arange(len(which)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 2 ** np.maximum(level - 1, 0), 0)
    width = np.where(level > 0, low, 1)
    owner, most = row[which], count[which]
    seed = mix(item[which] + level.astype(np.uint64) * _U(0xA0761D6478BD642F))
    horizon = (np.log(registers) + 4) / np.maximum(weight, 1)
    todo = weight > 0
    while todo.any():
        live = np.flatnonzero(todo[owner])
        time, nth = np.zeros(len(live)), 0
        keys, times, points = [], [], []
        while len(live):
            draw = mix(seed[live] + _U((2 * nth + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            time = time - np.log(((draw >> _U(11)).astype(np.float64) + 0.5) / 2.0**53) / (width[live] * registers)
            soon = time <= horizon[owner[live]]
            live, time = live[soon], time[soon]
            point = mix(seed[live] + _U((2 * nth + 2) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            height = low[live] + 1 + (((point & _U(0xFFFFFFFF)).astype(np.int64) * width[live]) >> 32)
            ok = height <= most[live]
            register = ((point >> _U(32)) * _U(registers) >> _U(32)).astype(np.int64)
            keys.append(owner[live[ok]] * registers + register[ok])
            times.append(time[ok])
            points.append(point[ok])
            nth += 1
        key, time, point = np.concatenate(keys), np.concatenate(times), np.concatenate(points)
        first = np.full(rows * registers, np.inf)
        np.minimum.at(first, key, time)
        won = time == first[key]
        flat = np.zeros(rows * registers, np.uint64)
        flat[key[won]] = point[won]
        full = todo & np.isfinite(first.reshape(rows, registers)).all(1)
        out[full] = flat.reshape(rows, registers)[full]
        todo &= ~full
        horizon = horizon * 2
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the folded words), bands (bucket keys; none for a text without words), registers (a byte each), items (shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=2 << 20):
                words = Words(part.column("text"))
                row, item, count = multisets(words)
                made = bag_minhash(row, item, count, part.num_rows)
                key = np.tile(np.arange(BANDS, dtype=np.uint64), (part.num_rows, 1))
                for k in range(ROWS):
                    key = chain(key, made[:, k::ROWS])
                keys = pa.array(key.view(np.int64).reshape(-1))
                offsets = np.concatenate([[0], np.cumsum(np.where(words.count > 0, BANDS, 0))]).astype(np.int32)
                keys = keys.take(pa.array(np.flatnonzero(np.repeat(words.count > 0, BANDS))))
                small = (made & _U(0xFF)).astype(np.uint8)
                yield pa.record_batch([part.column("doc_id"), pa.array(words.digests(), pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), keys),
                                       pa.array([x.tobytes() for x in small], pa.binary()), pa.array(np.bincount(row, count, part.num_rows).astype(np.int64))],
                                      ["doc_id", "digest", "bands", "registers", "items"])

    return docs.mapInArrow(run, "doc_id long, digest binary, bands array<long>, registers binary, items long")


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree in enough registers for the similarity."""
    least = (SIMILARITY - MARGIN) * REGISTERS
    side = lambda c: nodes.select(F.col("digest").alias(c), F.col("registers").alias(f"r{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array((a == b).sum(1) >= least))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a binary, b binary")


def expanded(value: np.ndarray) -> np.ndarray:
    """A multiset as a sorted set: the n-th copy of a value is an item of its own."""
    value = np.sort(value)
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    at = np.arange(len(value))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.sort(mix(value + nth.astype(np.uint64) * _U(0xA0761D6478BD642F)))


def _contents(docs: DataFrame, digests_of: DataFrame, nodes: DataFrame) -> DataFrame:
    """digest and the shingle multiset (expanded, packed) of the texts with these digests."""
    wanted = cut(nodes.join(digests_of, "digest", "left_semi").select(F.col("digest"), F.col("doc_id").alias("id")))
    if wanted.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                value, many = shingles(words, SHINGLE)
                same = [i for i, (x, y) in enumerate(zip(part.column("digest").to_pylist(), words.digests(), strict=True)) if x == y]
                each = np.split(value, np.cumsum(many)[:-1])
                yield pa.record_batch([part.column("digest").take(pa.array(same, pa.int64())), pa.array([expanded(each[i]).tobytes() for i in same], pa.binary())], ["digest", "shingles"])

    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("id"))).select("digest", "text")
    # Rows that repeat an id may give a digest twice.
    return texts.mapInArrow(run, "digest binary, shingles binary").groupBy("digest").agg(F.first("shingles").alias("shingles"))


def overlap(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard similarity of two expanded multisets."""
    both = np.concatenate([x, y])
    both.sort()
    common = np.count_nonzero(both[1:] == both[:-1])
    return common / (len(both) - common) if len(both) else 1.0


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose multisets overlap by SIMILARITY or more."""
    pairs = cut(_likely(pairs, nodes))
    few = sized(pairs, pairs.count())
    ends = few.select(F.col("a").alias("digest")).union(few.select(F.col("b").alias("digest"))).distinct()
    contents = cut(_contents(docs, ends, nodes))
    side = lambda c: contents.select(F.col("digest").alias(c), F.col("shingles").alias(f"s{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(v, np.uint64) for v in batch.column(c).to_pylist()] for c in ("sa", "sb"))
            ok = [overlap(p, q) >= SIMILARITY for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    links = cut(few.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a binary, b binary"))
    done_with(pairs, contents)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(digest, root) of every node of the edges (a, b): the smallest node of its component.

    Alternates links of larger neighbours and of smaller ones to the local minimum until nothing changes.
    """
    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before, now = None, state(edges)
    while now != before:
        rows, start = now[0], edges
        edges = sized(edges, rows)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sized(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), rows)
        large = sized(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), rows)
        low = sized(large.groupBy("a").agg(F.min("b").alias("m")), rows)
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = cut(sized(small.where("a <> b").distinct(), rows))
        before, now = now, state(edges)
        done_with(start)
    # What is left are stars around their smallest nodes.
    stars = edges.select(F.col("a").alias("digest"), F.col("b").alias("root"))
    found = cut(sized(stars.union(stars.select(F.col("root").alias("digest"), "root").distinct()), now[0]))
    done_with(edges)
    return found


def _likely_ends(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (left, right) of a group's pairs whose signatures and sizes allow the similarity, some at a time.

    A pair counts in the first band where it meets, and once: of two left-out members the larger digest is on the left.
    """
    left, out, band = group.column("left").to_numpy(), group.column("out").to_numpy(), group.column("band")[0].as_py()
    sign = np.frombuffer(b"".join(group.column("registers").to_pylist()), np.uint8).reshape(-1, REGISTERS)
    keys = group.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    size = group.column("items").to_numpy()
    digest = np.unique(np.array(group.column("digest").to_pylist(), object), return_inverse=True)[1].reshape(-1)
    root = np.unique(np.array(group.column("root").to_pylist(), object), return_inverse=True)[1].reshape(-1)
    x, y = np.flatnonzero(left), np.flatnonzero(~left)
    for at in range(0, len(x), 16):
        some = x[at : at + 16]
        fits = np.minimum(size[some][:, None], size[y][None]) >= SIMILARITY * np.maximum(size[some][:, None], size[y][None])
        fits &= (root[some][:, None] != root[y][None]) & ~(out[y][None] & (digest[some][:, None] <= digest[y][None]))
        i, j = np.nonzero(fits)
        for part in range(0, len(i), 1 << 15):
            p, q = some[i[part : part + (1 << 15)]], y[j[part : part + (1 << 15)]]
            near = (sign[p] == sign[q]).sum(1) >= (SIMILARITY - MARGIN) * REGISTERS
            p, q = p[near], q[near]
            first = (keys[p] == keys[q]).argmax(1) == band
            if first.any():
                yield p[first], q[first]


_ROW = "bucket long, o int, p int, left boolean, band int, digest binary, root binary, out boolean, items long, bands array<long>, registers binary"


def _with_partners(mixed: DataFrame) -> DataFrame:
    """The members of mixed buckets that have a likely partner in another class, once for each pair of blocks they are in.

    mixed: bucket, band, digest, root, out, size, outs, items, bands, registers. `out` marks members outside the bucket's
    largest class. They and all members are dealt into blocks, and each pair of blocks is one group of 2 x BLOCK rows or
    so, however large the bucket is.
    """
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    place = F.xxhash64("digest", F.lit("block"))
    upto = lambda n: F.sequence(F.lit(0), F.greatest(blocks(n) - 1, F.lit(0)))
    mine = F.pmod(place, blocks("outs")).cast("int")
    theirs = F.pmod(place, blocks("size")).cast("int")
    carried = ["band", "digest", "root", "out", "items", "bands", "registers"]
    outs = mixed.where("out").select("bucket", mine.alias("o"), F.explode(upto("size")).alias("p"), F.lit(True).alias("left"), *carried)
    alls = mixed.select("bucket", F.explode(upto("outs")).alias("o"), theirs.alias("p"), F.lit(False).alias("left"), *carried)

    def compare(group: pa.Table) -> pa.Table:
        has = np.zeros(group.num_rows, bool)
        for p, q in _likely_ends(group):
            has[p] = has[q] = True
        return group.filter(pa.array(has))

    return outs.union(alls).groupBy("bucket", "o", "p").applyInArrow(compare, _ROW)


def _cross_links(ends: DataFrame, contents: DataFrame) -> DataFrame:
    """Links (a, b) that join different classes of a bucket; ends: of _with_partners(), contents: digest, shingles.

    The multisets of a likely pair are compared if its classes are not linked yet in the group, and only links leave the
    task: fewer than the group has classes.
    """

    def compare(group: pa.Table) -> pa.Table:
        digest, root = group.column("digest").to_pylist(), group.column("root").to_pylist()
        content = [np.frombuffer(v, np.uint64) for v in group.column("shingles").to_pylist()]
        top = {r: r for r in root}

        def find(r: bytes) -> bytes:
            while top[r] != r:
                top[r] = top[top[r]]
                r = top[r]
            return r

        a, b = [], []
        for left, right in _likely_ends(group):
            for p, q in zip(left.tolist(), right.tolist(), strict=True):
                r, s = find(root[p]), find(root[q])
                if r != s and overlap(content[p], content[q]) >= SIMILARITY:
                    top[r] = s
                    a.append(digest[p])
                    b.append(digest[q])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return ends.join(contents, "digest").groupBy("bucket", "o", "p").applyInArrow(compare, "a binary, b binary")


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, digest, class_id, copies of each row; docs: doc_id, text."""
    made = cut(signatures(docs))
    nodes = cut(made.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("registers").alias("registers"), F.first("items").alias("items")))
    members = nodes.select("digest", "copies", F.posexplode("bands").alias("band", "bucket"))
    buckets = cut(members.groupBy("bucket").agg(F.count("*").alias("size"), F.max_by("digest", F.struct("copies", "digest")).alias("rep")).where("size > 1"))
    members = cut(members.drop("copies").join(buckets, "bucket"))
    done_with(buckets)
    stars = members.where("digest <> rep").select(F.greatest("digest", "rep").alias("a"), F.least("digest", "rep").alias("b")).distinct()
    links = verified(stars, docs, nodes)
    root = components(links)
    done_with(links)
    # Buckets of two are settled; of the others, those whose members are not of one class.
    placed = members.where("size > 2").join(root, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    split = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    largest = (split.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.sum("n").alias("size"), F.max("n").alias("n"))
               .where("n < size").select("bucket", "largest", "size", (F.col("size") - F.col("n")).alias("outs")))
    mixed = placed.select("bucket", "band", "digest", "root").join(largest, "bucket").withColumn("out", F.col("root") != F.col("largest")).drop("largest")
    ends = cut(_with_partners(mixed.join(nodes.select("digest", "items", "bands", "registers"), "digest")))
    contents = _contents(docs, ends.select("digest").distinct(), nodes)
    links = cut(_cross_links(ends, contents))
    done_with(members, ends)
    root = components(root.select(F.col("digest").alias("a"), F.col("root").alias("b")).union(links))
    ids = nodes.select("digest", "doc_id", "copies").join(root, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    # Where an id is repeated in different texts it may be the smallest of several classes; those get numbers of their own.
    lone = -F.shiftrightunsigned(F.xxhash64("root"), 1) - 1
    least = ids.groupBy("root").agg(F.min("doc_id").alias("least"))
    shared = F.count("*").over(Window.partitionBy("least", F.when(F.col("least").isNull(), F.col("root"))))
    least = least.select("root", F.when(F.col("least").isNull() | (shared > 1), lone).otherwise(F.col("least")).alias("class_id"))
    of = ids.join(least, "root").select("digest", "class_id", "copies")
    return made.select("doc_id", "digest").join(of, "digest").select("doc_id", "digest", "class_id", "copies")


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class), copies (rows with the same words).

    A class is what links of similarity 0.8 or more connect. Null texts and texts without words are equal to each other
    and to nothing else; texts of fewer than five words are one shingle. Repeated rows keep a row each; null ids are
    allowed; a class of nothing else, or whose smallest id another class shares, has a negative number; an empty table
    gives an empty result.
    """
    return _classes(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).select("doc_id", "class_id", "copies")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, with all its columns: of the rows with the smallest doc_id (null last) the first by text.

    The rows that stay are told by (doc_id, text); where several rows share both, one of them stays.
    """
    key = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = cut(_classes(key).select("doc_id", "digest", "class_id"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), F.coalesce("doc_id", F.lit(0)).alias("id"), "digest")).alias("best")
    kept = found.groupBy("class_id").agg(best).select(F.when(~F.col("best.lost"), F.col("best.id")).alias("kept_id"), F.col("best.digest").alias("kept"))
    # Ids that stand in the table once need no look at the text; the others compare digests and drop repeated rows.
    once = found.groupBy("doc_id").agg(F.count("*").alias("times"))
    kept = kept.join(once, F.col("kept_id").eqNullSafe(F.col("doc_id"))).select("kept_id", "kept", "times")
    rows = docs.alias("d").join(kept.alias("k"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("k.kept_id")))
    plain = rows.where("k.times = 1").select("d.*")
    if kept.where("times > 1").isEmpty():
        return plain
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.names.index("text"))
            same = [x == y for x, y in zip(batch.column(len(names)).to_pylist(), Words(text).digests(), strict=True)]
            yield batch.filter(pa.array(same, pa.bool_()))

    twice = rows.where("k.times > 1").select("d.*", F.col("k.kept").alias("kept digest"))
    twice = twice.mapInArrow(run, twice.schema).dropDuplicates(["doc_id", "kept digest"])
    return plain.union(twice.drop("kept digest"))
