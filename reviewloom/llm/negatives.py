"""Hard negatives from embeddings: blocks of Parquet rows in Hilbert order, zone maps, and interval bounds.

Rows are laid along a Hilbert curve over their quantised components, dimensions of most variance first, cut into SHARDS
ranges and those into blocks of BLOCK rows, and written to Parquet. A block's zone map is the least and greatest value
of each dimension and the labels in it. For an anchor, interval arithmetic over a zone map bounds the inner products
with every row of the block from below and above. First the blocks that may hold one of the best rows of the anchor's
own label are read; their scores give windows, and then the blocks whose bounds meet a window are read. Blocks that no
anchor asks for are not read again.

Both steps stream in tasks over (shard, anchors after rows): a task holds one shard, which has SHARD_ROWS rows at most
(up to sampling error of the ranges), and a batch of anchors. Rows sent are the anchors times the number of shards.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewloom.llm.shared import cut, shared_folder

BLOCK, CHUNK = 128, 64  # rows of a block; blocks that give an anchor its first floor
SHARDS, SHARD_ROWS = 64, 1 << 18
BITS = 2  # Hilbert cells of a dimension: 2 ** BITS
STEP = 1 << 22  # scores held at once
NONE = -(1 << 62)  # under every score
LAST = (1 << 63) - 1  # stands for a null vec_id: after all others
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def prepared(vectors: DataFrame, label: Column, anchor: Column) -> DataFrame:
    """vec_id, label, anchor, q (components times 256, rounded down) of the rows that take part.

    Left out are rows with a null label or vector, or a null or non-finite component.
    """
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) <= F.lit(np.finfo(np.float64).max), F.lit(False)))
    rows = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return rows.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST)).alias("vec_id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), q.alias("q"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """List rows as a matrix; shorter rows are filled with zeros."""
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    """Binary rows of `dims` int32 values."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(len(column), dims)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, in the smallest float type that holds every partial sum."""
    peak = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    kind = np.float32 if peak < 2**24 else np.float64 if peak < 2**53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of `a` with any vector between lo and hi, for each box."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return products(up, lo) + products(down, hi), products(up, hi) + products(down, lo)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Big-endian bytes of each row's place on the Hilbert curve through cells 0 .. 2 ** bits - 1 of each dimension."""
    x = cells.T.astype(np.uint8).copy()
    # Undo the rotations and reflections of the sub-cubes from the largest down, then take the Gray code.
    for level in range(bits - 1, 0, -1):
        low = np.uint8((1 << level) - 1)
        for i in range(len(x)):
            flip = (x[i] >> level) & 1 == 1
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low).astype(np.uint8)
            x[0] ^= np.where(flip, low, swap).astype(np.uint8)
            x[i] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)
    turn = np.zeros(x.shape[1], np.uint8)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, np.uint8((1 << level) - 1), 0).astype(np.uint8)
    x ^= turn
    planes = np.stack([(x >> level) & 1 for level in range(bits - 1, -1, -1)], 1)  # dims, bits, rows
    return np.packbits(planes.transpose(2, 1, 0).reshape(x.shape[1], -1), axis=1)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by dimension of each batch."""
    for batch in batches:
        q = batch.column("q")
        at = np.concatenate([np.arange(n) for n in np.diff(q.offsets.to_numpy())] or [np.zeros(0, int)]).astype(np.int64)
        value = q.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if len(at):
            dims = int(at.max()) + 1
            lo, hi = np.full(dims, np.inf), np.full(dims, -np.inf)
            np.minimum.at(lo, at, value)
            np.maximum.at(hi, at, value)
            sums = [np.bincount(at, v, dims) for v in (np.ones(len(at)), value, value * value)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.arange(dims), lo, hi, *sums)], ["dim", "lo", "hi", "n", "s", "ss"])


class _Layout:
    """Turns rows into blocks and zone maps along the curve."""

    KEYED = "vec_id long, label long, anchor boolean, vec binary, curve binary, row long"
    BLOCKS = "kind string, shard int, block long, uid long, vec_id long, label long, vec binary, anchor boolean, least long, lo binary, hi binary, labels binary"

    def __init__(self, lo: np.ndarray, hi: np.ndarray, order: np.ndarray, best: int):
        self.lo, self.order, self.best = lo, order, best
        self.width = np.maximum(hi - lo, 1.0)

    def keyed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column("q"), len(self.lo))
            cells = np.clip((q - self.lo) / self.width * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint8)
            vec = [r.tobytes() for r in q.astype(np.int32)]
            curve = [r.tobytes() for r in hilbert(cells[:, self.order], BITS)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("anchor"), pa.array(vec, pa.binary()), pa.array(curve, pa.binary()), batch.column("row")],
                                             ["vec_id", "label", "anchor", "vec", "curve", "row"])

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one shard in order, with their blocks; a zone row after each block's rows."""
        waiting, block = [], 0
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= BLOCK * CHUNK:
                table = pa.Table.from_batches(waiting).combine_chunks()
                full = table.num_rows // (BLOCK * CHUNK) * BLOCK * CHUNK
                for at in range(0, full, BLOCK * CHUNK):
                    yield from self._chunk(table.slice(at, BLOCK * CHUNK).combine_chunks().to_batches()[0], block)
                    block += CHUNK
                waiting = table.slice(full).to_batches()
        if sum(b.num_rows for b in waiting):
            yield from self._chunk(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0], block)

    def _chunk(self, rows: pa.RecordBatch, block: int) -> Iterator[pa.RecordBatch]:
        n, shard = rows.num_rows, rows.column("shard")[0].as_py()
        x = _vectors(rows.column("vec"), len(self.lo))
        label = rows.column("label").to_numpy()
        anchors = np.flatnonzero(rows.column("anchor").to_numpy(zero_copy_only=False))
        least = np.full(n, NONE, np.int64)
        for part in np.array_split(anchors, max(1, -(-len(anchors) * n // STEP))):
            scores = np.where(label[part][:, None] == label, products(x[part], x), NONE)
            scores[np.arange(len(part)), part] = NONE
            if n > self.best:
                least[part] = np.partition(scores, n - self.best, axis=1)[:, n - self.best]
        number = block + np.arange(n) // BLOCK
        ids = (np.int64(shard) << 32) + number
        first = np.arange(0, n, BLOCK)
        lo, hi = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
        kinds = [np.unique(label[a : a + BLOCK]).tobytes() for a in first]
        uid = ids * BLOCK + np.arange(n) % BLOCK
        schema = ["kind", "shard", "block", "uid", "vec_id", "label", "vec", "anchor", "least", "lo", "hi", "labels"]
        empty = lambda k, t: pa.nulls(k, t)
        shards = lambda k: pa.array(np.full(k, shard, np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(["row"] * n), shards(n), pa.array(ids), pa.array(uid), rows.column("vec_id"), rows.column("label"), rows.column("vec"), rows.column("anchor"), pa.array(least),
                                          *(empty(n, pa.binary()) for _ in range(3))], schema)
        k = len(first)
        yield pa.RecordBatch.from_arrays([pa.array(["zone"] * k), shards(k), pa.array(ids[first]), *(empty(k, pa.int64()) for _ in range(3)), empty(k, pa.binary()), empty(k, pa.bool_()), empty(k, pa.int64()),
                                          *(pa.array([r.tobytes() for r in z], pa.binary()) for z in (lo, hi)), pa.array(kinds, pa.binary())], schema)


def lay_out(rows: DataFrame, best: int) -> tuple[DataFrame, DataFrame, int, int] | None:
    """(rows in blocks, zone maps, dimensions, shards), written to Parquet in the shared folder; None without any row.

    A row has shard, block, uid (its own number), vec_id, label, vec, anchor and least: at least `best` rows of its label reach that score.
    """
    spark = rows.sparkSession
    n, peak = rows.agg(F.count("*"), F.max(F.array_max(F.transform("q", F.abs)))).first()
    if not n:
        return None
    spread = rows.select("q").mapInArrow(_spread, "dim long, lo double, hi double, n double, s double, ss double")
    spread = spread.groupBy("dim").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).orderBy("dim").toPandas()
    dims = max(1, len(spread))
    if peak is not None and (peak >= 1 << 30 or peak * peak * dims >= 1 << 56):
        raise ValueError(f"components up to {peak / 256} are too large for exact 64-bit scores")
    lo, hi, order = np.zeros(dims), np.zeros(dims), np.arange(dims)
    if len(spread):
        lo, hi = spread["lo"].to_numpy(), spread["hi"].to_numpy()
        order = np.argsort(-(spread["ss"] / spread["n"] - (spread["s"] / spread["n"]) ** 2).to_numpy(), kind="stable")
    layout = _Layout(np.minimum(lo, 0), np.maximum(hi, 0), order, best)
    shards = max(SHARDS, -(-n // SHARD_ROWS))
    keyed = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(layout.keyed, _Layout.KEYED)
    key = ["curve", "vec_id", "row"]
    placed = keyed.repartitionByRange(shards, *key).sortWithinPartitions(*key).withColumn("shard", F.spark_partition_id())
    folder = f"{shared_folder(spark)}/blocks-{uuid.uuid4()}"
    placed.select("shard", "vec_id", "label", "vec", "anchor").mapInArrow(layout.blocks, _Layout.BLOCKS).write.partitionBy("kind").parquet(folder)
    read = lambda kind: spark.read.schema(_Layout.BLOCKS.removeprefix("kind string, ")).parquet(f"{folder}/kind={kind}")
    shards = (read("zone").agg(F.max("shard")).first()[0]) + 1
    return (read("row").select("shard", "block", "uid", "vec_id", "label", "vec", "anchor", "least"), read("zone").select("shard", "block", "lo", "hi", "labels"), dims, shards)


ANCHOR = "shard int, uid long, a_label long, a_vec binary, above array<bigint>, below array<bigint>"


def _streamed(rows: DataFrame, anchors: DataFrame, step: Callable, schema: str) -> DataFrame:
    """step over tasks that get each shard's rows and then its anchors."""
    late = lambda df, k: df.withColumn("late", F.lit(k))
    both = late(rows, 0).unionByName(late(anchors, 1), allowMissingColumns=True)
    return both.repartition("shard").sortWithinPartitions("shard", "late").mapInArrow(step, schema)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(shard, late, rows) of runs within batches."""
    for batch in batches:
        if not batch.num_rows:
            continue
        shard, late = batch.column("shard").to_numpy(), batch.column("late").to_numpy()
        cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(late) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield int(shard[a]), int(late[a]), batch.slice(a, b - a)


def _windows(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.int64)


class _Search:
    """Chooses blocks for anchors and scores anchors against the rows of chosen blocks. same: rows of the own label, or
    of all other labels. Windows are inclusive."""

    CHOSEN = "kind string, shard int, block long, uid long, a_label long, a_vec binary, above array<bigint>, below array<bigint>, need binary"
    FOUND = "uid long, win int, score long, vec_id long"

    def __init__(self, dims: int, best: int, same: bool):
        self.dims, self.best, self.same = dims, best, same

    def choose(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors with a bit for each block of the shard that they must read; and each block that some anchor reads."""
        zones, used, at = [], None, None
        for shard, late, rows in _by_shard(batches):
            if shard != at:
                yield from self._used(at, zones, used)
                zones, used, at = [], None, shard
            if not late:
                zones.append(rows)
                continue
            if not len(zones):  # no row fell into this range
                continue
            if isinstance(zones, list):
                table = pa.Table.from_batches(zones)
                order = np.argsort(table["block"].to_numpy())
                pick = lambda c: table[c].combine_chunks().take(pa.array(order))  # noqa: E731, B023
                zones = (table["block"].to_numpy()[order], _vectors(pick("lo"), self.dims), _vectors(pick("hi"), self.dims), [np.frombuffer(x, np.int64) for x in pick("labels").to_pylist()])
                used = np.zeros(len(zones[0]), bool)
            for a in range(0, rows.num_rows, max(1, STEP // len(used))):
                part = rows.slice(a, max(1, STEP // len(used)))
                low, high = bounds(_vectors(part.column("a_vec"), self.dims), zones[1], zones[2])
                label = part.column("a_label").to_numpy()
                need = np.stack([np.isin(label, x) if self.same else ~((x[0] == label) & (len(x) == 1)) for x in zones[3]], 1)
                meets = np.zeros_like(need)
                for above, below in zip(_windows(part.column("above")).T, _windows(part.column("below")).T, strict=True):
                    meets |= (high >= above[:, None]) & (low <= below[:, None]) & (above <= below)[:, None]
                need &= meets
                used |= need.any(0)
                some = np.flatnonzero(need.any(1))
                if len(some):
                    kept = part.take(pa.array(some))
                    k = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array(["anchor"] * k), kept.column("shard"), pa.nulls(k, pa.int64()), *(kept.column(c) for c in ("uid", "a_label", "a_vec")), *(kept.column(c).cast(pa.list_(pa.int64())) for c in ("above", "below")),
                                                      pa.array([r.tobytes() for r in np.packbits(need[some], axis=1)], pa.binary())], self.NAMES)
        yield from self._used(at, zones, used)

    NAMES = ["kind", "shard", "block", "uid", "a_label", "a_vec", "above", "below", "need"]

    def _used(self, shard: int | None, zones: tuple, used: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if used is not None and used.any():
            k = int(used.sum())
            types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(["block"] * k), pa.array(np.full(k, shard, np.int32)), pa.array(zones[0][used]), *(pa.nulls(k, t) for t in types)], self.NAMES)

    def find(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best rows of each anchor and window in this shard: (uid, win, score, vec_id)."""
        held, at = [], None
        for shard, late, rows in _by_shard(batches):
            if shard != at:
                held, at = [], shard
            if not late:
                held.append(rows)
                continue
            if isinstance(held, list):
                table = pa.Table.from_batches(held).sort_by([("vec_id", "ascending")]).combine_chunks()
                number = (table["block"].to_numpy() & 0xFFFFFFFF).astype(np.int64)
                held = (table["vec_id"].to_numpy(), table["label"].to_numpy(), table["uid"].to_numpy(), _vectors(table["vec"].combine_chunks(), self.dims), number)
            for a in range(0, rows.num_rows, max(1, STEP // len(held[0]))):
                yield from self._best(rows.slice(a, max(1, STEP // len(held[0]))), *held)

    def _best(self, part: pa.RecordBatch, vec_id: np.ndarray, label: np.ndarray, uid: np.ndarray, x: np.ndarray, number: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, own = _vectors(part.column("a_vec"), self.dims), part.column("uid").to_numpy()
        need = np.unpackbits(np.frombuffer(b"".join(part.column("need").to_pylist()), np.uint8).reshape(part.num_rows, -1), axis=1).astype(bool)
        scores = np.full((len(a), len(x)), NONE, np.int64)
        for b in np.unique(number):
            who, cols = np.flatnonzero(need[:, b]), np.flatnonzero(number == b)
            if len(who):
                scores[np.ix_(who, cols)] = products(a[who], x[cols])
        alike = part.column("a_label").to_numpy()[:, None] == label
        scores[~alike if self.same else alike] = NONE
        scores[own[:, None] == uid] = NONE
        for win, (above, below) in enumerate(zip(_windows(part.column("above")).T, _windows(part.column("below")).T, strict=True)):
            inside = np.where((scores >= above[:, None]) & (scores <= below[:, None]), scores, NONE)
            for _ in range(self.best):
                top = inside.argmax(1)  # the first of equal scores: columns ascend by vec_id
                value = inside[np.arange(len(a)), top]
                who = np.flatnonzero(value > NONE)
                if not len(who):
                    break
                yield pa.RecordBatch.from_arrays([pa.array(own[who]), pa.array(np.full(len(who), win, np.int32)), pa.array(value[who]), pa.array(vec_id[top[who]])], ["uid", "win", "score", "vec_id"])
                inside[who, top[who]] = NONE


def choose(zones: DataFrame, anchors: DataFrame, search: _Search, shards: int) -> DataFrame:
    """The blocks that each anchor must read; anchors: uid, a_label, a_vec, above, below."""
    everywhere = anchors.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return cut(_streamed(zones, everywhere, search.choose, _Search.CHOSEN))


def find(rows: DataFrame, chosen: DataFrame, search: _Search) -> DataFrame:
    """(uid, win, rank, score, vec_id): the `best` rows of each anchor and window, ranked; ties by smaller vec_id."""
    blocks = chosen.where("kind = 'block'").select("shard", "block")
    asked = chosen.where("kind = 'anchor'").select("shard", F.col("uid").alias("uid"), "a_label", "a_vec", "above", "below", "need")
    held = rows.join(blocks, ["shard", "block"], "left_semi").select("shard", "block", "uid", "vec_id", "label", "vec")
    found = _streamed(held, asked, search.find, _Search.FOUND)
    # A shard has sent `best` rows at most for each.
    order = Window.partitionBy("uid", "win").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= search.best)


def mine(rows: DataFrame, best: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: see prepared(). An anchor's positives are the `best` other rows of its label by score, ties by smaller vec_id.
    For each, the `best` rows of other labels with low % to high % of the positive's score follow, in the same order.
    A null vec_id comes after all others. Repeated rows are rows of their own: each is an anchor if it is one, and a
    positive or negative of others. Shorter vectors count as filled up with zeros. An empty table gives no rows.
    """
    spark: SparkSession = rows.sparkSession
    laid = lay_out(rows, best)
    if laid is None:
        return spark.createDataFrame([], SCHEMA)
    blocks, zones, dims, shards = laid
    anchors = cut(blocks.where("anchor").select("uid", F.col("vec_id").alias("anchor_id"), F.col("label").alias("a_label"), F.col("vec").alias("a_vec"), "least"))
    own = _Search(dims, best, True)
    asked = anchors.select("uid", "a_label", "a_vec", F.array(F.greatest("least", F.lit(NONE + 1))).alias("above"), F.array(F.lit(-NONE)).alias("below"))
    positives = cut(find(blocks, choose(zones, asked, own, shards), own).select("uid", (F.col("rank") - 1).alias("win"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # No window has room under a negative score.
    score = lambda i: F.max(F.when(F.col("win") == i, F.col("positive_score")))
    told = positives.groupBy("uid").agg(F.transform(F.array(*(score(i) for i in range(best))), lambda s: F.coalesce(s, F.lit(-1))).alias("s"))
    least = F.expr(f"transform(s, x -> if(x < 0, 1L, (x * {low} + 99) div 100))")
    most = F.expr(f"transform(s, x -> if(x < 0, 0L, x * {high} div 100))")
    windows = anchors.join(told, "uid").select("uid", "a_label", "a_vec", least.alias("above"), most.alias("below"))
    others = _Search(dims, best, False)
    negatives = find(blocks, choose(zones, windows, others, shards), others)
    named = positives.join(anchors.select("uid", "anchor_id"), "uid")
    real = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias(c)
    return negatives.join(named, ["uid", "win"]).select(real("anchor_id"), real("positive_id"), F.col("rank").cast("int").alias("rank"), F.when(F.col("vec_id") != LAST, F.col("vec_id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine_by_id(vectors: DataFrame, anchor_every: int = 100, relabel_every: int = 7, labels: int = 10) -> DataFrame:
    """mine() with anchors at multiples of anchor_every; labels of every relabel_every-th id are moved on by one first."""
    label = F.when(F.col("vec_id") % relabel_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return mine(prepared(vectors, label, F.col("vec_id") % anchor_every == 0))
