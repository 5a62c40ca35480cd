"""Packing of documents into training windows by minimum bin slack.

A document's ids fill whole windows first; what is left over (shorter than a window) is packed. The plan works on the
multiset of left-over lengths, at most `window` different ones however many documents there are: a bin starts from the
longest length left, and a subset-sum dynamic programme over bit sets finds the multiset of other lengths that comes
closest to the window; it is backtracked into counts and used as often as the multiset allows. The lengths are counted
by Spark, the plan is made from that bounded histogram, and each piece finds its place from its rank among the pieces
of its length, which comes from counts per hashed bucket, so that a length that a third of all pieces have is ranked
by many tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.pieces import pieces
from reviewloom.llm.shared import cut
from reviewloom.llm.words import slices

WINDOW, END_ID = 4096, 2


def least_slack(room: int, counts: dict[int, int], lengths: list[int]) -> dict[int, int]:
    """How often each length is taken so that the sum comes closest to `room` from below.

    lengths: those with a count, shortest first. Bit b of `reach` says that the sum b can be made; each step adds a
    power of two (or the rest) of one length, and keeps the set before it for the way back.
    """
    reach, steps, goal, full = 1, [], 1 << room, (1 << (room + 1)) - 1
    for i in range(bisect_right(lengths, room) - 1, -1, -1):
        length, k = lengths[i], 1
        left = min(counts[length], room // length)
        while left and not reach & goal:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & full
            left -= k
            k *= 2
        if reach & goal:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + k
            total -= length * k
    return taken


def bin_patterns(histogram: dict[int, int], window: int) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, {length: times}) in order; together they use every length as often as the histogram has it."""
    left = {x: n for x, n in histogram.items() if n > 0}
    lengths, out = sorted(left), []
    while lengths:
        longest = lengths[-1]
        left[longest] -= 1
        taken = least_slack(window - longest, left, lengths)
        left[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        times = min(left[x] // k for x, k in taken.items())
        for x, k in taken.items():
            left[x] -= k * times
            if not left[x]:
                lengths.pop(bisect_left(lengths, x))
        out.append((times, taken))
    return out


class Places:
    """Sequence and offset of the r-th piece of a length, as arrays; at most window * window / 2 entries."""

    def __init__(self, patterns: list[tuple[int, dict[int, int]]]):
        rows, used, sequence = [], {}, 0
        for times, taken in patterns:
            offset = 0
            for length, k in sorted(taken.items(), reverse=True):
                rows.append((length, used.get(length, 0), sequence, k, offset))
                used[length] = used.get(length, 0) + k * times
                offset += length * k
            sequence += times
        self.sequences = sequence
        rows.sort()
        self.length, self.rank, self.sequence, self.each, self.offset = np.array(rows, np.int64).reshape(-1, 5).T.copy()

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = np.int64(1) << 48
        at = np.searchsorted(self.length * bits + self.rank, length * bits + rank, "right") - 1
        which, within = np.divmod(rank - self.rank[at], self.each[at])
        return self.sequence[at] + which, self.offset[at] + within * length


def tokenize(docs: DataFrame, path: str, window: int, end_id: int, with_ids: bool) -> DataFrame:
    """One row per piece of each document: its ids cut at multiples of the window.

    A null text counts as empty and has the end id alone; repeated rows and ids have their own pieces each; an empty
    table gives an empty result; other columns are not read.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            for part in slices(batch):
                flat, offsets = own.ids(part.column("text"))
                flat = flat.astype("<u4")
                total = np.diff(offsets) + 1
                many = -(-total // window)
                doc = np.repeat(np.arange(len(total)), many)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * window
                length = np.minimum(window, total[doc] - start)
                crc, ids = np.empty(len(doc), np.int64), []
                end = np.array([end_id], "<u4").tobytes()
                last = start + length == total[doc]
                a = offsets[doc] + start
                b = a + length - last
                for i, (x, y, z) in enumerate(zip(a.tolist(), b.tolist(), last.tolist(), strict=True)):
                    code = zlib.crc32(flat[x:y])
                    crc[i] = zlib.crc32(end, code) if z else code
                    if with_ids:
                        ids.append(np.append(flat[x:y], end_id).astype(np.int32) if z else flat[x:y].astype(np.int32))
                take = pa.array(doc)
                columns = [part.column("doc_id").take(take), pa.array(start), pa.array(length), pa.array(crc), pa.array(total[doc])]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.record_batch(columns, names)

    return docs.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, where asked for).

    Every document ends with `end_id`; null and empty texts are that id alone. Rows with the same doc_id are packed
    each for itself; other columns are left out; an empty table gives no piece. Sequences are numbered from 0: those
    of several pieces first, then the whole windows.
    """
    buckets = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # The windows of one huge document, and texts under one id or none, are ranked in all buckets.
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).alias("salt")
    cutted = cut(tokenize(docs, path, window, end_id, with_ids).select("*", salt))
    counts = cut(cutted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    # The histogram has at most `window` rows.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    histogram.pop(window, None)
    shared = docs.sparkSession.sparkContext.broadcast(Places(bin_patterns(histogram, window)))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = places.sequences + rank, np.zeros(len(rank), np.int64)
            rest = length < window
            sequence[rest], offset[rest] = places.find(length[rest], rank[rest])
            yield pa.record_batch([*(batch.column(c) for c in names[:5]), pa.array(sequence), pa.array(offset),
                                   *([batch.column("ids")] if with_ids else [])], names)

    # Ranks of a length run through the buckets in order.
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = (cutted.withColumn("nth", F.row_number().over(order)).join(first, ["length", "salt"])
              .withColumn("rank", (F.col("first") + F.col("nth") - 1).cast("long")))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return ranked.mapInArrow(place, schema)
