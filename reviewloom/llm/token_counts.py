"""Token counts of whole texts by a two-tier lookup inside each task; no pre-token is ever shuffled.

Tier one is a broadcast table from the hash of a frequent pre-token (a word with the blank before it, or a run of
other white space) to its number of ids: FREQUENT entries at most, 16 bytes each, whatever the corpus holds. What it
misses is encoded by the library once for a worker and kept in the worker's cache, which starts anew when full. The
table only saves time, and no token count depends on it. Its entries are the heavy hitters of all documents: each task
keeps a Misra-Gries summary of FREQUENT counters (at least), and summaries are merged pairwise in a tree, so that neither a task
nor the driver ever holds more than a few of them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.pieces import cuts, pieces
from reviewloom.llm.words import slices, span_hashes

FREQUENT = 1 << 14  # entries of the broadcast table, and counters of a summary


class Summary:
    """Misra-Gries counters of pre-tokens by hash, with the pre-tokens themselves.

    A pre-token that makes up more than 1 / (size + 1) of all that was added, here and in merged summaries, is held.
    """

    def __init__(self, size: int = FREQUENT):
        self.size = size
        self.keys, self.n, self.pieces = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)

    def _keep(self, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys with the sums of their counts, less the largest count that finds no room."""
        keys, at = np.unique(keys, return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, at.reshape(-1), n)
        if len(keys) > self.size:
            total -= np.partition(total, len(total) - self.size - 1)[len(total) - self.size - 1]
        return keys[total > 0], total[total > 0]

    def add(self, column: pa.Array, spaces: bool) -> None:
        data, start, end, _ = cuts(column, spaces)
        keys, at, n = np.unique(span_hashes(data, start, end), return_index=True, return_counts=True)
        held, total = self._keep(np.concatenate([self.keys, keys]), np.concatenate([self.n, n]))
        pieces_of = np.empty(len(held), object)
        if len(self.keys):
            old = np.minimum(np.searchsorted(self.keys, held), len(self.keys) - 1)
            known = self.keys[old] == held
            pieces_of[known] = self.pieces[old[known]]
        else:
            known = np.zeros(len(held), bool)
        new = np.flatnonzero(~known)
        place = at[np.searchsorted(keys, held[new])]
        pieces_of[new] = [data[a:b].tobytes() for a, b in zip(start[place].tolist(), end[place].tolist(), strict=True)]
        self.keys, self.n, self.pieces = held, total, pieces_of

    def merge(self, other: Summary) -> Summary:
        out = Summary(self.size)
        keys, pieces_of = np.concatenate([self.keys, other.keys]), np.concatenate([self.pieces, other.pieces])
        out.keys, out.n = self._keep(keys, np.concatenate([self.n, other.n]))
        order = np.argsort(keys, kind="stable")
        out.pieces = pieces_of[order[np.searchsorted(keys, out.keys, sorter=order)]]
        return out


def heavy_hitters(docs: DataFrame, spaces: bool, size: int = FREQUENT) -> Summary:
    """One summary of the pre-tokens of all texts; docs: text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Summary(size)
        for batch in batches:
            for part in slices(batch):
                found.add(part.column(0), spaces)
        yield pa.record_batch([pa.array([pickle.dumps(found)], pa.binary())], ["summary"])

    rows = docs.select("text").mapInArrow(count, "summary binary").rdd
    return rows.map(lambda r: pickle.loads(r[0])).treeAggregate(Summary(size), Summary.merge, Summary.merge, depth=3)


def frequent_table(docs: DataFrame, path: str, size: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, numbers of ids) of the commonest pre-tokens of all documents."""
    own = pieces(path)
    found = heavy_hitters(docs, own.spaces, max(size, FREQUENT))
    top = np.sort(np.lexsort((found.keys, -found.n))[:size])
    ids = [len(own.tokenizer.encode(x.decode("utf-8", "replace"), add_special_tokens=False).ids) for x in found.pieces[top]]
    return found.keys[top], np.array(ids, np.int64)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens).

    Null text counts as empty (0 bytes, 0 tokens); repeated rows and ids each keep their row; other columns are not
    read. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keys, ids = frequent_table(docs, path)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((keys, ids))
    table_id = int(shared._jbroadcast.id()) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path, shared.value, table_id)
        for batch in batches:
            for part in slices(batch):
                size = pc.cast(pc.fill_null(pc.binary_length(part.column(1)), 0), pa.int64())
                n = own.counts(part.column(1))
                yield pa.record_batch([part.column(0), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
