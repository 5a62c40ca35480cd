"""Language-model scores from a weighted backoff automaton over word n-grams.

States are contexts of up to `order` - 1 tokens that training has seen, and the root. A seen n-gram is an arc of its
context with the weight log10 p(word | context), p = (c(context word) + K p(word | shorter context)) / (c(context) + K),
to the state of the longest context that it ends in; every other word takes the failure arc to the next shorter context,
with the weight log10(K / (c(context) + K)), and tries there. The root has an arc for each word,
p(word) = (c(word) + 1) / (N + V + 1). K has a value for each length of context. A text is one traversal from left to
right that carries the state and adds up the weights. The token that ends a text is also the context of its first word.

The automaton grows with the corpus, so no machine holds it whole. Documents are dealt into buckets of text; a bucket
sends the n-grams it meets, with its own training counts, to the shards of the key space, each shard sums them over all
buckets and answers every bucket with the totals of its keys, in its order. A bucket then builds exactly the part of the
automaton that its texts can reach. Keys travel sorted and packed, totals without keys. Buckets and shards are equally
many; from ROOT_BYTES of input on, a bucket grows as the root of the input, and so does their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.shared import cut, remainder
from reviewloom.llm.words import Words, chain, slices

BUCKET_BYTES = 8 << 20  # text of a bucket below ROOT_BYTES of input
ROOT_BYTES = 64 << 30
K = (200.0,)  # weight of the shorter context's distribution, by length of context; the order is one more
LANE = 128  # tokens of a text that are traversed in one lane
_END = np.uint64(0x14057B7EF767814F)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane by byte plane, compressed."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_keys(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(flat.reshape(8, -1).T).view("<u8").reshape(-1), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_counts(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view("<u8").reshape(-1).astype(np.int64)


def pack_texts(docs: DataFrame) -> DataFrame:
    """The documents with their texts compressed one by one: they are dealt twice, and this halves what travels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch):
                made = pa.array([press.compress(t.encode()) for t in part.column("text").to_pylist()], pa.binary())
                yield pa.record_batch([made if n == "text" else part.column(n) for n in part.schema.names], part.schema.names)

    schema = ", ".join(f"{f.name} {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, schema)


def unpack_texts(packed: pa.ChunkedArray) -> pa.Array:
    press = zstandard.ZstdDecompressor()
    return pa.array([press.decompress(x).decode() for x in packed.to_pylist()], pa.large_string())


class Grams:
    """The n-grams of some texts. `token` holds each text's words between two ends, `first` where each text starts.

    keys[j]: the sorted distinct (j + 1)-grams that are read somewhere; at[j]: the places of the last token of each
    reading; seen[j]: one such place for each key; index[j]: the key read at each place of `token`.
    """

    def __init__(self, texts: pa.Array, order: int):
        words = Words(texts)
        self.first = words.first + 2 * np.arange(len(words.first))
        self.token = np.full(self.first[-1], _END, np.uint64)
        inner = np.ones(len(self.token), bool)
        inner[self.first[:-1]] = inner[self.first[1:] - 1] = False
        self.token[inner] = words.hash
        place = np.arange(len(self.token)) - np.repeat(self.first[:-1], np.diff(self.first))
        self.keys, self.at, self.seen, self.index = [], [], [], []
        gram = self.token
        for j in range(order):
            if j:
                gram = np.concatenate([gram[:1], chain(gram[:-1], self.token[1:])])
            at = np.flatnonzero(place >= max(j, 1))
            keys, seen, which = np.unique(gram[at], return_index=True, return_inverse=True)
            index = np.full(len(gram), -1, np.int32)
            index[at] = which
            self.keys.append(keys), self.at.append(at), self.seen.append(at[seen]), self.index.append(index)
        self.index[0][self.first[:-1]] = self.index[0][self.first[1:] - 1]  # the start is the end as a context


def shard_ranges(keys: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """(shard, begin, end) of each shard that has some of the sorted keys; shards are equal ranges of the upper 32 bits."""
    shard = ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    begin = np.flatnonzero(np.diff(shard, prepend=-1))
    return list(zip(shard[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(keys)], strict=True))


def count(docs: DataFrame, shards: int, order: int) -> DataFrame:
    """(bucket, shard, kind, keys, counts): the (kind + 1)-grams that each bucket meets, with its training counts."""

    def run(group: pa.Table) -> pa.Table:
        grams = Grams(unpack_texts(group.column("text")), order)
        train = np.repeat(group.column("train").to_numpy(), np.diff(grams.first))
        rows = []
        for kind, (keys, at, index) in enumerate(zip(grams.keys, grams.at, grams.index, strict=True)):
            counts = np.bincount(index[at[train[at]]], minlength=len(keys))
            rows += [(i, kind, pack_keys(keys[a:b]), pack_counts(counts[a:b])) for i, a, b in shard_ranges(keys, shards)]
        shard, kind, keys, counts = zip(*rows, strict=True)
        return pa.table({"bucket": pa.array([group.column("bucket")[0].as_py()] * len(rows), pa.int64()), "shard": pa.array(shard, pa.int32()),
                         "kind": pa.array(kind, pa.int32()), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})

    return docs.groupBy("bucket").applyInArrow(run, "bucket long, shard int, kind int, keys binary, counts binary")


def total(counted: DataFrame) -> DataFrame:
    """(bucket, shard, kind, totals, n, v): what all buckets counted, for the keys of each; n and v once for a shard."""

    def run(group: pa.Table) -> pa.Table:
        keys = [unpack_keys(x) for x in group.column("keys").to_pylist()]
        every, which = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros(len(every), np.int64)
        np.add.at(sums, which, np.concatenate([unpack_counts(x) for x in group.column("counts").to_pylist()]))
        ends = np.cumsum([len(k) for k in keys])
        totals = [pack_counts(sums[which[b - len(k) : b]]) for k, b in zip(keys, ends.tolist(), strict=True)]
        n, v = [int(sums.sum())] + [0] * (len(keys) - 1), [int((sums > 0).sum())] + [0] * (len(keys) - 1)
        return pa.table({"bucket": group.column("bucket"), "shard": group.column("shard"), "kind": group.column("kind"),
                         "totals": pa.array(totals, pa.binary()), "n": pa.array(n, pa.int64()), "v": pa.array(v, pa.int64())})

    return counted.groupBy("shard", "kind").applyInArrow(run, "bucket long, shard int, kind int, totals binary, n long, v long")


class Automaton:
    """States, arcs and failure arcs that the texts of `grams` can reach.

    State 0 is the root, the others are contexts; a context that training has not seen is no state. Arcs are sorted by
    state * words + word; sums[j]: training counts of grams.keys[j].
    """

    def __init__(self, grams: Grams, sums: list[np.ndarray], n: int, v: int, k: tuple[float, ...]):
        self.words = len(grams.keys[0])
        offset = 1 + np.concatenate([[0], np.cumsum([len(x) for x in grams.keys[:-1]])]).astype(np.int64)
        p = (sums[0] + 1) / (n + v + 1)
        self.root = np.log10(p)
        arcs = [np.arange(self.words, dtype=np.int64)]
        weights = [self.root]
        targets = [np.where(sums[0] > 0, offset[0] + arcs[0], 0) if k else np.zeros(self.words, np.int64)]
        self.fail_target, self.fail_weight = np.zeros(offset[-1], np.int64), np.zeros(offset[-1])
        for j, weight in enumerate(k, 1):
            seen = grams.seen[j]
            context, shorter = grams.index[j - 1][seen - 1], grams.index[j - 1][seen]
            own = slice(offset[j - 1], offset[j])
            self.fail_weight[own] = np.log10(weight / (sums[j - 1] + weight))
            if j > 1:
                self.fail_target[own] = offset[j - 2] + grams.index[j - 2][grams.seen[j - 1]]
            p = (sums[j] + weight * p[shorter]) / (sums[j - 1][context] + weight)
            arc = sums[j] > 0
            arcs.append((offset[j - 1] + context[arc]) * self.words + grams.index[0][seen[arc]])
            weights.append(np.log10(p[arc]))
            targets.append(offset[j] + np.flatnonzero(arc) if j < len(k) else offset[j - 1] + shorter[arc])
        arcs = np.concatenate(arcs)
        order = np.argsort(arcs, kind="stable")
        self.arc, self.weight, self.target = arcs[order], np.concatenate(weights)[order], np.concatenate(targets)[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight, next state) of reading a word in a state, for many at once."""
        state, weight, todo = state.copy(), np.zeros(len(state)), np.arange(len(state))
        while len(todo):
            here = state[todo]
            key = here * self.words + word[todo]
            at = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            found = self.arc[at] == key
            weight[todo] += np.where(found, self.weight[at], self.fail_weight[here])
            state[todo] = np.where(found, self.target[at], self.fail_target[here])
            todo = todo[~found]
        return weight, state

    def traverse(self, grams: Grams, lane: int = LANE) -> np.ndarray:
        """Log10 probability of each text. Texts go in lanes of `lane` tokens, side by side.

        A state knows order - 1 tokens at most, so a lane that starts so many tokens early at the root carries the same
        state as a traversal from the text's start; those tokens' weights don't count.
        """
        length = np.diff(grams.first) - 1
        lanes = -(-length // lane)
        text = np.repeat(np.arange(len(length)), lanes)
        skip = (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * lane
        begin = np.maximum(skip - (len(grams.keys) - 1), 0)
        steps = np.minimum(skip + lane, length[text]) - begin
        order = np.argsort(-steps, kind="stable")
        text, skip, begin, steps = text[order], skip[order], begin[order], steps[order]
        word, at, early = grams.index[0], grams.first[text] + 1 + begin, skip - begin
        start = self.target[word[grams.first[0]]]  # the root's arc of the end leads to the context of a text's start
        state, total = np.where(begin == 0, start, 0), np.zeros(len(text))
        for i in range(int(steps[0]) if len(steps) else 0):
            m = int(np.searchsorted(-steps, -i, "left"))  # lanes of more than i steps
            weight, state[:m] = self.step(state[:m], word[at[:m] + i].astype(np.int64))
            total[:m] += np.where(early[:m] <= i, weight, 0.0)
        return np.bincount(text, total, len(length))


def score(docs: DataFrame, modulus: int = 7, held: int = 2, k: tuple[float, ...] = K, bucket_bytes: int | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability).

    Learnt from the documents whose crc32(doc_id) modulo `modulus` is not `held`; n-grams of up to len(k) + 1 tokens.
    Null text counts as empty, whose one token is the end; repeated rows count and are scored each; other columns are
    not read; an empty table gives an empty result, and without training documents every token has probability 1 / 1.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       (remainder(F.col("doc_id"), modulus) != held).alias("train"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if bucket_bytes is None:
        bucket_bytes = int(BUCKET_BYTES * max(1.0, (size / ROOT_BYTES) ** 0.5))
    parts = int(max(1, -(-size // bucket_bytes)))
    order = len(k) + 1
    dealt = pack_texts(docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))))
    totals = cut(total(count(dealt, parts, order)))
    stats = totals.where("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    n, v = stats["n"], stats["v"]

    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        grams = Grams(unpack_texts(group.column("text")), order)
        shard, kind = answers.column("shard").to_pylist(), answers.column("kind").to_pylist()
        sums = [[np.zeros(0, np.int64)] for _ in range(order)]
        for i in sorted(range(len(shard)), key=shard.__getitem__):
            sums[kind[i]].append(unpack_counts(answers.column("totals")[i].as_py()))
        sums = [np.concatenate(x) for x in sums]
        own = Automaton(grams, sums, n, v, k)
        tokens = grams.index[0][grams.at[0]]
        first = grams.first - np.arange(len(grams.first))
        add = lambda x: np.add.reduceat(x[tokens], first[:-1])
        return pa.table({"doc_id": group.column("doc_id"), "held_out": pa.array(~group.column("train").to_numpy()), "n_tokens": pa.array(np.diff(first).astype(np.int64)),
                         "n_known": pa.array(add((sums[0] > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(first) - 1, n, np.int64)),
                         "base_score": pa.array(add(own.root)), "score": pa.array(own.traverse(grams))})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("bucket").cogroup(totals.groupBy("bucket")).applyInArrow(run, schema)
