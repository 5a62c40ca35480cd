"""Toxicity by compression distance: one zstandard dictionary from toxic text, one from ordinary text.

A window is a word with its blanks. It is compressed against both dictionaries, and the difference in length says how
much better the toxic text explains it. zstandard codes short windows too coarsely as they are (a literal costs less
than a match), so bytes are first spelt out as fixed codes of three bytes; then each match saves in proportion to its
length. The ordinary dictionary holds the commonest words of ordinary text; the toxic one holds the same and, last,
the words that toxic text has much more of, so what both know cancels out. A word's support is the number of
different words before it, which copies of a document don't raise.

A document's largest difference, and the number and share of its windows above the calibrated threshold, go into a
logistic score, fitted on labelled documents that the dictionaries have not seen.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.shared import cut, plain, quoted, remainder
from reviewloom.llm.words import Memo, Words, chain, hash_column, kept, maxima, slices, totals

SAMPLE = {1: 2500, 0: 5000}  # labelled documents, about, that the model is fitted on, by label
SUPPORT, RATIO = 4, 8.0  # a word: so many different words before it; a toxic one: so many times its share in ordinary text
REMEMBERED = 1 << 18  # words whose difference a worker keeps; the others are compressed again
LONGEST = 48  # longer words are compressed in slices of so many bytes
_CODES = np.random.RandomState(5).randint(0, 256, (256, 3)).astype(np.uint8)


def spelt(text: bytes) -> bytes:
    return _CODES[np.frombuffer(text, np.uint8)].tobytes()


def compressor(text: bytes) -> zstandard.ZstdCompressor:
    """A compressor whose dictionary is this text; strategy and tables suit windows of a few dozen bytes."""
    made = zstandard.ZstdCompressionDict(spelt(text), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    reach = max(15, (3 * len(text)).bit_length())  # matches may lie anywhere in the dictionary
    how = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, window_log=reach + 2, hash_log=reach, chain_log=reach, search_log=5, min_match=3,
        target_length=32, strategy=zstandard.STRATEGY_BTOPT, write_checksum=False, write_content_size=False, write_dict_id=False)
    made.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=made, compression_params=how)


class Distance:
    """Difference of a window's two compressed lengths; each distinct word is compressed once for a worker."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = compressor(ordinary), compressor(ordinary + toxic)
        self.memo = Memo(REMEMBERED)

    def of(self, word: bytes) -> int:
        best = -(1 << 15)
        for i in range(0, len(word), LONGEST):
            x = spelt(b" " + word[i : i + LONGEST] + b" ")
            best = max(best, len(self.ordinary.compress(x)) - len(self.toxic.compress(x)))
        return best

    def words(self, words: Words) -> np.ndarray:
        keys, at, which = np.unique(words.hash, return_index=True, return_inverse=True)
        self.memo.room()
        _, known = self.memo.find(keys)
        if len(new := np.flatnonzero(~known)):
            self.memo.learn(keys[new], np.array([self.of(words.word(i)) for i in at[new]], np.int64))
        return self.memo.find(keys)[0][which.reshape(-1)]


class Model:
    """Dictionaries, threshold and weights. Without toxic or ordinary examples every score is `prior`."""

    def __init__(self, ordinary: bytes = b"", toxic: bytes = b"", prior: float = 0.0):
        self.ordinary, self.toxic, self.prior = ordinary, toxic, prior
        self.threshold, self.weights = 10, None

    def features(self, top: np.ndarray, hits: np.ndarray, n: np.ndarray) -> np.ndarray:
        top = np.clip(top, 0, 24)
        share = np.log1p(100 * hits / np.maximum(n, 1))
        return np.column_stack([np.ones(len(top)), top / 4, np.log1p(hits), share])

    def scores(self, top: np.ndarray, hits: np.ndarray, n: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(top), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.features(top, hits, n) @ self.weights, -30, 30)))

    def fit(self, rows: list[tuple[int, np.ndarray, int, float]]) -> None:
        """rows: (label, windows per difference 0..24, words, weight). The threshold with the best fit is kept."""
        label, weight = np.array([r[0] for r in rows], float), np.array([r[3] for r in rows])
        table, n = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows])
        top = np.where(table.any(1), 24 - np.argmax(table[:, ::-1] > 0, axis=1), 0)
        best = math.inf
        for threshold in range(4, 19):
            x = self.features(top, table[:, threshold:].sum(1), n)
            w = np.zeros(x.shape[1])
            for _ in range(40):  # Newton steps with a small ridge
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                ridge = np.diag([1e-6, 1e-2, 1e-2, 1e-2]) * weight.sum() / 100
                step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge, x.T @ (weight * (label - p)) - ridge @ w)
                w += np.clip(step, -5, 5)
            p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
            loss = -(weight * (label * np.log(p) + (1 - label) * np.log(1 - p))).sum()
            if loss < best:
                best, self.threshold, self.weights = loss, threshold, w


def _distance(ordinary: bytes, toxic: bytes) -> Distance:
    return kept(("distance", ordinary, toxic), lambda: Distance(ordinary, toxic))


def train(docs: DataFrame, labels: DataFrame, fold: int = 5, sample: dict[int, int] = SAMPLE) -> Model:
    """A model from labelled documents whose crc32(doc_id) modulo `fold` is not 0.

    At most about `sample` different documents of each label are used, chosen by a hash of the id and, where ids repeat,
    of the text too; repeated rows are used once. They are split once more, two thirds for the dictionaries and one
    third for threshold and weights.
    """
    toxic = F.col("toxic").cast("int")
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), toxic.alias("toxic"))
             .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id"), fold) != 0))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    count = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(count) < 2:
        return Model(prior=float(1 in count))
    share = {k: min(1.0, sample[k] / n) for k, n in count.items()}
    below = lambda part: F.when(F.col("toxic") == 1, int(part[1] * (1 << 40)) + 1).otherwise(int(part[0] * (1 << 40)) + 1)
    ids = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < below(share))
    # The ids are at most about sum(sample.values()), so they can go to every executor.
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(ids), "doc_id").where("text IS NOT NULL")
    many = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    part = {k: 1.0 if many.get(k, 0) <= 1.2 * sample[k] else sample[k] / many[k] for k in sample}  # under 1 only where ids repeat
    share = {k: share[k] * part[k] for k in share}
    chosen = cut(rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < below(part)).dropDuplicates(["doc_id", "text"])
                .withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3))))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                if not len(words.start):
                    continue
                before = np.concatenate([[0], words.hash[:-1]]).astype(np.uint64)
                before[words.first[:-1][words.count > 0]] = 0
                label = part.column("toxic").to_numpy()[words.row]
                key = chain(chain(before, words.hash), label.astype(np.uint64))
                _, at = np.unique(key, return_index=True)
                made, ahead, marks = [], [], []
                for i in at.tolist():
                    word, last = words.word(i), int(before[i])
                    for j in range(0, len(word), LONGEST):
                        made.append(word[j : j + LONGEST]), ahead.append(last), marks.append(label[i])
                        last = int.from_bytes(blake2b(made[-1], digest_size=8).digest(), "little")
                yield pa.record_batch([pa.array(made, pa.binary()), hash_column(np.array(ahead, np.uint64)), pa.array(marks, pa.int32())], ["word", "before", "toxic"])

    of = lambda k: F.count(F.when(F.col("toxic") == k, 1))
    support = (chosen.where("part > 0").select("text", "toxic").mapInArrow(pairs, "word binary, before long, toxic int").distinct()
               .groupBy("word").agg(of(1).alias("t"), of(0).alias("o")))
    size = {r["toxic"]: r["n"] for r in chosen.where("part > 0").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return Model(prior=0.0)
    ratio = (F.col("t") / size[1]) / ((F.col("o") + 0.5) / size[0])
    support = cut(support.where(f"t >= {SUPPORT} OR o >= {SUPPORT}"))
    # Each of these words stands in the sample SUPPORT times or more, so the sample bounds the dictionaries.
    told = (F.col("t") >= SUPPORT) & (ratio >= RATIO)
    bad = support.where(told).orderBy(F.desc("t"), "word").collect()
    good = support.where(~told & (F.col("o") >= SUPPORT)).orderBy(F.desc("o"), "word").collect()

    def text(rows: list) -> bytes:
        return b" " + b" ".join(bytes(r["word"]) for r in reversed(rows)) + b" "  # the commonest last, where a match costs least

    model = Model(text(good), text(bad))
    ordinary, toxic_text = model.ordinary, model.toxic

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _distance(ordinary, toxic_text)
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                rows = np.zeros((part.num_rows, 25), np.int64)
                np.add.at(rows, (words.row, np.clip(own.words(words), 0, 24)), 1)
                yield pa.record_batch([pa.array(list(rows), pa.list_(pa.int64())), pa.array(words.count.astype(np.int64)), part.column("toxic")], ["table", "n", "toxic"])

    seen = chosen.where("part = 0").select("text", "toxic").mapInArrow(tables, "table array<long>, n long, toxic int").collect()
    if {r["toxic"] for r in seen} == {0, 1}:
        model.fit([(r["toxic"], np.array(r["table"]), r["n"], 1 / share[r["toxic"]]) for r in seen])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_windows, n_toxic of each row; every other column of `docs` stays (those names are replaced).

    Null and empty texts have no window and get the score of a text without toxic windows.
    """
    keep = [c for c in docs.columns if c not in ("score", "n_windows", "n_toxic")]
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    docs, names = plain(docs, keep), keep
    keep = docs.columns
    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.schema) + ", score double, n_windows long, n_toxic long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shared.value)
        own = _distance(model.ordinary, model.toxic)
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                d = own.words(words)
                hits, top = totals(d >= model.threshold, words.first), maxima(d, words.first)
                yield pa.record_batch([*part.columns, pa.array(model.scores(top, hits, words.count), pa.float64()), pa.array(words.count.astype(np.int64)), pa.array(hits.astype(np.int64))],
                                      [*keep, "score", "n_windows", "n_toxic"])

    return docs.mapInArrow(run, schema).toDF(*names, "score", "n_windows", "n_toxic")


def classify(docs: DataFrame, labels: DataFrame, fold: int = 5) -> DataFrame:
    """One row per document: doc_id, held_out (crc32 of the id modulo `fold` is 0), score (0 to 1), predicted (0 or 1).

    Labels are learnt only from documents that are not held out; only the text decides a score. Repeated rows and ids
    keep their row each; an empty table gives an empty result; without labels of both kinds the score is constant.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = score(docs, train(docs, labels, fold))
    return out.select("doc_id", (remainder(F.col("doc_id"), fold) == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_windows", "n_toxic")
