"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by gradient descent.

Features are words and the byte 2- to 4-grams inside them (with their blanks), hashed to BUCKETS rows of an embedding
table. A text is the average of its features' embeddings; a softmax over a linear map gives the languages. The model is
fitted in numpy on a bounded sample of labelled documents. As both maps are linear, the trained table times the linear
map is one score per bucket and language, and a text is scored by sums over its words.

Rejection: a temperature makes the probabilities fit, and the threshold is the confidence that all but REJECTED of the
rightly labelled texts of a calibration part reach, one half at most.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.shared import cut, plain, quoted, remainder
from reviewloom.llm.words import Words, slices, totals

BUCKETS, DIM, GRAMS = 1 << 15, 16, (2, 3, 4)
SAMPLE = 800  # labelled documents, about, of each language
EPOCHS, RATE = 6, 2.0
REJECTED, HIGHEST = 0.001, 0.5  # share of right answers below the threshold; it is never above HIGHEST
STEP_BYTES = 1 << 20  # text at once; the features of its different words take some sixty times as much
_SHIFT = np.uint32(32 - 15)


def word_features(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of the words at these places, in order, and how many each word has."""
    size = words.end[at] - words.start[at] + 2
    begin = np.cumsum(size) - size
    text = np.full(int(size.sum()), 32, np.uint8)
    inner = np.arange(len(text)) - np.repeat(begin, size)
    body = (inner > 0) & (inner < np.repeat(size, size) - 1)
    text[body] = words.data[(np.repeat(words.start[at] - 1, size) + inner)[body]]
    left = np.repeat(size, size) - inner  # bytes from here to the word's end
    wide = text.astype(np.uint32)
    found = [(np.arange(len(at)), (words.hash[at] >> np.uint64(32)).astype(np.uint32))]
    which = np.repeat(np.arange(len(at)), size)
    for n in GRAMS:
        code = np.full(len(text), 0x811C9DC5 + n, np.uint32)
        for k in range(n):
            code[: len(text) - k] = (code[: len(text) - k] ^ wide[k:]) * np.uint32(0x01000193)
        ok = left >= n
        found.append((which[ok], code[ok] * np.uint32(0x9E3779B1)))
    owner = np.concatenate([a for a, _ in found])
    bucket = np.concatenate([b for _, b in found]) >> _SHIFT
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.bincount(owner, minlength=len(at))


def has_letter(column: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(pc.fill_null(column.cast(pa.string()), ""), r"\p{L}").to_numpy(zero_copy_only=False)


class Model:
    """Languages, a score per bucket and language, bias, temperature and threshold of rejection."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray):
        self.langs, self.table, self.bias, self.heat, self.threshold = langs, table, bias, 1.0, 0.0

    def logits(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        return sums / np.maximum(n, 1)[:, None] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        x = logits * self.heat
        x = np.exp(x - x.max(1, keepdims=True))
        return x / x.sum(1, keepdims=True)

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, its probability) of each text."""
        words = Words(column)
        _, at, which = np.unique(words.hash, return_index=True, return_inverse=True)
        bucket, many = word_features(words, at)
        first = np.concatenate([[0], np.cumsum(many)])
        each = np.add.reduceat(self.table[bucket], first[:-1], axis=0) if len(at) else np.zeros((0, len(self.langs)))
        which = which.reshape(-1)
        sums = np.column_stack([totals(each[which, k].astype(np.float64), words.first) for k in range(len(self.langs))])
        p = self.probabilities(self.logits(sums, totals(many[which], words.first)))
        return p.argmax(1), p.max(1)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], langs: list[str], seed: int = 1) -> Model:
    """rows: (language, buckets, counts). Stochastic gradient descent on embeddings and softmax weights."""
    rng = np.random.RandomState(seed)
    embed, out, bias = rng.uniform(-0.5, 0.5, (BUCKETS, DIM)), np.zeros((DIM, len(langs))), np.zeros(len(langs))
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            lang, bucket, count = rows[i]
            rate = RATE * (1 - done / steps)
            done += 1
            share = count / count.sum()
            mean = share @ embed[bucket]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[lang] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= 0.1 * rate * p
            embed[bucket] -= np.outer(rate * share, back)
    return Model(langs, (embed @ out).astype(np.float32), bias)


def calibrate(model: Model, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """Temperature by likelihood and threshold by the lowest confidences of right answers, on rows kept from the fit."""
    truth = np.array([r[0] for r in rows])
    logits = np.array([(c[:, None] * model.table[b]).sum(0) / c.sum() for _, b, c in rows]) + model.bias
    place = np.arange(len(rows))

    def loss(heat: float) -> float:
        model.heat = heat
        return -np.log(np.maximum(model.probabilities(logits)[place, truth], 1e-12)).mean()

    model.heat = min(np.geomspace(0.25, 8, 31), key=loss)
    p = model.probabilities(logits)
    right = np.sort(p.max(1)[p.argmax(1) == truth])
    model.threshold = min(HIGHEST, float(right[int(REJECTED * len(right))])) if len(right) else 0.0
    return model


def train(docs: DataFrame, fold: int = 5, sample: int = SAMPLE) -> Model:
    """A model of the languages in `lang`, from documents whose crc32(doc_id) modulo `fold` is not 0.

    About `sample` different documents of each language at most, chosen by a hash of id and text, repeated rows once; a
    fifth of them calibrates.
    """
    known = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
             .where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), fold) != 0)))
    count = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not count:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    langs = sorted(count)
    most = F.lit(0).cast("long")
    for i, lang in enumerate(langs):
        most = F.when(F.col("lang") == lang, int(min(1.0, sample / count[lang]) * (1 << 40)) + 1).otherwise(most)
    chosen = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < most).dropDuplicates(["doc_id", "text", "lang"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=STEP_BYTES):
                words = Words(part.column("text"))
                bucket, many = word_features(words, np.arange(len(words.start)))
                cuts = np.concatenate([[0], np.cumsum(many)])[words.first]
                made = [np.unique(bucket[a:b], return_counts=True) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.record_batch([part.column("lang"), part.column("part"), pa.array([u.astype(np.uint16).tobytes() for u, _ in made], pa.binary()),
                                       pa.array([n.astype(np.float32).tobytes() for _, n in made], pa.binary())], ["lang", "part", "bucket", "n"])

    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5))
    got = cut(chosen.select("text", "lang", part.alias("part")).mapInArrow(features, "lang string, part long, bucket binary, n binary").where("length(bucket) > 0"))
    rows = [[], []]
    for r in got.orderBy("part", "lang", "bucket", "n").toLocalIterator():
        rows[r["part"] == 0].append((langs.index(r["lang"]), np.frombuffer(r["bucket"], np.uint16).astype(np.int64), np.frombuffer(r["n"], np.float32).astype(np.float64)))
    return calibrate(fit(rows[0], langs), rows[1] or rows[0])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` and lang_pred, score, rejected (those names are replaced).

    lang_pred is `und` with score 0 where the text is null or has no letter, or nothing was learnt; such rows are
    rejected, and those whose score stays under the model's threshold.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    docs, names = plain(docs, keep), keep
    keep = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, score double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shared.value)
        names = np.array([*model.langs, "und"], object)
        for batch in batches:
            for part in slices(batch, limit=STEP_BYTES):
                known = has_letter(part.column("text")) & bool(model.langs)
                lang, score = np.full(part.num_rows, len(model.langs)), np.zeros(part.num_rows)
                if model.langs:
                    best, p = model.predict(part.column("text"))
                    lang[known], score[known] = best[known], p[known]
                yield pa.record_batch([*part.columns, pa.array(names[lang], pa.string()), pa.array(score), pa.array(~known | (score < model.threshold))], [*keep, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, schema).toDF(*names, "lang_pred", "score", "rejected")


def identify(docs: DataFrame, fold: int = 5) -> DataFrame:
    """One row per document: doc_id, held_out (crc32 of the id modulo `fold` is 0), lang_pred, score, rejected.

    Learnt only from text and non-null lang of documents that are not held out; a prediction sees the text alone.
    Repeated rows and ids keep their row each; an empty table gives an empty result.
    """
    out = predict(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), train(docs, fold))
    return out.select("doc_id", (remainder(F.col("doc_id"), fold) == 0).alias("held_out"), "lang_pred", "score", "rejected")
