"""Document fingerprints: bottom-k sketches of five-word shingle hashes.

A sketch is the k smallest different shingle hashes of a text, so the sketch of several parts is the k smallest of
theirs. From two sketches follow estimates of resemblance, containment and the number of different shingles. Texts of
fewer than five words, but not none, are one shingle; words are runs of bytes outside white space, A-Z lower-cased.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.shared import plain, quoted
from reviewloom.llm.words import Words, shingles, slices

K, SHINGLE = 128, 5


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest different hashes, in order."""
    if len(hashes) > 8 * k:
        low = np.partition(hashes, 4 * k)[: 4 * k]
        found = np.unique(low)
        if len(found) >= k:
            return found[:k]
    return np.unique(hashes)[:k]


def sketches(texts: pa.Array, k: int = K) -> list[np.ndarray]:
    words = Words(texts)
    value, many = shingles(words, SHINGLE)
    return [sketch(x, k) for x in np.split(value, np.cumsum(many)[:-1])] if len(many) else []


def merge(parts: list[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of all parts together."""
    return np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]).astype(np.uint64))[:k]


def write(values: np.ndarray) -> str:
    return base64.b64encode(values.astype(">u8").tobytes()).decode()


def read(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles among all; 1 for two texts without any, exact while the union has k at most."""
    both = np.sort(np.concatenate([a, b]))
    if not len(both):
        return 1.0
    twice = both[1:] == both[:-1]
    union = np.delete(both, np.flatnonzero(twice))[:k]
    return float(np.searchsorted(both[1:][twice], union[-1], "right")) / len(union)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of different shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / (float(a[-1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    common = resemblance(a, b, k) * distinct(merge([a, b], k), k)
    return min(1.0, common / distinct(a, k))


def fingerprint(docs: DataFrame, k: int = K) -> DataFrame:
    """All columns of `docs` and `fingerprint` and `n_shingles` (estimated), in one pass without a shuffle.

    A null text counts as empty, which has no shingle; repeated rows keep a row each; columns of those two names are
    replaced; an empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c not in ("fingerprint", "n_shingles")]
    docs, names = plain(docs, keep), keep
    keep = docs.columns
    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.schema) + ", fingerprint string, n_shingles double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = sketches(part.column("text"), k)
                yield pa.record_batch([*part.columns, pa.array([write(x) for x in made], pa.string()), pa.array([distinct(x, k) for x in made], pa.float64())], [*keep, "fingerprint", "n_shingles"])

    return docs.mapInArrow(run, schema).toDF(*names, "fingerprint", "n_shingles")


def edit_trial(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likeness of both and of neighbours.

    The edited text has the last floor(n/2) code points replaced by the first as many (or all) of the next document in
    ascending doc_id; after the last comes the first. Documents are dealt by ranges of doc_id and sorted there; each
    range also gets the first document of the next one, so that no task sees more than its range. Null text counts as
    empty, a null id comes first, equal ids are ordered by a hash of the text; a lone document follows itself.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"))
    bounds = sorted({int(b) for b in docs.approxQuantile("id", [i / n for i in range(1, n)], 0.1 / n)}) if n > 1 else []
    limits = F.array(*(F.lit(b).cast("long") for b in bounds)) if bounds else F.array().cast("array<bigint>")
    docs = docs.withColumn("range", F.size(F.filter(limits, lambda b: b < F.col("id"))))
    # The first id of each range, n rows at most; the range before gets that document as a guest.
    firsts = [(r["range"], r["id"]) for r in docs.groupBy("range").agg(F.min("id").alias("id")).orderBy("range").collect()]
    guests = spark.createDataFrame([(firsts[i][1], firsts[i - 1][0]) for i in range(len(firsts))], "id long, other int")
    places = F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("guest")), F.struct(F.col("other").alias("range"), F.lit(1).alias("guest")))
    dealt = (docs.join(F.broadcast(guests), "id", "left").withColumn("at", F.explode(places)).where("at.range IS NOT NULL")
             .select("at.range", "at.guest", "id", "doc_id", "text", F.xxhash64("text").alias("h"))
             .repartition(n, "range").sortWithinPartitions("range", "guest", "id", "h")
             .select("range", "guest", "doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for part in slices(batch):
                if held is not None:
                    part = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
                held = part.slice(part.num_rows - 1, 1)
                own = np.flatnonzero(part.column("guest").to_numpy()[:-1] == 0).tolist()
                if not own:
                    continue
                texts = part.column("text").to_pylist()
                mine = sketches(part.column("text"), k)
                edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in own]
                theirs = sketches(pa.array(edited, pa.large_string()), k)
                yield pa.record_batch([
                    part.column("doc_id").take(pa.array(own)), pa.array([len(texts[i]) for i in own], pa.int64()),
                    pa.array([sha256(x.encode()).hexdigest() for x in edited]),
                    pa.array([write(mine[i]) for i in own]), pa.array([write(x) for x in theirs]),
                    pa.array([resemblance(mine[i], x, k) for i, x in zip(own, theirs, strict=True)]),
                    pa.array([resemblance(mine[i], mine[i + 1], k) for i in own]),
                ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
