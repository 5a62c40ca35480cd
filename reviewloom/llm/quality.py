"""Quality rules: fixed word and line rules, then a hashed n-gram log-likelihood ratio, with DataFrame functions only.

Words and pairs of neighbouring words are hashed into BUCKETS. The target multinomial comes from trusted documents, the
raw one from all documents; both with one added to each bucket. A document's score is the mean over its words and pairs
of log(target / raw), so long and short texts compare, and it is kept from a fixed threshold on: no document is drawn
by chance. Every trusted document counts, for the target and for the threshold. Counts are added up in the tasks first, so
a pass sends at most BUCKETS rows a task, and a document's score is one row when it is shuffled. What is broadcast has
BUCKETS rows (weights) or BROADCAST rows (trusted ids) at most; more trusted ids meet the documents in a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.shared import cut

BLANKS = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
BUCKETS = 1 << 16
BROADCAST = 1 << 18  # trusted ids that are sent to all executors
PARTS = 1 << 18  # of the hash range, by which a sample is cut
STEPS = 256  # ranges of a score, per unit, that are counted to find a quantile
QUANTILE, MARGIN = 0.05, 2.5  # the threshold lies MARGIN times as far below the trusted median as this quantile does
LEAST_WORDS = 50
RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Runs of characters other than space and \\t..\\r; none for null."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner != "", F.split(inner, SPACE)).otherwise(F.array().cast("array<string>"))


def repeat_words(w: str) -> Column:
    """Number of words of array column `w` inside windows of three words that the array holds twice or more.

    Windows are sorted by their hashes and places; equal hashes count where the words are equal too.
    """
    at = lambda i: F.get(w, i)
    last = F.size(w) - 3
    none = F.array().cast("array<bigint>")
    keys = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))).otherwise(none)

    def covered(k: Column) -> Column:
        def twice(s: Column) -> Column:
            same = lambda x, y: (x["k"] == y["k"]) & (F.slice(w, x["i"] + 1, 3) == F.slice(w, y["i"] + 1, 3))
            return F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
        found = _let(F.sort_array(F.transform(k, lambda x, i: F.struct(x.alias("k"), i.alias("i")))), twice)
        reach = lambda p: F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return F.aggregate(_let(F.sort_array(F.transform(found, lambda x: x["i"])), reach), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return _let(keys, lambda k: F.when(F.size(F.array_distinct(k)) < F.size(k), covered(k)).otherwise(F.lit(0).cast("bigint")))


def _features(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, and of each word in column `w` its bucket `one` and that of it and the next word, `two`: null after the last."""
    bucket = lambda *x: F.pmod(F.xxhash64(*x), F.lit(BUCKETS)).cast("int")
    following = F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0)))
    split = rows.select(*keys, F.explode_outer(F.arrays_zip(F.col("w").alias("a"), following.alias("b"))).alias("x")).select(*keys, "x.a", "x.b")
    return split.select(*keys, F.when(F.col("a").isNotNull(), bucket("a")).alias("one"), F.when(F.col("b").isNotNull(), bucket("a", "b")).alias("two"))


def rules(docs: DataFrame) -> DataFrame:
    """doc_id, row, w (words) and the figures of the fixed rules; one row per row of `docs`, `row` tells them apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    split = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text.alias("text"), words(F.col("text")).alias("w"), lines.alias("lines"))
    count = lambda c: c.cast("long")
    return split.select(
        "doc_id", "row", "w", count(F.size("w")).alias("n_words"), count(F.length(F.array_join("w", ""))).alias("word_chars"),
        count(F.regexp_count("text", F.lit(SYMBOLS))).alias("n_symbols"),
        count(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), repeat_words("w").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def trusted_ids(labels: DataFrame, sample: int | None = None) -> DataFrame:
    """Different doc_ids with quality 1: all of them; if `sample` is given, as many parts of the hash range as hold so many at most."""
    ids = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct()
    if sample is None:
        return ids
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    so_far, last = 0, -1
    for r in ids.groupBy(part.alias("part")).count().orderBy("part").toLocalIterator():
        so_far += r["count"]
        if so_far > sample:
            break
        last = r["part"]
    return ids.where(part <= last)


def _lookup(trusted: DataFrame) -> DataFrame:
    """Trusted ids as the side of a join that is looked up: sent to all executors if few, else hashed task by task."""
    return trusted.hint("broadcast" if trusted.count() <= BROADCAST else "shuffle_hash")


def weights(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, weight): log of the target's share of a bucket over the raw corpus's.

    trusted: different ids. Every document counts as raw, the trusted ones as target too.
    """
    flags = _lookup(trusted.select(F.col("doc_id").alias("t_id"), F.lit(True).alias("trusted")))
    flagged = docs.select("doc_id", "text").join(flags, F.col("doc_id") == F.col("t_id"), "left")
    found = _features(flagged.select("trusted", words(F.col("text")).alias("w")), ["trusted"])
    found = found.select("trusted", F.explode(F.array("one", "two")).alias("bucket")).where("bucket IS NOT NULL")
    counts = cut(found.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("target")))
    total = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0))).first()
    share = lambda c, n: F.log((F.col(c) + 1) / F.lit(n + BUCKETS))
    return cut(counts.select("bucket", (share("target", total[1]) - share("raw", total[0])).alias("weight")))


def score(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """doc_id, the figures of the fixed rules, and score: the mean weight of words and pairs, null without a word."""
    keys = ["row", "doc_id", *RULES]
    found = _features(rules(docs), keys)
    for name in ("one", "two"):
        own = weights.select(F.col("bucket").alias(name), F.col("weight").alias(f"w_{name}"))
        found = found.join(F.broadcast(own), name, "left")
    none = F.lit(0.0)
    total = F.sum(F.coalesce("w_one", none) + F.coalesce("w_two", none))
    mean = F.try_divide(total, F.count("w_one") + F.count("w_two"))
    return found.groupBy(*keys).agg(mean.alias("score")).drop("row")


def quantiles(scores: DataFrame, at: list[float]) -> list[float] | None:
    """Exact interpolated quantiles of column score, without nulls; None without a row.

    Scores are counted by ranges first; only the ranges that hold a wanted rank are read value by value.
    """
    part = F.floor(F.col("score") * STEPS)
    counts = scores.groupBy(part.alias("part")).count().orderBy("part").collect()
    n = sum(r["count"] for r in counts)
    if not n:
        return None
    places = [(n - 1) * p for p in at]
    ranks = {r for x in places for r in (math.floor(x), math.ceil(x))}
    values, start = {}, 0
    for r in counts:
        end = start + r["count"]
        if any(start <= x < end for x in ranks):
            upto = start
            for v in scores.where(part == r["part"]).groupBy("score").count().orderBy("score").toLocalIterator():
                values |= {x: v["score"] for x in ranks if upto <= x < upto + v["count"]}
                upto += v["count"]
        start = end
    low, high = (lambda x: values[math.floor(x)]), (lambda x: values[math.ceil(x)])
    return [low(x) + (x - math.floor(x)) * (high(x) - low(x)) for x in places]


def threshold(told: DataFrame, trusted: DataFrame) -> float:
    """The least score that is kept: the trusted documents' median less MARGIN times its distance to their QUANTILE.

    told: the rows of score(). Trusted documents of LEAST_WORDS words and more count. Without any, every score passes.
    """
    own = told.where(F.col("n_words") >= LEAST_WORDS).select("doc_id", "score").join(_lookup(trusted), "doc_id", "left_semi")
    found = quantiles(cut(own.where("score IS NOT NULL").select("score")), [0.5, QUANTILE])
    return float("-inf") if found is None else found[0] - MARGIN * (found[0] - found[1])


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score of each document.

    Repeated rows, null ids and ids with several texts each keep a row; a null or empty text has no word and fails the
    fixed rules. Labels with a null id or quality count for nothing; without any trusted document the fixed rules alone
    decide. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    trusted = cut(trusted_ids(labels))
    table = weights(docs, trusted)
    told = cut(score(docs, table).withColumn("base_failed", base_failed()))
    least = threshold(told, trusted)
    return told.select("doc_id", *RULES, "base_failed", (~F.col("base_failed") & (F.coalesce("score", F.lit(float("-inf"))) >= least)).alias("kept"), "score")
