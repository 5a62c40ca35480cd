"""Benchmark decontamination with DataFrame functions only.

Words are runs of a-z, 0-9 and everything outside ASCII, after A-Z is lower-cased. The test set's windows (n words, or
all words of an item that has fewer) become a table of hashes; every window of a document is hashed and looked up, and a
hit counts when the words themselves are equal. The table is broadcast while its measured number of windows is within
BROADCAST_WINDOWS; beyond that keys and places are joined by shuffle without any word, and the words of documents with
a candidate are met once per document to compare them, so a benchmark may have any size. One pass over the texts serves counts and hits: each document
adds one marker row to its hits, and only those rows are grouped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.shared import cut, fold, quoted

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
N = 10
BROADCAST_WINDOWS = 1 << 20  # some 150 bytes each
_MARK = -1


def words(text: Column) -> Column:
    """Words of a text, none for null."""
    return F.filter(F.split(fold(F.coalesce(text, F.lit(""))), NO_WORD), lambda w: w != "")


def _keyed(size: int) -> Callable[[Column], Column]:
    """The key of the window of `size` words that starts at a place."""
    return lambda i: F.struct(F.xxhash64(F.slice("w", i, size)).alias("key"), F.lit(size).alias("size"), i.alias("pos"))


def item_windows(items: DataFrame, n: int = N) -> DataFrame:
    """(size, window, ids): each different window with the distinct ids of the items that hold it.

    Items with no word, null ones too, have no window. A null id hits like any other but is no id.
    """
    split = items.select(F.col("item_id").cast("string").alias("id"), words(F.col("text").cast("string")).alias("w")).where("size(w) > 0")
    size = F.least(F.size("w"), F.lit(n))
    rows = split.select("id", size.alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("window"))
    return rows.groupBy("size", "window").agg(F.collect_set("id").alias("ids"))


def _window_keys(sizes: list[int]) -> list[Column]:
    """For each size, the keys of all windows of `w`."""
    made = []
    for size in sizes:
        last = F.size("w") - size + 1
        places = F.when(last > 0, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        made.append(F.transform(places, _keyed(size)))
    return made


def _scan_by_shuffle(split: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """The rows of _scan for a benchmark of any size. A hit of repeated documents is one row; markers stay one per row."""
    markers = split.select("doc_id", "digest", F.size("w").alias("n_words"), F.lit(-1).alias("pos"), F.lit(0).alias("size"), F.array().cast("array<string>").alias("ids"))
    places = split.select("doc_id", "digest", F.explode(F.concat(*_window_keys(sizes))).alias("at")).select("doc_id", "digest", "at.*")
    table = windows.select(F.xxhash64("window").alias("key"), "size", "window", "ids")
    likely = places.distinct().join(table, ["key", "size"]).groupBy("doc_id", "digest").agg(F.collect_list(F.struct("pos", "size", "window", "ids")).alias("hits"))
    likely = cut(likely).alias("h")  # one row per document with a candidate, as long as its text
    texts = split.alias("s").join(likely.alias("h"), _same_document("s", "h"), "left_semi").dropDuplicates(["doc_id", "digest"]).alias("s")
    held = F.filter("h.hits", lambda x: F.slice("s.w", x["pos"], x["size"]) == x["window"])
    hits = texts.join(likely, _same_document("s", "h")).select("s.doc_id", "s.digest", F.size("s.w").alias("n_words"), F.explode(held).alias("hit"))
    return markers.unionByName(hits.select("doc_id", "digest", "n_words", "hit.pos", "hit.size", "hit.ids"))


def _same_document(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.digest") == F.col(f"{b}.digest"))


def _scan(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """One marker row (pos -1) per row of `docs` and one row per hit window: doc_id, digest, n_words, pos, size, ids."""
    windows = cut(item_windows(items, n))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most n different ones
    split = docs.select("doc_id", F.xxhash64("text", F.crc32(F.col("text").cast("binary"))).alias("digest"), words(F.col("text")).alias("w"))
    if windows.count() > BROADCAST_WINDOWS:
        return _scan_by_shuffle(split, windows, sizes)
    marker = docs.sparkSession.range(1).select(F.lit(_MARK).cast("bigint").alias("key"), F.lit(0).alias("size"), F.array().cast("array<string>").alias("window"), F.array().cast("array<string>").alias("ids"))
    table = windows.select(F.xxhash64("window").alias("key"), "size", "window", "ids").unionByName(marker)
    table = F.broadcast(table)
    keys = F.array(F.struct(F.lit(_MARK).cast("bigint").alias("key"), F.lit(0).alias("size"), F.lit(-1).alias("pos")))
    keys = F.concat(keys, *_window_keys(sizes))
    found = split.select("doc_id", "digest", "w", F.explode(keys).alias("at")).select("doc_id", "digest", "w", "at.*").alias("d")
    same = (F.col("d.key") == F.col("t.key")) & (F.col("d.size") == F.col("t.size")) & (
        (F.col("d.size") == 0) | (F.expr("slice(d.w, greatest(d.pos, 1), d.size)") == F.col("t.window")))
    return found.join(table.alias("t"), same).select("doc_id", "digest", F.size("w").alias("n_words"), "pos", "d.size", "ids")


def contamination(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of an item's window is hit; items_sha256 is over the distinct ids of those items,
    sorted as strings and joined by commas (of the empty string where there is none). Repeated rows and ids each keep
    a row; a null text has no words; an empty benchmark hits nothing; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = _scan(docs, items, n)
    # Rows with the same id and text have the same answer, so they are one group, counted by its markers.
    copies = rows.groupBy("doc_id", "digest", "n_words", "pos", "size").agg(F.count("*").alias("n"), F.first("ids").alias("ids"))
    group = Window.partitionBy("doc_id", "digest").orderBy("pos", "size")
    reach = F.max(F.when(F.col("pos") > 0, F.col("pos") + F.col("size"))).over(group.rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("pos") + F.col("size") - F.greatest(F.col("pos"), F.coalesce(reach, F.lit(0)))
    hit = copies.withColumn("new", F.when(F.col("pos") > 0, F.greatest(new, F.lit(0))).otherwise(0))
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids"))))
    out = (hit.groupBy("doc_id", "digest").agg(
        F.max("n_words").cast("long").alias("n_words"), F.sum("new").alias("n_hit"), ids.alias("items"),
        F.max(F.when(F.col("pos") < 0, F.col("n"))).alias("rows"))
        .select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "rows"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("rows", "copy")


def clean_documents(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """The documents without any hit word, with all their columns.

    Null and empty texts stay; repeated rows stay or go together; an empty benchmark takes nothing out.
    """
    key = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bad = cut(_scan(key, items, n).where("pos > 0").select("doc_id", "digest").distinct())
    digest = F.xxhash64(F.col("d.text").cast("string"), F.crc32(F.col("d.text").cast("string").cast("binary")))
    if bad.count() <= BROADCAST_WINDOWS:  # 16 bytes each
        bad = F.broadcast(bad)
    return docs.alias("d").join(bad.alias("b"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("b.doc_id")) & (digest == F.col("b.digest")), "left_anti")


def clean_spans(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """The documents with every hit word taken out of `text`; what stands between words stays. Other columns stay.

    A null text stays null; repeated rows are cleaned alike; an empty benchmark changes nothing.
    """
    key = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    hits = (_scan(key, items, n).where("pos > 0").groupBy("doc_id", "digest")
            .agg(F.collect_set(F.struct("pos", "size")).alias("spans")))  # at most n per word of one document
    digest = F.xxhash64(F.col("d.text").cast("string"), F.crc32(F.col("d.text").cast("string").cast("binary")))
    joined = docs.alias("d").join(hits.alias("h"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("h.doc_id")) & (digest == F.col("h.digest")), "left")
    original = F.regexp_extract_all(F.col("d.text"), F.lit("([A-Za-z0-9\\x80-\\x{10FFFF}]+)"), 1)
    gaps = F.split(F.col("d.text"), r"[A-Za-z0-9\x80-\x{10FFFF}]+")
    gone = F.array_distinct(F.flatten(F.transform("h.spans", lambda s: F.sequence(s["pos"], s["pos"] + s["size"] - 1))))
    kept = F.transform(original, lambda w, i: F.concat(gaps[i], F.when(F.array_contains(gone, i + 1), F.lit("")).otherwise(w)))
    text = F.when(F.col("h.spans").isNull(), F.col("d.text")).otherwise(F.concat(F.array_join(kept, ""), F.element_at(gaps, -1)))
    return joined.select(*(text.alias(c) if c == "text" else F.col(f"d.{quoted(c)}") for c in docs.columns))
