"""Character runs: keyword tables of any size, and an index for text search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions import text as tx
from reviewloom.operators.cleaning import SEQ
from reviewloom.operators.search import faceted_search
from reviewloom.plans.stages import materialize


KEYWORD_RUN = 5


def _runs(c: str, n: int) -> Column:
    """Runs of ``n`` characters of a text, one from each place, by one pass of the regular expression."""
    return F.regexp_extract_all(F.col(c), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def _needles(keywords: DataFrame) -> DataFrame:
    needle = tx.normalize(F.col("keyword"))
    return keywords.select("issue_type", "keyword", needle.alias("needle")).filter("needle <> ''").distinct()


def likely_keywords(texts: DataFrame, words: DataFrame, doc_id: str = SEQ) -> DataFrame:
    """(doc, issue_type, keyword, needle): what may be found in ``_norm`` of the texts; a row may come several times.

    Each needle is listed under its rarest run of ``KEYWORD_RUN`` characters in the texts, a shorter one under
    itself; a needle with a run that no text holds is left out at once.
    """
    needles = words.select("needle").distinct()
    size = F.least(F.length("needle"), F.lit(KEYWORD_RUN))
    lengths = sorted(r[0] for r in needles.select(size).distinct().collect())
    if not lengths:
        return words.limit(0).select(F.lit(None).cast(texts.schema[doc_id].dataType).alias(doc_id), "issue_type", "keyword", "needle")
    own = F.coalesce(*[F.when(size == n, _runs("needle", n)) for n in lengths])
    # Stages of known size: where Spark's threshold lets it, they go to the texts, whose many runs then stay in place.
    parts = materialize(needles.select("needle", F.explode(own).alias("run")).distinct(), "keyword-runs")
    runs = texts.select(doc_id, F.explode(F.concat(*[_runs("_norm", n) for n in lengths])).alias("run"))
    counts = runs.join(parts.select("run"), "run", "left_semi").groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    counted = parts.join(counts, "run", "left")
    rarest = counted.groupBy("needle").agg(F.min_by("run", F.struct("n", "run")).alias("run"), F.every(F.col("n").isNotNull()).alias("whole"))
    listed = materialize(words.join(rarest.filter("whole").drop("whole"), "needle"), "keyword-lists")
    return runs.join(listed, "run").select(doc_id, "issue_type", "keyword", "needle")


def keyword_matches(df: DataFrame, keywords: DataFrame, text_col: str = "clean_text", doc_id: str = SEQ) -> DataFrame:
    """One row per (review, issue type, keyword found), for a dictionary table (issue_type, keyword).

    A text's runs find the keywords listed under them (``likely_keywords``), and what is found is verified
    against the text, a text at a time. Run counts are added up in the tasks first, for the dictionary's runs
    only; the rows that meet carry no text, and texts move once, by their id. As in the compiled form blanks and
    case are ignored; empty and null keywords find nothing, and equal rows of the dictionary count once.
    ``doc_id`` must be unique.
    """
    rest = [c for c in df.columns if c != text_col]
    texts = df.select(*rest, tx.normalize(F.col(text_col)).alias("_norm"))
    likely = likely_keywords(texts, _needles(keywords), doc_id).groupBy(doc_id).agg(
        F.collect_set(F.struct("issue_type", "keyword", "needle")).alias("_likely"))
    found = F.filter("_likely", lambda x: F.contains(F.col("_norm"), x["needle"]))
    hits = texts.join(likely, doc_id).select(*rest, F.explode(found).alias("_hit"))
    return hits.select(*rest, "_hit.issue_type", "_hit.keyword")


def fold(c: Column) -> Column:
    """Texts that differ in case only are equal after this, also where letters change with case."""
    return F.translate(F.lower(F.upper(c)), "ς̇", "σ")


INDEX_RUN = 3


def _run_hashes(c: str) -> Column:
    return F.array_distinct(F.transform(_runs(c, INDEX_RUN), lambda r: F.xxhash64(r)))


def text_index(df: DataFrame, text_col: str = "clean_text", doc_id: str = SEQ, folder: str | None = None) -> DataFrame:
    """(run, doc): the hashed three-character runs of each text, as a stage table whose files are ordered by run.

    A row per run and text. Rows stay in the task that cut their text: nothing is shuffled and texts are cut
    once; a look-up reads the pages of each file that hold the run.
    """
    folded = df.select(doc_id, fold(F.col(text_col)).alias("_folded"))
    rows = folded.select(F.explode(_run_hashes("_folded")).alias("run"), doc_id)
    return materialize(rows.sortWithinPartitions("run", doc_id), "text-index", folder)


def literal_pieces(pattern: str) -> list[str]:
    """Strings that every match of a regular expression holds, as far as they are plain to see; may be none."""
    if "(?" in pattern or pattern.startswith("*"):
        return []
    pieces, piece, depth, i = [], "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[":  # a class: skip to its end; nested or odd classes give up
            end = pattern.find("]", i + 2)
            if end < 0 or "[" in pattern[i + 1:end] or "\\" in pattern[i:end]:
                return []
            c, i = "", end
        elif c == "\\":
            if not pattern[i + 1:i + 2] or pattern[i + 1].isalnum():  # \Q, \x41, back references and the like
                return []
            c, i = "", i + 1
        elif c in "()":
            depth += 1 if c == "(" else -1
            c = ""
        elif c == "|" and depth <= 0:
            return []
        if depth < 0:
            return []
        if depth or c in ("", ".", "^", "$", "|"):
            pieces, piece = [*pieces, piece], ""
        elif c in "*?{":
            pieces, piece = [*pieces, piece[:-1]], ""
            if c == "{":
                i = pattern.find("}", i)
                if i < 0:
                    return []
        elif c == "+":
            pieces, piece = [*pieces, piece], ""
        else:
            piece += c
        i += 1
    return [] if depth else [p for p in [*pieces, piece] if p]


def indexed_search(df: DataFrame, index: DataFrame, keyword: str, literal: bool = False, doc_id: str = SEQ,
                   text_col: str = "clean_text", **facets) -> DataFrame:
    """``faceted_search`` through the index: the same rows.

    Texts that hold all runs of the keyword's literal pieces are looked up - the run filter reaches
    the index's scan - and only those are read against the pattern. A keyword without a piece of
    three characters is searched in all texts.
    """
    word = keyword.strip()
    pieces = [word] if literal else literal_pieces(word)
    spark = df.sparkSession
    wanted: set[int] = set()
    for p in pieces:
        one = spark.range(1).select(fold(F.lit(p)).alias("_folded"))
        wanted |= set(one.select(_run_hashes("_folded").alias("h")).first()["h"])
    if wanted:
        hits = index.filter(F.col("run").isin(sorted(wanted)))
        docs = hits.groupBy(doc_id).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted))
        df = df.join(docs.select(doc_id), doc_id, "left_semi")
    return faceted_search(df, keyword=keyword, literal=literal, text_col=text_col, **facets)
