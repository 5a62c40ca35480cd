"""Text expressions. Everything is a Column built from Spark's own functions: no UDF."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions import fixed_values as fv

# Unicode white space incl. the four ASCII separators that count as blank in review exports.
_SPACE = r"[\s\x1c-\x1f]"
_KEPT_RUN = r"[0-9A-Za-z가-힣.,!?~%()\[\]]+"


def unicode_trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def not_blank(c: Column) -> Column:
    """True when the text holds at least one character that is not white space."""
    return F.coalesce(c.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def normalize(c: Column) -> Column:
    """Lower case without any white space; null gives ''."""
    return F.coalesce(F.regexp_replace(F.lower(c), rf"(?U){_SPACE}+", ""), F.lit(""))


def normalize_word(word: str) -> str:
    return "".join(word.lower().split())


def any_of(conditions: Iterable[Column]) -> Column:
    conditions = list(conditions)
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def contains_any(c: Column, words: Iterable[str]) -> Column:
    return any_of(c.contains(w) for w in words if w)


def present_words(c: Column, words: Iterable[str], labels: Iterable[str] | None = None) -> Column:
    """The words found in the text, in dictionary order, as labels."""
    words = list(words)
    labels = list(labels) if labels is not None else words
    return flag_array([(c.contains(w), F.lit(lab)) for w, lab in zip(words, labels) if w])


def flag_array(flags: list[tuple[Column, Column]]) -> Column:
    """Array of the labels whose condition holds (labels are never empty strings)."""
    if not flags:
        return F.array().cast("array<string>")
    return F.array_remove(F.array(*[F.when(cond, lab).otherwise("") for cond, lab in flags]), "")


def mask_pii(c: Column, patterns: list[tuple[str, str]] = fv.PII_PATTERNS, mask: str = fv.MASK) -> Column:
    """Replace personal data with the mask, patterns in order.

    The e-mail pattern only runs where an '@' occurs and the digit patterns only where two digits
    stand together, so ordinary text pays for two cheap probes instead of nine regex passes.
    """
    by_at = [p for name, p in patterns if name == "email"]
    by_digit = [p for name, p in patterns if name != "email"]
    mailed = c
    for p in by_at:
        mailed = F.regexp_replace(mailed, f"(?U){p}", mask)
    mailed = F.when(c.contains("@"), mailed).otherwise(c)
    masked = mailed
    for p in by_digit:
        masked = F.regexp_replace(masked, f"(?U){p}", mask)
    return F.when(c.rlike(r"(?U)\d\d"), masked).otherwise(mailed)


def clean_text(c: Column) -> Column:
    """Drop emoji and special characters, collapse blanks. The mask token stays intact.

    The runs of kept characters joined by one blank: the same text as replacing everything else and
    trimming, several times faster than a replacement that fires at every blank.
    """
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_KEPT_RUN), F.lit(0))
    return F.array_join(runs, " ")


def with_once(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Adds a costly column that later filters must not compute again.

    Catalyst pushes a filter on a computed column below the projection by repeating the expression.
    A generated column is a boundary for that: filters on it stay above, filters on other columns
    still reach the scan.
    """
    return df.select("*", F.explode(F.array(expr)).alias(name))


def tokens(
    c: Column,
    stopwords: list[str] = fv.STOPWORDS,
    min_len: int = fv.MIN_TOKEN_LEN,
    pattern: str = fv.TOKEN_PATTERN,
) -> Column:
    """Letter/digit runs of at least ``min_len`` characters, stop words removed, duplicates kept."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= min_len) & ~t.isin(list(stopwords)))


def topic_tokens(c: Column) -> Column:
    return tokens(c, stopwords=fv.STOPWORDS + [w for w in fv.TOPIC_STOPWORDS if w not in fv.STOPWORDS])


def ngrams(toks: Column, n: int) -> Column:
    """Runs of n tokens joined by a blank, from a token array."""
    if n == 1:
        return toks
    starts = F.slice(ngrams(toks, n - 1), 1, F.greatest(F.size(toks) - (n - 1), F.lit(0)))
    ends = F.slice(toks, n, F.greatest(F.size(toks), F.lit(1)))
    return F.zip_with(starts, ends, lambda a, b: F.concat(a, F.lit(" "), b))


def terms(toks: Column, low: int, high: int) -> Column:
    return F.concat(*[ngrams(toks, n) for n in range(low, high + 1)])


def unix_lines(pattern: str) -> str:
    """Only a line feed ends a line, so '.' spans the other separators."""
    return f"(?dU){pattern}"
