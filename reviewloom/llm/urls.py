"""URL filter by association rules, with DataFrame functions and MLlib's FP-growth only.

A URL becomes a set of tokens (scheme, host, parent domains, top-level domain, path directories, words of the last path
part, extension, query keys and values, fragment). FP-growth mines the token combinations of labelled URLs. A rule that
implies the label `block` is kept if it rests on MIN_COUNT blocked URLs at least, if the lower end of the confidence
interval (Wilson) of its share of blocked URLs is high enough and well above the base rate, if it beats the base rate
on labelled URLs that were held out of mining, and if no subset says as much. Each rule is indexed under its rarest
token; the distinct token sets of the pages look their tokens up there and check the rest. Fixed host and path rules go
first.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth, FPGrowthModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.shared import cut, fold

BLOCK = "label:block"
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.002, 0.5, 1.5  # confidence and lift by the lower end of the interval
MIN_COUNT = 10  # blocked URLs that a rule rests on, however few are labelled
Z = 1.645  # normal quantile of the interval's lower end
HELD = 5  # one labelled URL of so many is held out of mining
SALTS = 16  # pages with one token set go to so many tasks
#: (host, path, verdict): a rule fits its host and all subdomains where the path starts alike; the longest wins.
HOST_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """Host after the first ://, A-Z lower-cased; empty for null and where there is no ://."""
    return fold(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def tokens(url: Column) -> Column:
    """Sorted set of a URL's tokens; none for null and where there is no ://. Path parts of digits are one token."""
    here, way = host(url), path(url)
    parts = F.filter(F.split(way, "/"), lambda p: p != "")
    ends = way.endswith("/")
    folders = F.when(ends, parts).otherwise(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
    name = F.when(ends | (F.size(parts) == 0), F.lit("")).otherwise(F.element_at(parts, -1))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    asked = F.filter(F.split(query, "&"), lambda q: q != "")
    keys = F.transform(asked, lambda q: F.concat(F.lit("query:"), F.regexp_extract(q, r"^([^=]*)", 1)))
    values = F.transform(F.filter(asked, lambda q: q.rlike("(?s)=.")), lambda q: F.concat(F.lit("value:"), q))
    named = F.filter(F.split(fold(F.regexp_replace(name, r"\.[^.]*$", "")), r"[-_.+~%,;:=!@ ]+"), lambda w: (w != "") & ~w.rlike("^[0-9]+$"))
    labels = F.split(here, r"\.")
    parents = F.when(F.size(labels) > 2, F.transform(F.sequence(F.lit(2), F.greatest(F.size(labels) - 1, F.lit(2))), lambda i: F.concat(
        F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))).otherwise(F.array().cast("array<string>"))
    made = F.concat(
        F.array(F.concat(F.lit("scheme:"), fold(F.regexp_extract(url, r"(?s)^(.*?)://", 1))), F.concat(F.lit("host:"), here),
                F.concat(F.lit("top:"), F.regexp_extract(here, r"([^.]*)$", 1))),
        F.transform(folders, lambda p: F.concat(F.lit("folder:"), F.when(p.rlike("^[0-9]+$"), F.lit("0")).otherwise(fold(p)))),
        F.array(F.concat(F.lit("ending:"), F.regexp_extract(name, r"(\.[^.]*)$", 1))), keys, values, parents,
        F.transform(named, lambda w: F.concat(F.lit("name:"), w)),
        F.when(F.instr(url, "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")))
    return F.when(F.instr(url, "://") > 0, F.array_sort(F.array_distinct(made))).otherwise(F.array().cast("array<string>"))


def host_rule(here: Column, way: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule as text, its verdict) of the longest fixed rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((here == h) | here.endswith("." + h)) & way.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def lower_bound(hits: Column, n: Column, z: float = Z) -> Column:
    """Lower end of the Wilson interval of a share of `hits` in `n`."""
    share = hits / n
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT,
               min_count: int = MIN_COUNT) -> DataFrame:
    """(key, items, confidence, support, lift): rules items -> block, each under its rarest token `key`.

    labelled: url and block (boolean). One URL of HELD, chosen by a hash of the url, is held out: rules are mined from
    the others and go if their confidence on the held-out URLs is not above the base rate there. A rule also goes when
    one of its tokens can be left out without losing confidence. `confidence` is the lower end of the interval, and
    `lift` is that against the base rate. The number of rules follows from `min_support` (at most tokens-per-URL subsets
    of 1 / min_support sets), not from the number of URLs. Too few labelled URLs, or none that is blocked, give no rule.
    """
    url_tokens = tokens(F.col("url"))
    baskets = cut(labelled.where(F.size(url_tokens) > 0).select(
        url_tokens.alias("items"), F.col("block"), (F.pmod(F.xxhash64("url"), F.lit(HELD)) == 0).alias("held")))
    empty = "key string, items array<string>, confidence double, support double, lift double"
    size = {r["held"]: (r["n"], r["bad"]) for r in baskets.groupBy("held").agg(F.count("*").alias("n"), F.count_if("block").alias("bad")).collect()}
    n, bad = size.get(False, (0, 0))
    n_held, bad_held = size.get(True, (0, 0))
    if bad < min_count or not n_held:
        return labelled.sparkSession.createDataFrame([], empty)
    mark = F.when(F.col("block"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, (min_count - 0.5) / n), minConfidence=min_confidence).fit(
        baskets.where("NOT held").select(F.concat("items", mark).alias("items")))
    hits = F.round(F.col("support") * n)
    rules = (model.associationRules.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == BLOCK))
             .select(F.array_sort("antecedent").alias("items"), "support", lower_bound(hits, F.round(hits / F.col("confidence"))).alias("sure"))
             .select("items", F.col("sure").alias("confidence"), "support", (F.col("sure") * n / bad).alias("lift"))
             .where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift)))
    rules = cut(rules)
    sets = baskets.where("held").groupBy(F.col("items").alias("tokens")).agg(F.count("*").alias("n"), F.count_if("block").alias("bad"))
    proved = (sets.select("*", F.explode("tokens").alias("key")).join(_indexed(rules, model), "key").where(F.size(F.array_except("items", "tokens")) == 0)
              .groupBy("items").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where(F.col("bad") * n_held > F.col("n") * bad_held))
    rules = cut(rules.join(proved.select("items"), "items", "left_semi"))
    shorter = rules.select(F.explode(F.transform("items", lambda x: F.array_except("items", F.array(x)))).alias("less"), "items", "confidence")
    covered = (shorter.alias("a").join(rules.alias("b"), (F.col("a.less") == F.col("b.items")) & (F.col("b.confidence") >= F.col("a.confidence")))
               .select(F.col("a.items")).distinct())
    rules = rules.join(covered, "items", "left_anti")
    return _indexed(rules, model)


def _indexed(rules: DataFrame, model: FPGrowthModel) -> DataFrame:
    """The rules, each under its rarest token."""
    single = model.freqItemsets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("item"), "freq")
    key = (rules.select("items", F.explode("items").alias("item")).join(single, "item").groupBy("items")
           .agg(F.min_by("item", F.struct("freq", "item")).alias("key")))
    return rules.join(key, "items").select("key", "items", "confidence", "support", "lift")


def match_rules(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, confidence, items): the surest rule that each token set holds; sets that hold none are left out.

    Token sets must be distinct. Empty sets and empty tables give no row; of equally sure rules the longest, then the
    last by its tokens, is taken.
    """
    looked = token_sets.select("tokens", F.explode("tokens").alias("key"))
    held = looked.join(rules, "key").where(F.size(F.array_except("items", "tokens")) == 0)
    best = F.struct("confidence", F.size("items").alias("n"), "items")
    return held.groupBy("tokens").agg(F.max(best).alias("best")).select("tokens", "best.confidence", "best.items")


def judge(pages: DataFrame, labelled: DataFrame, host_rules: list[tuple[str, str, str]] | None = None, **limits: float) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, confidence, items.

    The longest fixed rule that fits decides (`rule`); else a page is blocked if a mined rule's tokens are all in its
    url. Null urls and those without :// have no token, match nothing and are allowed; repeated rows keep a row each;
    without labelled urls only the fixed rules block; other columns are not read.
    """
    url = F.col("url").cast("string")
    rule, verdict = host_rule(F.col("host"), F.col("path"), HOST_RULES if host_rules is None else host_rules)
    rows = (pages.select(F.col("page_id").cast("long"), host(url).alias("host"), path(url).alias("path"), tokens(url).alias("tokens"))
            .withColumn("rule", rule).withColumn("fixed", verdict))
    rules = cut(mine_rules(labelled, **limits))
    found = match_rules(rows.where("rule IS NULL").select("tokens").distinct(), rules)
    mined = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, ["tokens", "salt"], "left").select("page_id", "host", "path", "rule", F.coalesce("fixed", mined).alias("verdict"), "confidence", "items")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url and block of the pages whose document has a label: the document is the number that ends the url's path.

    A label asks for a block where its document is toxic or of low quality; a document with several labels takes the worst.
    """
    bad = (F.coalesce(F.col("toxic").cast("int"), F.lit(0)) == 1) | (F.coalesce(F.col("quality").cast("int"), F.lit(1)) == 0)
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max(bad).alias("block"))
    url = F.col("url").cast("string")
    doc = F.regexp_extract(path(url), r"/([0-9]{1,18})(?:\.[a-z]+|/)?$", 1)
    return pages.select(url.alias("url"), F.when(doc != "", doc).cast("long").alias("doc")).join(known, "doc").select("url", "block")
