"""Queries of the operators in this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm import decontaminate, fingerprints, language, lm_scoring, manifest, near_duplicates, negatives, packing, quality, token_counts, toxicity, urls, warc
from reviewloom.llm.shared import table


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 512)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 4096, 2)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS size, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS pos FROM b WHERE len(w) > 0),
t AS (SELECT DISTINCT item_id, size, array_to_string(w[pos:pos + size - 1], ' ') AS win FROM bw),
sizes AS (SELECT DISTINCT size FROM t),
dp AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM d, sizes WHERE len(w) >= size),
dw AS (SELECT doc_id, size, pos, array_to_string(w[pos:pos + size - 1], ' ') AS win FROM dp),
hits AS (SELECT doc_id, dw.size, pos, item_id FROM dw JOIN t ON dw.win = t.win AND dw.size = t.size),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id
"""


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_trial(table(spark, sf_dir, "documents"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.labelled_urls(pages, table(spark, sf_dir, "labels")))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op8_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all pages against a replica with known damage."""
    pages = table(spark, sf_dir, "pages")
    return warc.audit(warc.archive(pages), warc.archive(warc.drill(pages)))


OP8_SQL = """
WITH p AS (SELECT page_id, url, html, CASE WHEN md5(CAST(page_id AS VARCHAR)) LIKE '00%' AND length(html) > 0
    THEN left(html, length(html) - 1) || CASE WHEN html LIKE '%~' THEN '!' ELSE '~' END ELSE html END AS hurt FROM pages),
r AS (SELECT page_id, CAST(floor(page_id / 4096) AS BIGINT) AS file,
    replace('WARC/1.1@WARC-Type: resource@WARC-Target-URI: ', '@', chr(13) || chr(10)) || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS head,
    chr(13) || chr(10) || chr(13) || chr(10) AS gap, html, hurt FROM p),
b AS (SELECT page_id, file, head || strlen(html) || gap || html || gap AS a, head || strlen(hurt) || gap || hurt || gap AS c FROM r)
SELECT page_id, file, row_number() OVER w AS slot, CAST(coalesce(sum(strlen(a)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
    strlen(a) AS length, sha256(a) AS sha256, sha256(c) AS found_sha256, CASE WHEN a = c THEN 'intact' ELSE 'damaged' END AS status
FROM b WINDOW w AS (PARTITION BY file ORDER BY page_id)
"""


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine_by_id(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS own, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE own QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.own AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) QUALIFY row_number() OVER w <= 5
"""


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audit(table(spark, sf_dir, "documents"), manifest.stripped(F.col("doc_id"), F.col("text")))


OP13_SQL = r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
x AS (SELECT doc_id, source, lang, n_chars, text,
    CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c // 256)), 4294967295) % 2 = 0
        THEN replace(text, chr(10), '') ELSE text END AS now FROM documents, crc),
h AS (SELECT doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS was, coalesce(strlen(now) || ':' || now, '-') AS is_now FROM x),
d AS (SELECT doc_id, coalesce('=' || source, '-') AS tree, sha256(head || was) AS leaf, sha256(head || is_now) AS found FROM h),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k0, count(*) OVER (PARTITION BY tree) AS n0 FROM d),
t(tree, lev, k, n, digest) AS (SELECT tree, 0, k0, n0, leaf FROM l
    UNION ALL SELECT tree, lev + 1, k // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY k)) FROM t WHERE n > 1 GROUP BY tree, lev, k // 3, n),
s AS (SELECT tree, lev AS height, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS q, count(*) OVER () AS m FROM t WHERE n = 1),
u(lev, k, n, digest) AS (SELECT 0, q, m, subroot FROM s
    UNION ALL SELECT lev + 1, k // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY k)) FROM u WHERE n > 1 GROUP BY lev, k // 3, n),
r AS (SELECT lev AS top, digest AS root FROM u WHERE n = 1),
a AS (SELECT l.tree, k0, lev, k, k // 3 AS run, digest, k < k0 // CAST(pow(3, lev) AS BIGINT) AS ahead FROM l JOIN t ON t.tree = l.tree AND n > 1 AND k // 3 = k0 // CAST(pow(3, lev + 1) AS BIGINT) AND k <> k0 // CAST(pow(3, lev) AS BIGINT)
    UNION ALL SELECT s.tree, k0, height + lev, k, k // 3, digest, k < q // CAST(pow(3, lev) AS BIGINT) FROM l JOIN s ON s.tree = l.tree JOIN u ON n > 1 AND k // 3 = q // CAST(pow(3, lev + 1) AS BIGINT) AND k <> q // CAST(pow(3, lev) AS BIGINT)),
p AS (SELECT tree, k0, sha256(string_agg(digest, '' ORDER BY lev, k)) AS proof FROM a GROUP BY tree, k0),
g AS (SELECT tree, k0, lev, coalesce(string_agg(digest, '' ORDER BY k) FILTER (ahead), '') AS lft, coalesce(string_agg(digest, '' ORDER BY k) FILTER (NOT ahead), '') AS rgt FROM a GROUP BY tree, k0, lev),
f(tree, k0, lev, acc) AS (SELECT tree, k0, 0, found FROM l
    UNION ALL SELECT f.tree, f.k0, f.lev + 1, sha256(coalesce(lft, '') || acc || coalesce(rgt, '')) FROM f JOIN s ON s.tree = f.tree CROSS JOIN r LEFT JOIN g ON g.tree = f.tree AND g.k0 = f.k0 AND g.lev = f.lev WHERE f.lev < height + top)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM l JOIN s ON s.tree = l.tree CROSS JOIN r LEFT JOIN p ON p.tree = l.tree AND p.k0 = l.k0 JOIN f ON f.tree = l.tree AND f.k0 = l.k0 AND f.lev = height + top
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_decontamination": op2_decontamination,
    "op3_urls": op3_urls,
    "op4_packing": op4_packing,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_token_counts": op6_token_counts,
    "op7_fingerprints": op7_fingerprints,
    "op8_warc_audit": op8_warc_audit,
    "op9_language": op9_language,
    "op10_toxicity": op10_toxicity,
    "op11_quality": op11_quality,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_manifest": op13_manifest,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op8_warc_audit": OP8_SQL,
    "op2_decontamination": OP2_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_manifest": OP13_SQL,
}
