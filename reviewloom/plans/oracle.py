"""The catalog's queries written independently as SQL text, for checking results by value."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from reviewloom.functions import fixed_values as fv
from reviewloom.plans import adapters as ad

R, P = ad.LATIN_RULES, ad.LATIN_POLICY
OWN, EV_OWN = ad.DOC_OWN_APP, ad.EVENT_OWN_APP
ORACLE_SQL: dict[str, str] = {}


def s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values_list(items: Iterable[str]) -> str:
    return ", ".join(s(i) for i in items)


def word(w: str) -> str:
    return "".join(w.lower().split())


def any_word(col: str, words: Sequence[str], norm: bool = True) -> str:
    return "(" + " OR ".join(f"contains({col}, {s(word(w) if norm else w)})" for w in words) + ")"


def kept(cases: Iterable[tuple[str, str]]) -> str:
    """List of the labels whose condition holds."""
    body = ", ".join(f"CASE WHEN {cond} THEN {label} END" for cond, label in cases)
    return f"list_filter([{body}], lambda x: x IS NOT NULL)"


# --- shared parts ---------------------------------------------------------------------------

REVIEWS = """reviews AS (
  SELECT d.doc_id AS ingest_seq, d.source AS app_name, d.lang AS store,
    CAST(CASE WHEN l.toxic = 1 THEN 1 WHEN l.quality = 0 THEN 2
              WHEN l.quality = 1 THEN 3 + d.doc_id % 3 END AS DOUBLE) AS rating,
    CAST(DATE '2024-01-01' + CAST(d.doc_id % 250 AS INTEGER) AS DATE) AS date, d.text AS review_text
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
EVENTS = """ev AS (
  SELECT event_id AS ingest_seq, event_type AS app_name,
    CASE WHEN user_id % 2 = 0 THEN 'google_play' ELSE 'app_store' END AS store,
    CAST(event_id % 5 + 1 AS DOUBLE) AS rating, CAST(ts AS DATE) AS date, props AS review_text
  FROM events)"""
_masked = "review_text"
for _name, _p in fv.PII_PATTERNS:
    _masked = f"regexp_replace({_masked}, {s(_p)}, '[MASKED]', 'g')"


def cleaning(source: str = "reviews", key: str = "app_name, store, review_text", prefix: str = "",
             order: str = "ingest_seq") -> str:
    return f"""{prefix}kept AS (
  SELECT * FROM {source} WHERE regexp_matches(review_text, '\\S')
  QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1),
{prefix}staged0 AS (SELECT * EXCLUDE (review_text), review_text AS original, {_masked} AS review_text FROM {prefix}kept),
{prefix}staged AS (
  SELECT *, review_text <> original AS has_pii_masked,
    trim(regexp_replace(regexp_replace(review_text, '[^0-9A-Za-z가-힣\\s.,!?~%()\\[\\]]', ' ', 'g'), '\\s+', ' ', 'g')) AS clean_text
  FROM {prefix}staged0),
{prefix}clean AS (
  SELECT *, length(clean_text)::INTEGER AS review_len FROM {prefix}staged WHERE length(clean_text) >= 5)"""


CLEAN = REVIEWS + ",\n" + cleaning()
NORM = "regexp_replace(lower(clean_text), '\\s+', '', 'g')"
_types = kept((any_word("norm", words), s(t)) for t, words in R.issue_types.items())


def classified(source: str) -> str:
    def has(types: Sequence[str]) -> str:
        return f"list_has_any(issue_types, [{values_list(types)}])"

    return f"""n0 AS (SELECT *, {NORM} AS norm FROM {source}),
n1 AS MATERIALIZED (SELECT *, {_types} AS found FROM n0),
n2 AS (SELECT *, CASE WHEN len(found) = 0 THEN ['other'] ELSE found END AS issue_types FROM n1),
cls AS MATERIALIZED (
  SELECT *, CASE
    WHEN {any_word("norm", R.high_triggers)} OR ({has(R.risky_types)} AND coalesce(rating, 9) <= 2) THEN 'high'
    WHEN coalesce(rating, 0) >= 4 AND {any_word("norm", R.positive_signals)}
      AND NOT {has(R.complaint_types)} AND NOT {any_word("norm", R.negative_signals)} THEN 'positive'
    WHEN {any_word("norm", R.negative_signals)} OR coalesce(rating, 9) <= 2 OR {has(R.complaint_types)} THEN 'medium'
    ELSE 'low' END AS severity
  FROM n2)"""


CLS = CLEAN + ",\n" + classified("clean")
COMPLAINTS = """cc AS (
  SELECT app_name, issue_type, count(*) AS n FROM
    (SELECT app_name, unnest(found) AS issue_type FROM n1 WHERE rating <= 2) GROUP BY ALL),
complaints AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY app_name ORDER BY n DESC, issue_type) AS INTEGER) AS rank
  FROM cc QUALIFY rank <= 5)"""


def metrics(source: str, days: int = 30, name: str = "metrics") -> str:
    return f"""ref_{name} AS (SELECT max(date) AS d FROM {source}),
{name} AS (
  SELECT app_name, count(*) AS review_count, avg(rating) AS avg_rating,
    avg(CASE WHEN rating <= 2 THEN 1.0 ELSE 0.0 END) AS negative_ratio,
    avg(rating) FILTER (date > (SELECT d FROM ref_{name}) - {days} AND date <= (SELECT d FROM ref_{name}))
    - avg(rating) FILTER (date > (SELECT d FROM ref_{name}) - {2 * days} AND date <= (SELECT d FROM ref_{name}) - {days})
      AS recent30d_rating_change
  FROM {source} GROUP BY app_name)"""


_safety = [(f"contains(rnorm, {s(word(p))})", s(f"banned_phrase:{p}")) for p in P.banned_phrases]
for _flag, _groups in P.safety_patterns.items():
    _cond = " OR ".join(
        "(" + " AND ".join(f"regexp_matches(reply_draft, {s(p)})" for p in g) + ")" for g in _groups)
    _safety.append((f"({_cond})", s(_flag)))
SAFETY = kept(_safety)
RNORM = "regexp_replace(lower(reply_draft), '\\s+', '', 'g')"

PAIRS = """pairs AS (
  SELECT u.conv_id * 1000 + u.turn AS ingest_seq, 'app' || (u.conv_id % 5) AS app_name, u.conv_id,
    CAST(u.conv_id % 5 + 1 AS DOUBLE) AS rating, u.text AS review_text, a.text AS reply_draft,
    ['thanks_positive', 'apology_and_guidance', 'security_sensitive', 'fallback_general'][u.conv_id % 4 + 1] AS reply_type,
    CASE WHEN u.conv_id % 3 = 0 THEN 'high' ELSE 'medium' END AS severity,
    u.conv_id % 4 = 2 AS needs_human_review
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""
SCORED = PAIRS + f""",
sc0 AS (SELECT *, {RNORM} AS rnorm FROM pairs),
sc1 AS MATERIALIZED (SELECT *, {SAFETY} AS flags FROM sc0),
scored AS MATERIALIZED (
  SELECT *, array_to_string(flags, ', ') AS safety_flags_eval, len(flags) = 0 AS is_safe,
    CASE WHEN reply_draft = '' THEN 0 ELSE 1
      + CASE WHEN regexp_matches(reply_draft, {s(P.polite_pattern)}) THEN 1 ELSE 0 END
      + CASE WHEN len(list_filter(regexp_split_to_array(reply_draft, '[.!?]\\s*'), lambda x: regexp_matches(x, '\\S')))
          BETWEEN 2 AND 4 THEN 1 ELSE 0 END END AS tone_score,
    CASE WHEN len(flags) = 0 THEN 3 ELSE 0 END AS safety_score,
    CASE WHEN reply_draft = '' THEN 0 ELSE 1
      + CASE WHEN {any_word("reply_draft", P.empathy_words, False)} THEN 1 ELSE 0 END
      + CASE WHEN {any_word("reply_draft", P.action_words, False)} THEN 1 ELSE 0 END END AS helpfulness_score
  FROM sc1)"""

TRAIN_LABEL = ("CASE WHEN rating IS NULL THEN NULL WHEN trunc(rating) <= 2 THEN 'negative' "
               "WHEN trunc(rating) = 3 THEN 'neutral' ELSE 'positive' END")
SERVING_LABEL = ("CASE WHEN rating IS NULL THEN 'neutral' WHEN rating <= 2 THEN 'negative' "
                 "WHEN rating = 3 THEN 'neutral' ELSE 'positive' END")
DAY = "strftime(date, '%Y-%m-%d') AS date"


def pct(ratio: str, digits: int = 1) -> str:
    return f"printf('%.{digits}f%%', round({ratio} * 100, {digits}))"


def add(name: str, *parts: str) -> None:
    *ctes, final = parts
    ORACLE_SQL[name] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + final


# --- cleaning and quality -------------------------------------------------------------------

add("clean_reviews", CLEAN, f"""SELECT ingest_seq, app_name, store, rating, {DAY}, review_text, clean_text,
  review_len, has_pii_masked, has_pii_masked AS needs_human_review FROM clean""")
add("pii_flag_counts", CLEAN, "SELECT has_pii_masked, count(*) AS n FROM clean GROUP BY 1")
add("keep_first_by_text", REVIEWS, cleaning(key="review_text"), "SELECT ingest_seq, app_name, store FROM kept")
FENCES = """q AS (SELECT quantile_cont(review_len, 0.25) AS q1, quantile_cont(review_len, 0.5) AS median,
    quantile_cont(review_len, 0.75) AS q3, min(review_len) AS min_len, max(review_len) AS max_len FROM clean),
fences AS (SELECT *, q3 - q1 AS iqr, greatest(0, q1 - 1.5 * (q3 - q1)) AS low_fence,
    q3 + 1.5 * (q3 - q1) AS high_fence FROM q)"""
add("quality_summary", CLEAN, FENCES, """c AS (SELECT
  (SELECT count(*) FROM reviews) AS input_rows,
  (SELECT count(*) FROM clean) AS output_rows,
  (SELECT count(*) FROM reviews) - (SELECT count(*) FROM clean) AS removed_rows,
  (SELECT count(*) FROM reviews WHERE review_text IS NULL OR NOT regexp_matches(review_text, '\\S')) AS null_text_rows,
  (SELECT count(*) FROM reviews WHERE regexp_matches(review_text, '\\S')) - (SELECT count(*) FROM kept) AS duplicate_rows_removed,
  (SELECT count(*) FROM kept) - (SELECT count(*) FROM clean) AS too_short_rows_removed,
  (SELECT count(*) FROM staged WHERE has_pii_masked) AS pii_masked_rows,
  (SELECT count(*) FROM clean WHERE has_pii_masked) AS needs_human_review_rows,
  (SELECT count(*) FROM clean WHERE date IS NULL) AS date_parse_failed_rows,
  (SELECT count(*) FROM clean, fences WHERE review_len < low_fence OR review_len > high_fence) AS outlier_rows)""",
    """SELECT *, round(null_text_rows / input_rows, 6) AS null_text_rate,
  round(duplicate_rows_removed / input_rows, 6) AS duplicate_rate,
  round(date_parse_failed_rows / output_rows, 6) AS date_parse_fail_rate,
  round(pii_masked_rows / output_rows, 6) AS pii_masked_rate,
  round(outlier_rows / output_rows, 6) AS outlier_rate FROM c""")
add("length_distribution", CLEAN, FENCES,
    "SELECT min_len, q1, median, q3, max_len, iqr, low_fence, high_fence FROM fences")
add("length_outliers", CLEAN, FENCES,
    "SELECT ingest_seq, review_len FROM clean, fences WHERE review_len < low_fence OR review_len > high_fence")
add("duplicate_count", "SELECT count(*) - count(DISTINCT text) AS duplicate_rows FROM documents")


def gate(name: str, base: str, source: str, own: str) -> None:
    titles = [t.replace("{own}", own) for _, t in fv.GATE_CHECKS]
    ids = [i for i, _ in fv.GATE_CHECKS]

    def row(i: int, passed: str, detail: str) -> str:
        return (f"SELECT {i} AS check_no, {s(ids[i - 1])} AS check_id, {s(titles[i - 1])} AS name, "
                f"{passed} AS passed, {detail} AS detail FROM f")

    add(name, base, f"""f AS (SELECT count(*) AS n,
  count(*) FILTER (review_text IS NULL OR NOT regexp_matches(review_text, '\\S')) AS blank,
  count(date) AS dated, count(*) FILTER (rating IS NULL OR rating < 1 OR rating > 5) AS bad,
  (SELECT count(*) FROM (SELECT DISTINCT app_name, store, review_text FROM {source})) AS keys,
  count(DISTINCT app_name) AS apps, count(DISTINCT app_name) FILTER (app_name <> {s(own)}) AS comp,
  coalesce(bool_or(app_name = {s(own)}), false) AS has_own FROM {source})""", " UNION ALL ".join([
        row(1, "true", s(fv.GATE_COLUMNS_OK)),
        row(2, "blank / n <= 0.05", f"'결측률 ' || {pct('blank / n', 2)} || ' (결측 ' || blank || '건 / ' || n || '건)'"),
        row(3, "dated / n >= 0.95", f"'성공률 ' || {pct('dated / n', 2)} || ' (성공 ' || dated || '건 / ' || n || '건)'"),
        row(4, "(n - keys) / n <= 0.03",
            f"'중복률 ' || {pct('(n - keys) / n', 2)} || ' (중복 ' || (n - keys) || '건 / ' || n || '건)'"),
        row(5, "bad = 0", "CASE WHEN bad = 0 THEN '모든 rating 정상' ELSE '범위 이탈/결측 ' || bad || '건' END"),
        row(6, "n >= 1000", "'총 ' || n || '건'"),
        row(7, "has_own AND comp >= 3", f"{s(own)} || ' 포함=' || CASE WHEN has_own THEN 'True' ELSE 'False' END "
            "|| ', 경쟁 앱 ' || comp || '개 (전체 ' || apps || '개)'"),
    ]))


gate("quality_gate_documents", REVIEWS, "reviews", OWN)
gate("quality_gate_events", EVENTS, "ev", EV_OWN)
ORACLE_SQL["quality_gate_verdict"] = (
    "SELECT bool_and(passed) AS passed FROM (" + ORACLE_SQL["quality_gate_events"] + ")")
_gone = "CASE x.no WHEN 1 THEN '누락 컬럼: [''version'']' WHEN 6 THEN '총 ' || n || '건' ELSE '컬럼 없음 또는 데이터 없음' END"
add("quality_gate_missing_column", "f AS (SELECT count(*) AS n FROM documents)",
    "x AS (SELECT * FROM (VALUES " + ", ".join(
        f"({i + 1}, {s(cid)}, {s(t.replace('{own}', OWN))})" for i, (cid, t) in enumerate(fv.GATE_CHECKS))
    + ") v(no, check_id, name))",
    f"SELECT x.no AS check_no, x.check_id, x.name, x.no = 6 AND n >= 1000 AS passed, {_gone} AS detail FROM f, x")
add("clean_export", CLEAN, f"SELECT ingest_seq, {DAY}, store, review_len FROM clean")

# --- counts and facets ----------------------------------------------------------------------

add("value_counts_store", "SELECT lang AS store, count(*) AS n FROM documents GROUP BY 1")
add("value_counts_app", "SELECT source AS app_name, count(*) AS n FROM documents GROUP BY 1")
add("facet_values", """SELECT DISTINCT 'app_name' AS facet, source AS value FROM documents
UNION ALL SELECT DISTINCT 'store', lang FROM documents""")
add("date_span", """SELECT strftime(min(ts), '%Y-%m-%d') AS first_date, strftime(max(ts), '%Y-%m-%d') AS last_date
FROM events""")
add("distinct_apps", "SELECT count(DISTINCT source) AS app_count FROM documents")
add("other_apps", f"SELECT DISTINCT source AS app_name FROM documents WHERE source <> {s(OWN)}")
add("weak_label_dist_train", REVIEWS,
    f"SELECT {TRAIN_LABEL} AS sentiment, count(*) AS n FROM reviews WHERE rating IS NOT NULL GROUP BY 1")
add("weak_label_dist_serving", REVIEWS, f"SELECT {SERVING_LABEL} AS sentiment, count(*) AS n FROM reviews GROUP BY 1")
add("class_share", REVIEWS, f"""SELECT {TRAIN_LABEL} AS sentiment, count(*) AS n,
  round(count(*) / (SELECT count(rating) FROM reviews), 6) AS share
FROM reviews WHERE rating IS NOT NULL GROUP BY 1""")

# --- issue rules ----------------------------------------------------------------------------

add("classified_reviews", CLS, "SELECT ingest_seq, array_to_string(issue_types, ',') AS issue_types, severity FROM cls")
_dict = ", ".join(f"({s(t)}, {s(w)}, {s(word(w))})" for t, ws in R.issue_types.items() for w in ws)
add("matched_keywords", CLEAN, f"k AS (SELECT * FROM (VALUES {_dict}) v(issue_type, keyword, needle))",
    f"SELECT ingest_seq, issue_type, keyword FROM clean JOIN k ON contains({NORM}, needle)")
add("matched_keywords_table", CLEAN, """k AS (SELECT DISTINCT keyword FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS keyword FROM benchmark)
  WHERE length(keyword) >= 5)""", f"""SELECT ingest_seq, 'length ' || length(keyword) AS issue_type, keyword
FROM (SELECT ingest_seq, {NORM} AS norm FROM clean) JOIN k ON contains(norm, keyword)""")
add("severity_dist", CLS, "SELECT severity, count(*) AS n FROM cls GROUP BY 1")


def top_issues(group: str | None, expr: str, n: int, where: str = "true") -> tuple[str, str]:
    g = f"{expr} AS {group}, " if group else ""
    names = f"{group}, " if group else ""
    counts = f"""tc AS (SELECT {names}issue_type, count(*) AS n FROM
  (SELECT {g}unnest(found) AS issue_type FROM n1 WHERE {where}) GROUP BY ALL)"""
    part = f"PARTITION BY {group} " if group else ""
    final = (f"SELECT *, CAST(row_number() OVER ({part}ORDER BY n DESC, issue_type) AS INTEGER) AS rank "
             f"FROM tc QUALIFY rank <= {n}")
    return counts, final


add("top_issues_by_app", CLS, *top_issues("app_name", "app_name", 5))
add("top_issues_by_period", CLS, *top_issues("period", "strftime(date, '%Y-%m')", 5))
add("top_issues_by_day", CLS, *top_issues("period", "strftime(date, '%Y-%m-%d')", 1))
add("top_issues_global", CLS, top_issues(None, "", 10)[0],
    "SELECT issue_type, n FROM tc ORDER BY n DESC, issue_type LIMIT 10")
add("top_complaints_by_app", CLS, COMPLAINTS, "SELECT app_name, issue_type, n, rank FROM complaints")
add("complaint_text_roundtrip", CLS, COMPLAINTS,
    "SELECT app_name, issue_type, CAST(n AS INTEGER) AS n FROM complaints")

# --- app metrics ----------------------------------------------------------------------------

R6 = "round({0}, 6) AS {0}"
METRIC_COLS = ("app_name, review_count, round(avg_rating, 6) AS avg_rating, round(negative_ratio, 6) AS negative_ratio, "
               "round(recent30d_rating_change, 6) AS recent30d_rating_change")
add("csv_round_trip", CLEAN, f"""SELECT ingest_seq, app_name, store, {DAY}, review_len, md5(review_text) AS text_md5 FROM clean""")
add("app_metrics", REVIEWS, metrics("reviews"), f"SELECT {METRIC_COLS} FROM metrics")
add("recent_change", EVENTS, metrics("ev", 7),
    "SELECT app_name, round(recent30d_rating_change, 6) AS recent30d_rating_change FROM metrics")
add("recent_change_default", EVENTS, metrics("ev", 30),
    "SELECT app_name, round(recent30d_rating_change, 6) AS recent30d_rating_change FROM metrics")
RANKED = """ranked AS (SELECT app_name, avg_rating, CAST(floor(rank() OVER (ORDER BY avg_rating DESC)
  + (count(*) OVER (PARTITION BY avg_rating) - 1) / 2) AS INTEGER) AS rating_rank
  FROM metrics WHERE avg_rating IS NOT NULL)"""
add("rating_rank", REVIEWS, metrics("reviews"), RANKED, f"""SELECT app_name, round(avg_rating, 6) AS avg_rating,
  rating_rank, (SELECT count(*) FROM metrics) AS app_count FROM ranked WHERE app_name = {s(OWN)}""")
FEATURES = "features AS (SELECT app_name, " + ", ".join(
    f"avg(CASE WHEN {any_word('norm', ws)} THEN 1.0 ELSE 0.0 END) AS feat_{f}_mention_rate"
    for f, ws in ad.LATIN_FEATURES.items()) + f" FROM (SELECT app_name, {NORM} AS norm FROM clean) GROUP BY 1)"
FEATURE_COLS = ", ".join(f"round(feat_{f}_mention_rate, 6) AS feat_{f}_mention_rate" for f in ad.LATIN_FEATURES)
add("feature_mention_rate", CLEAN, FEATURES, f"SELECT app_name, {FEATURE_COLS} FROM features")
STRENGTHS = f"""strengths AS (
  SELECT c.app_name, 'avg_rating' AS metric, c.avg_rating AS value, o.avg_rating AS own_value
  FROM metrics c, metrics o WHERE o.app_name = {s(OWN)} AND c.app_name <> o.app_name AND c.avg_rating > o.avg_rating
  UNION ALL
  SELECT c.app_name, 'negative_ratio', c.negative_ratio, o.negative_ratio
  FROM metrics c, metrics o WHERE o.app_name = {s(OWN)} AND c.app_name <> o.app_name
    AND c.negative_ratio < o.negative_ratio)"""
add("competitor_strengths", REVIEWS, metrics("reviews"), STRENGTHS,
    "SELECT app_name, metric, round(value, 6) AS value, round(own_value, 6) AS own_value FROM strengths")
WORST = f"""worst AS (SELECT issue_type, CAST(sum(n) AS BIGINT) AS n FROM complaints WHERE app_name <> {s(OWN)}
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)"""
add("gap_insights", CLS, COMPLAINTS, metrics("clean"), RANKED, STRENGTHS, WORST, f"""
SELECT 'competitor_strength' AS kind, app_name, metric, round(value, 6) AS value,
  round(own_value, 6) AS reference_value FROM strengths
UNION ALL SELECT 'own_weakness', app_name, issue_type, n, rank FROM complaints WHERE app_name = {s(OWN)} AND rank <= 3
UNION ALL SELECT 'opportunity', app_name, 'rating_rank', rating_rank, (SELECT count(*) FROM metrics)
  FROM ranked WHERE app_name = {s(OWN)}
UNION ALL SELECT 'opportunity', NULL, 'competitor_issue:' || issue_type, n, NULL FROM worst
UNION ALL SELECT 'competitor_strength', NULL, {s(fv.NO_COMPETITOR_AHEAD)}, NULL, NULL
  WHERE NOT EXISTS (SELECT 1 FROM strengths)
UNION ALL SELECT 'own_weakness', NULL, {s(fv.NO_COMPLAINT_DATA)}, NULL, NULL
  WHERE NOT EXISTS (SELECT 1 FROM complaints WHERE app_name = {s(OWN)})""")
add("worst_competitor_issue", CLS, COMPLAINTS, WORST, "SELECT issue_type, n FROM worst")


def toks(expr: str, stop: Sequence[str]) -> str:
    return (f"list_filter(regexp_extract_all({expr}, '[가-힣A-Za-z0-9]+'), "
            f"lambda t: length(t) >= 2 AND t NOT IN ({values_list(stop)}))")


ALL_STOP = list(dict.fromkeys(fv.STOPWORDS + fv.TOPIC_STOPWORDS))


def term_rows(group: str, stop: Sequence[str]) -> str:
    return f"""tk AS (SELECT {group}ingest_seq, {toks("lower(clean_text)", stop)} AS t FROM clean),
tr AS (SELECT {group}ingest_seq, unnest(list_concat(t, CASE WHEN len(t) < 2 THEN CAST([] AS VARCHAR[])
  ELSE list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1]) END)) AS term FROM tk),
tf AS (SELECT {group}ingest_seq, term, count(*) AS tf FROM tr GROUP BY ALL)"""


APP_TERMS = term_rows("app_name, ", fv.STOPWORDS) + """,
nd AS (SELECT app_name, count(*) AS n_docs FROM clean GROUP BY 1),
voc AS (SELECT tf.app_name, term, ln((1.0 + n_docs) / (1.0 + count(*))) + 1 AS idf
  FROM tf JOIN nd ON nd.app_name = tf.app_name WHERE n_docs >= 5
  GROUP BY tf.app_name, term, n_docs HAVING count(*) >= 3 AND count(*) <= 0.5 * n_docs),
w AS (SELECT tf.app_name, ingest_seq, tf.term, tf.tf * idf AS w FROM tf
  JOIN voc ON voc.app_name = tf.app_name AND voc.term = tf.term),
nw AS (SELECT app_name, ingest_seq, sqrt(sum(w * w)) AS nrm FROM w GROUP BY ALL),
sc AS (SELECT w.app_name, term, round(sum(w / nrm), 9) AS score FROM w
  JOIN nw ON nw.app_name = w.app_name AND nw.ingest_seq = w.ingest_seq GROUP BY ALL),
terms AS (SELECT *, CAST(row_number() OVER (PARTITION BY app_name ORDER BY score DESC, term) AS INTEGER) AS rank
  FROM sc QUALIFY rank <= 5)"""
add("benchmark_summary", CLS, COMPLAINTS, metrics("clean"), FEATURES, APP_TERMS, f"""
SELECT {METRIC_COLS.replace("app_name", "m.app_name", 1)}, {FEATURE_COLS},
  coalesce((SELECT string_agg(issue_type || ':' || n, ' | ' ORDER BY rank) FROM complaints c
    WHERE c.app_name = m.app_name), '-') AS top_complaint_types,
  coalesce((SELECT string_agg(term, ' | ' ORDER BY rank) FROM terms t WHERE t.app_name = m.app_name), '-')
    AS top_topic_keywords
FROM metrics m LEFT JOIN features f ON f.app_name = m.app_name""")
add("better_competitors", REVIEWS, metrics("reviews"), f"""SELECT app_name, round(avg_rating, 6) AS avg_rating,
  round(negative_ratio, 6) AS negative_ratio FROM metrics
WHERE app_name <> {s(OWN)} AND avg_rating > (SELECT avg_rating FROM metrics WHERE app_name = {s(OWN)})
ORDER BY metrics.avg_rating DESC, app_name LIMIT 3""")
add("app_mean_compare", EVENTS, f"""SELECT app_name, round(avg(rating), 6) AS avg_rating,
  CASE WHEN app_name = {s(EV_OWN)} THEN 'base' ELSE 'competitor' END AS role FROM ev
WHERE app_name IN ({s(EV_OWN)}, 'click', 'view', 'error') GROUP BY 1""")
add("kpi_row", REVIEWS, f"""k AS (SELECT count(*) AS review_count, coalesce(round(avg(rating), 2), 0) AS a,
  avg(CASE WHEN rating <= 2 THEN 1.0 ELSE 0.0 END) AS g FROM reviews WHERE app_name = {s(OWN)})""",
    """SELECT review_count, a AS avg_rating, round(g, 6) AS negative_ratio,
  CASE WHEN a >= 3.5 THEN 'ok' WHEN a >= 2.5 THEN 'warn' ELSE 'bad' END AS avg_tone,
  CASE WHEN g >= 0.5 THEN 'bad' WHEN g >= 0.3 THEN 'warn' ELSE 'ok' END AS negative_tone FROM k""")
for _q, _base, _src in (("trend_daily", EVENTS, "ev"), ("trend_monthly", REVIEWS, "reviews")):
    add(_q, _base, f"""SELECT CASE WHEN (SELECT max(date) - min(date) FROM {_src}) <= 70
    THEN strftime(date, '%Y-%m-%d') ELSE strftime(date, '%Y-%m') END AS period,
  count(*) AS review_count, round(avg(rating), 6) AS avg_rating FROM {_src} GROUP BY 1""")
add("period_benchmark", EVENTS, """SELECT app_name, count(*) AS review_count, round(avg(rating), 6) AS avg_rating,
  round(avg(CASE WHEN rating <= 2 THEN 1.0 ELSE 0.0 END), 6) AS negative_ratio FROM ev
WHERE date >= DATE '2024-01-08' AND date <= DATE '2024-01-21' GROUP BY 1""")
add("period_filter_next_day", EVENTS, """SELECT strftime(date, '%Y-%m-%d') AS date, count(*) AS n FROM ev
WHERE date BETWEEN DATE '2024-01-08' AND DATE '2024-01-22' GROUP BY 1""")

# --- search, listings, display --------------------------------------------------------------

add("review_search", CLEAN, """SELECT ingest_seq, app_name, store, rating FROM clean
WHERE store IN ('en', 'de') AND rating BETWEEN 2 AND 4 AND regexp_matches(clean_text, 'TH(ing|er)[a-z]+', 'i')""")
add("review_search_literal", CLEAN, """SELECT ingest_seq, rating FROM clean
WHERE rating BETWEEN 1 AND 5 AND contains(lower(clean_text), 'the th')""")
add("review_search_indexed", CLEAN, """SELECT ingest_seq, app_name, store, rating FROM clean
WHERE store IN ('en', 'de') AND rating BETWEEN 2 AND 4 AND regexp_matches(clean_text, 'the TH[a-z]+ (on|of)', 'i')""")
add("negative_listing", CLEAN, f"""SELECT ingest_seq, app_name, rating, {DAY}, clean_text FROM clean
WHERE rating <= 2 ORDER BY ingest_seq LIMIT 100""")
add("evidence_rows", CLEAN, """SELECT CAST(row_number() OVER (ORDER BY ingest_seq) AS INTEGER) AS evidence_no,
  app_name || ' 리뷰' AS source, substr(clean_text, 1, 120) AS text FROM clean WHERE rating <= 2
QUALIFY evidence_no <= 3""")
add("display_view", EVENTS, f"""SELECT app_name AS "앱",
  CASE store WHEN 'google_play' THEN '구글플레이' ELSE store END AS "스토어",
  strftime(max(date), '%Y-%m-%d') AS "날짜", count(*) AS "리뷰 수",
  {pct("avg(CASE WHEN rating <= 2 THEN 1.0 ELSE 0.0 END)")} AS "부정률" FROM ev GROUP BY app_name, store""")
add("reply_candidates_latest", CLEAN, f"""SELECT ingest_seq, app_name, {DAY} FROM clean
ORDER BY clean.date DESC NULLS LAST, ingest_seq LIMIT 50""")
add("reply_candidates_priority", CLEAN, "pool AS (SELECT * FROM clean ORDER BY date DESC NULLS LAST, ingest_seq LIMIT 400)",
    classified("pool"), f"""SELECT ingest_seq, severity, rating, {DAY} FROM cls
ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END,
  rating ASC NULLS LAST, cls.date DESC NULLS LAST, ingest_seq LIMIT 50""")

# --- set operations -------------------------------------------------------------------------

add("union_sources", REVIEWS, EVENTS, """SELECT app_name, store, count(*) AS n FROM
  (SELECT app_name, store FROM reviews UNION ALL SELECT app_name, store FROM ev) GROUP BY ALL""")
BOTH = """both_loads AS (SELECT *, 0 AS source_no FROM reviews
  UNION ALL SELECT * REPLACE ('en' AS store), 1 AS source_no FROM reviews)"""
add("merge_reviews", REVIEWS, BOTH, """SELECT ingest_seq, app_name, store, rating, source_no FROM both_loads
QUALIFY row_number() OVER (PARTITION BY app_name, store, review_text ORDER BY source_no, ingest_seq) = 1""")
add("overwrite_apply", REVIEWS, "fresh AS (SELECT * REPLACE ('en' AS store) FROM reviews)", cleaning("fresh"),
    "SELECT ingest_seq, app_name, store, clean_text FROM clean")
add("merge_apply", REVIEWS, BOTH, cleaning("both_loads", order="source_no, ingest_seq"),
    "SELECT ingest_seq, source_no, app_name, store, review_len, has_pii_masked FROM clean")
add("merge_incremental", REVIEWS, BOTH, cleaning("both_loads", order="source_no, ingest_seq"),
    "SELECT ingest_seq, source_no, app_name, store, review_len, has_pii_masked FROM clean")
add("collect_and_clean", REVIEWS, """three AS (SELECT *, 0 AS source_no FROM reviews WHERE rating IS NOT NULL
  UNION ALL SELECT *, 1 FROM reviews WHERE store = 'en' UNION ALL SELECT * REPLACE ('en' AS store), 2 FROM reviews)""",
    cleaning("three", order="source_no, ingest_seq"),
    "SELECT ingest_seq, source_no, app_name, store, review_len FROM clean")
add("rating_labels", EVENTS, """r AS (SELECT ingest_seq, rating * [1.0, -3.5, 0.5, 1e11, 1e300][ingest_seq % 5 + 1] AS x FROM ev)""",
    """SELECT ingest_seq, CASE WHEN trunc(x) <= 2 THEN 'negative' WHEN trunc(x) = 3 THEN 'neutral' ELSE 'positive' END AS train,
  CASE WHEN x <= 2 THEN 'negative' WHEN x = 3 THEN 'neutral' ELSE 'positive' END AS serving FROM r""")
add("standard_columns", """SELECT source AS app_name, CAST(0 AS BIGINT) AS dates, CAST(0 AS BIGINT) AS urls,
  count(text) AS texts FROM documents GROUP BY 1""")

# --- tokens and terms -----------------------------------------------------------------------

add("tokens", CLEAN, f"tk AS (SELECT ingest_seq, {toks('clean_text', fv.STOPWORDS)} AS t FROM clean)",
    "SELECT ingest_seq, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS tokens FROM tk")
add("token_filter", CLEAN, f"tk AS (SELECT ingest_seq, {toks('clean_text', ALL_STOP)} AS t FROM clean)",
    "SELECT ingest_seq, CAST(len(t) AS INTEGER) AS n_tokens FROM tk WHERE len(t) >= 4")
add("ngram_counts", CLEAN, f"tk AS (SELECT {toks('lower(clean_text)', fv.STOPWORDS)} AS t FROM clean)",
    """SELECT term, count(*) AS n FROM (SELECT unnest(list_transform(generate_series(1, len(t) - 1),
  lambda i: t[i] || ' ' || t[i + 1])) AS term FROM tk WHERE len(t) >= 2) GROUP BY 1""")
add("app_top_terms", CLEAN, APP_TERMS, "SELECT app_name, term, round(score, 6) AS score, rank FROM terms")
add("tfidf_terms", CLEAN, term_rows("", ALL_STOP), """
voc AS (SELECT term, ln((1.0 + (SELECT count(*) FROM clean)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY 1
  HAVING count(*) >= 3 AND count(*) <= 0.4 * (SELECT count(*) FROM clean)),
w AS (SELECT ingest_seq, term, (1 + ln(tf)) * idf AS w FROM tf JOIN voc USING (term)),
nw AS (SELECT ingest_seq, sqrt(sum(w * w)) AS nrm FROM w GROUP BY 1)""",
    "SELECT term, count(*) AS n_docs, round(sum(w / nrm), 5) AS weight FROM w JOIN nw USING (ingest_seq) GROUP BY 1")

# --- replies --------------------------------------------------------------------------------


def quoted(expr: str) -> str:
    return f"'[''' || array_to_string({expr}, ''', ''') || ''']'"


_hit_types = f"list_sort(list_filter(issue_types, lambda t: t IN ({values_list(P.force_types)})))"
_hit_words = kept((f"contains(norm, {s(word(w))})", s(w)) for w in P.force_keywords)
_force = kept([
    (f"severity IN ({values_list(P.force_severities)})", "'severity=' || severity"),
    (f"len({_hit_types}) > 0", f"'issue_types=' || {quoted(_hit_types)}"),
    (f"len({_hit_words}) > 0", f"'keywords=' || {quoted(_hit_words)}"),
])
_rtype = "CASE severity " + " ".join(f"WHEN {s(k)} THEN {s(v)}" for k, v in P.severity_to_type.items()) + (
    f" ELSE CASE WHEN sentiment = 'positive' THEN {s(P.positive_type)} ELSE {s(P.fallback_type)} END END")
_draft = "CASE reply_type " + " ".join(
    f"WHEN {s(k)} THEN replace({s(v)}, '{{app}}', app_name)" for k, v in P.templates.items()) + " END"
CHOSEN = f"""ch0 AS (SELECT *, coalesce({TRAIN_LABEL}, 'neutral') AS sentiment FROM cls),
ch AS MATERIALIZED (SELECT *, {_rtype} AS reply_type, {_force} AS force_flags FROM ch0)"""
_needs_type = f"reply_type IN ({values_list(P.reviewed_types)})"
_reason = kept([
    ("len(force_flags) > 0", f"{s(fv.REASON_FORCED_RULE)} || array_to_string(force_flags, '; ')"),
    (_needs_type, "'유형 ' || reply_type || ' 기본 검수'"),
    ("len(flags) > 0", f"{s(fv.REASON_UNSAFE)} || array_to_string(flags, ', ')"),
])
DRAFTED = CHOSEN + f""",
dr0 AS (SELECT *, {_draft} AS reply_draft FROM ch),
dr1 AS (SELECT *, {RNORM} AS rnorm FROM dr0),
dr2 AS MATERIALIZED (SELECT *, {SAFETY} AS flags FROM dr1),
drafts AS MATERIALIZED (SELECT *, len(force_flags) > 0 OR {_needs_type} OR len(flags) > 0 AS needs_human_review,
  '[fallback] ' || CASE WHEN len({_reason}) = 0 THEN {s(fv.REASON_RULE_NONE)}
    ELSE array_to_string({_reason}, ' / ') END AS reason FROM dr2)"""
add("reply_type_choice", CLS, CHOSEN, "SELECT ingest_seq, sentiment, severity, reply_type FROM ch")
add("forced_review", CLS, CHOSEN, "SELECT ingest_seq, array_to_string(force_flags, '; ') AS force_flags FROM ch")
add("rule_drafts", CLS, DRAFTED, """SELECT ingest_seq, reply_draft, reply_type,
  array_to_string(flags, ', ') AS safety_flags, needs_human_review, reason FROM drafts""")
add("draft_batch", CLEAN, "head AS (SELECT * FROM clean ORDER BY ingest_seq LIMIT 30)", classified("head"), DRAFTED,
    """SELECT ingest_seq, app_name, rating, clean_text AS review_text, sentiment,
  array_to_string(issue_types, ', ') AS issue_types, severity, reply_draft, reply_type,
  array_to_string(flags, ', ') AS safety_flags, needs_human_review, reason FROM drafts""")
_prompt_parts = [
    ("Draft an answer to a public app review. It is a draft: a person checks it before use.\napp: ", "app_name"),
    ("\nreview: ", "clean_text"), ("\nsentiment: ", "sentiment"),
    ("\nissues: ", "array_to_string(issue_types, ', ')"), ("\nseverity: ", "severity"),
    ("\nkind of reply: ", "reply_type"),
    (f"\ntone: {P.tone}\nNever write: {', '.join(P.banned_phrases)}\nContact text when one is needed: ",
     f"CASE WHEN reply_type = 'security_sensitive' THEN {s(P.contact_security)} ELSE {s(P.contact_default)} END"),
    ("\nOperator guidance: (없음)\nAnswer with one JSON object: reply_draft, reply_type, needs_human_review.", "''"),
]
add("reply_prompts", CLS, CHOSEN, "SELECT ingest_seq, " + " || ".join(
    f"{s(t)} || {e}" for t, e in _prompt_parts) + " AS prompt FROM ch")
ANSWERED = PAIRS + """,
answered AS (SELECT ingest_seq, app_name, rating, review_text AS clean_text, reply_draft AS answer_text,
  (ingest_seq % 1000 + ingest_seq // 1000) % 4 AS answer_case FROM pairs),
""" + classified("answered") + ",\n" + DRAFTED
_mreason = kept([
    ("len(force_flags) > 0", f"{s(fv.REASON_FORCED_MODEL)} || array_to_string(force_flags, '; ')"),
    ("len(mflags) > 0", f"{s(fv.REASON_UNSAFE)} || array_to_string(mflags, ', ')"),
    ("rating >= 4", s(fv.REASON_MODEL_FLAG)),
])
_msafety = SAFETY.replace("reply_draft", "mdraft").replace("rnorm", "mnorm")
MERGED = f"""mg0 AS (SELECT *, trim(answer_text) AS mdraft, answer_case <= 1 AND trim(answer_text) <> '' AS usable FROM drafts),
mg1 AS (SELECT *, {RNORM.replace("reply_draft", "mdraft")} AS mnorm FROM mg0),
mg2 AS MATERIALIZED (SELECT *, {_msafety} AS mflags FROM mg1),
merged AS MATERIALIZED (SELECT ingest_seq,
  CASE WHEN usable THEN mdraft ELSE reply_draft END AS reply_draft,
  CASE WHEN usable THEN 'thanks_positive' ELSE reply_type END AS reply_type,
  array_to_string(CASE WHEN usable THEN mflags ELSE flags END, ', ') AS safety_flags,
  CASE WHEN usable THEN len(force_flags) > 0 OR {_needs_type} OR rating >= 4 OR len(mflags) > 0
    ELSE needs_human_review END AS needs_human_review,
  CASE WHEN usable THEN '[llm] ' || CASE WHEN len({_mreason}) = 0 THEN {s(fv.REASON_MODEL_NONE)}
      ELSE array_to_string({_mreason}, ' / ') END
    WHEN answer_case = 2 THEN reason || ' | LLM 오류: reply_draft' ELSE reason END AS reason FROM mg2)"""
add("response_merge", ANSWERED, MERGED, "SELECT * FROM merged")
add("draft_batch_stats", ANSWERED, MERGED, """SELECT count(*) AS total_replies,
  count(*) FILTER (reason LIKE '[llm]%') AS model_replies,
  count(*) FILTER (reason NOT LIKE '[llm]%') AS fallback_replies,
  count(*) FILTER (reason LIKE '%LLM 오류:%') AS error_replies,
  count(*) FILTER (needs_human_review) AS needs_review FROM merged""")
add("draft_lookup", PAIRS, """texts AS (SELECT conv_id * 1000 + turn AS ingest_seq, text AS clean_text,
  CAST(conv_id % 5 + 1 AS DOUBLE) AS rating FROM conversations)""", classified("texts"),
    """first_draft AS (SELECT review_text, severity FROM pairs
  QUALIFY row_number() OVER (PARTITION BY review_text ORDER BY ingest_seq) = 1)""",
    """SELECT ingest_seq, CASE WHEN f.severity IS NOT NULL THEN 'drafted'
    ELSE array_to_string(issue_types, ', ') END AS issue_types,
  coalesce(f.severity, cls.severity) AS severity, f.severity IS NOT NULL AS from_draft
FROM cls LEFT JOIN first_draft f ON f.review_text = cls.clean_text""")
add("reply_safety", SCORED, "SELECT ingest_seq, safety_flags_eval, is_safe FROM scored")
add("reply_scores", SCORED, "SELECT ingest_seq, tone_score, safety_score, helpfulness_score FROM scored")
add("reply_eval_avgs", SCORED, """SELECT count(*) AS n, count(*) FILTER (NOT is_safe) AS violations,
  round(avg(tone_score), 6) AS tone_avg, round(avg(helpfulness_score), 6) AS helpfulness_avg,
  round(avg(safety_score), 6) AS safety_avg, round(avg(tone_score + helpfulness_score) / 2, 6) AS quality_avg,
  count(*) FILTER (NOT is_safe) = 0 AS safety_pass, avg(tone_score + helpfulness_score) / 2 >= 2.0 AS quality_pass
FROM scored""")
add("score_histogram", SCORED, """u AS (SELECT 'tone' AS metric, tone_score AS score FROM scored
  UNION ALL SELECT 'safety', safety_score FROM scored UNION ALL SELECT 'helpfulness', helpfulness_score FROM scored),
grid AS (SELECT metric, CAST(score AS INTEGER) AS score FROM (VALUES ('tone'), ('safety'), ('helpfulness')) m(metric),
  generate_series(0, 3) g(score))""", """SELECT grid.metric, grid.score, count(u.score) AS n FROM grid
LEFT JOIN u ON u.metric = grid.metric AND u.score = grid.score GROUP BY ALL""")
add("reply_type_dist", PAIRS, """SELECT reply_type, count(*) AS n, count(*) FILTER (needs_human_review) AS needs_review
FROM pairs GROUP BY 1""")
add("risk_cases", SCORED, """SELECT ingest_seq, app_name, rating, review_text, reply_draft, reply_type,
  safety_flags_eval, needs_human_review FROM scored WHERE NOT is_safe""")
add("eval_sample", SCORED, """keyed AS (SELECT *, md5('42:' || ingest_seq) AS k,
  (SELECT count(*) FROM scored) AS total, (SELECT count(DISTINCT reply_type) FROM scored) AS kinds FROM scored),
picked AS (SELECT * FROM keyed QUALIFY total <= 20
  OR row_number() OVER (PARTITION BY reply_type ORDER BY k) <= greatest(1, 20 // kinds)),
rest AS (SELECT * FROM keyed WHERE ingest_seq NOT IN (SELECT ingest_seq FROM picked)
  QUALIFY row_number() OVER (ORDER BY k) <= 20 - (SELECT count(*) FROM picked))""",
    """SELECT ingest_seq, reply_type, tone_score, safety_score, helpfulness_score, '' AS human_comment
FROM (FROM picked UNION ALL FROM rest)""")

# --- samples and evaluation -----------------------------------------------------------------

add("review_sample", CLS, """SELECT ingest_seq, app_name, store, rating, clean_text,
  array_to_string(issue_types, ', ') AS issue_types_auto, severity AS severity_auto, '' AS issue_types_manual,
  '' AS severity_manual, '' AS reviewer_note FROM cls ORDER BY md5('42:' || ingest_seq) LIMIT 100""")
add("stratified_pick", REVIEWS, """SELECT ingest_seq, app_name, store FROM reviews
QUALIFY row_number() OVER (PARTITION BY app_name, store ORDER BY md5('42:' || ingest_seq)) <= 2""")
add("manual_sample", CLEAN, f"""lab AS (SELECT *, {TRAIN_LABEL} AS label, md5('42:' || ingest_seq) AS k
  FROM clean WHERE rating BETWEEN 1 AND 5),
quota AS (SELECT label, greatest(1, round_even(
  least(150, (SELECT count(*) FROM lab)) * count(*) / (SELECT count(*) FROM lab), 0)) AS q FROM lab GROUP BY 1),
picked AS (SELECT lab.*, q FROM lab JOIN quota USING (label)
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY k) <= q)""",
    """SELECT ingest_seq, label AS star_label, rating, '' AS sentiment_manual, '' AS issue_manual
FROM picked ORDER BY k LIMIT 150""")
add("stratified_split", REVIEWS, f"""lab AS (SELECT ingest_seq, {TRAIN_LABEL} AS label FROM reviews
  WHERE rating IS NOT NULL)""", """SELECT ingest_seq, label,
  row_number() OVER (PARTITION BY label ORDER BY md5('42:' || ingest_seq))
    <= round(count(*) OVER (PARTITION BY label) * 0.2, 0) AS is_test FROM lab""")
JUDGED = f"""judged AS (SELECT reviews.ingest_seq, {TRAIN_LABEL} AS prediction,
  CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS label
  FROM reviews JOIN labels ON labels.doc_id = reviews.ingest_seq),
lv AS (SELECT * FROM (VALUES ('negative'), ('neutral'), ('positive')) v(l))"""
add("confusion_matrix", REVIEWS, JUDGED, """SELECT a.l AS label, b.l AS prediction, count(j.ingest_seq) AS n
FROM lv a CROSS JOIN lv b LEFT JOIN judged j ON j.label = a.l AND j.prediction = b.l GROUP BY ALL""")
MACRO = """pl AS (SELECT l, count(*) FILTER (label = l AND prediction = l) AS tp, count(*) FILTER (label = l) AS t,
  count(*) FILTER (prediction = l) AS p FROM judged, lv GROUP BY l HAVING t + p > 0),
mm AS (SELECT (SELECT count(*) FROM judged) AS n,
  (SELECT count(*) FILTER (label = prediction) / count(*) FROM judged) AS accuracy,
  avg(CASE WHEN p = 0 THEN 0 ELSE tp / p END) AS precision_macro,
  avg(CASE WHEN t = 0 THEN 0 ELSE tp / t END) AS recall_macro, avg(2 * tp / (t + p)) AS f1_macro FROM pl)"""
add("macro_metrics", REVIEWS, JUDGED, MACRO, """SELECT n, round(accuracy, 6) AS accuracy,
  round(precision_macro, 6) AS precision_macro, round(recall_macro, 6) AS recall_macro,
  round(f1_macro, 6) AS f1_macro FROM mm""")
add("human_label_rows", """SELECT doc_id AS ingest_seq, CASE quality WHEN 1 THEN 'positive' ELSE 'negative' END
  AS sentiment_manual FROM labels JOIN documents USING (doc_id) WHERE quality IN (0, 1)""")

add("majority_baseline", REVIEWS, f"""lab AS (SELECT ingest_seq, {TRAIN_LABEL} AS label FROM reviews WHERE rating IS NOT NULL),
sp AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || ingest_seq))
    <= round(count(*) OVER (PARTITION BY label) * 0.2, 0) AS is_test FROM lab),
top AS (SELECT label FROM sp WHERE NOT is_test GROUP BY label ORDER BY count(*) DESC, label LIMIT 1),
judged AS (SELECT label, (SELECT label FROM top) AS prediction FROM sp WHERE is_test),
lv AS (SELECT * FROM (VALUES ('negative'), ('neutral'), ('positive')) v(l))""", MACRO, """SELECT n, round(accuracy, 6) AS accuracy,
  round(precision_macro, 6) AS precision_macro, round(recall_macro, 6) AS recall_macro, round(f1_macro, 6) AS f1_macro FROM mm""")
add("score_selection", REVIEWS, """sc AS (SELECT app_name AS model, avg(CASE WHEN rating IS NULL THEN 0 ELSE 1 END) AS f,
  CAST(substr(app_name, 4) AS INTEGER) AS model_no FROM reviews GROUP BY app_name),
base AS (SELECT max(f) AS b FROM sc WHERE model IN ('src0', 'src1'))""", """SELECT model, round(f, 6) AS f1_macro,
  round(b, 6) AS baseline_f1, round(f - b, 6) AS improvement, f - b >= 0.03 AS target_met
FROM sc, base WHERE model NOT IN ('src0', 'src1') ORDER BY f DESC, model_no LIMIT 1""")
add("error_table", REVIEWS, JUDGED, """SELECT j.ingest_seq, app_name, store, rating, review_text AS clean_text,
  label AS true_label_star, prediction AS pred_label FROM judged j JOIN reviews USING (ingest_seq) WHERE label <> prediction""")
TOPICS = """tp AS (SELECT CAST(ingest_seq % 7 AS INTEGER) AS topic_id FROM clean),
ts AS (SELECT CAST(i AS INTEGER) AS topic_id, (SELECT count(*) FROM tp WHERE tp.topic_id = i) AS size,
  (SELECT count(*) FROM tp WHERE tp.topic_id = i) / (SELECT count(*) FROM tp) AS share FROM range(8) r(i))"""
add("topic_sizes", CLEAN, TOPICS, "SELECT topic_id, size, round(share, 6) AS share FROM ts")
add("topic_shares", CLEAN, TOPICS, """SELECT count(*) AS topic_count, CAST(sum(size) AS BIGINT) AS n_docs,
  round(sum(share), 6) AS coverage, round(max(share), 6) AS dominant_ratio FROM ts""")

# --- sources and sinks ----------------------------------------------------------------------

add("play_store_normalise", """SELECT source AS app_name, 'google_play' AS store,
  CAST(doc_id % 5 + 1 AS VARCHAR) AS rating,
  strftime(DATE '2024-01-01' + CAST(doc_id % 250 AS INTEGER), '%Y-%m-%d') AS date,
  trim(replace(text, chr(10), ' ')) AS review_text, CASE WHEN doc_id % 3 = 0 THEN '1.0' ELSE '' END AS version,
  'https://play.google.com/store/apps/details?id=pkg.' || source AS source_url FROM documents""")
add("feed_normalise", """SELECT source AS app_name, 'app_store' AS store, CAST(doc_id % 5 + 1 AS VARCHAR) AS rating,
  '2024-05-01' AS date, trim('title ' || lang || ' ' || replace(text, chr(10), ' ')) AS review_text,
  '2.0' AS version, 'https://apps.apple.com/kr/app/id' || source AS source_url
FROM documents""")
add("store_csv_normalise", """SELECT doc_id AS ingest_seq, 'my app' AS app_name, 'app_store' AS store,
  CAST(doc_id % 5 + 1 AS VARCHAR) AS rating, '2024-05-01' AS date, text AS review_text, '' AS version,
  '' AS source_url FROM documents""")
add("manual_fill", """SELECT doc_id AS ingest_seq, 'my app' AS app_name,
  CASE WHEN lang = 'en' THEN 'google_play' ELSE '' END AS store, '' AS rating, '' AS date, '' AS version,
  '' AS source_url FROM documents""")


APPS = f"""apps AS (SELECT DISTINCT source AS name,
  CASE WHEN length(source) > 4 THEN 'pkg.' || source ELSE '' END AS google_play,
  CAST(CAST(substr(source, 4) AS BIGINT) AS VARCHAR) AS app_store, source = {s(OWN)} AS is_our_app FROM documents)"""
add("apps_dimension", APPS, "SELECT * FROM apps")
add("collection_report", REVIEWS, APPS, f"""req AS (SELECT DISTINCT source AS app FROM documents
  UNION SELECT DISTINCT event_type FROM events),
cnt AS (SELECT app_name, CASE WHEN store = 'en' THEN 'google_play' ELSE 'app_store' END AS store, count(*) AS n
  FROM reviews WHERE rating IS NOT NULL GROUP BY ALL),
cells AS (SELECT name AS app, 'google_play' AS store FROM apps WHERE google_play <> ''
  UNION ALL SELECT name, 'app_store' FROM apps WHERE app_store <> '')""",
    f"""SELECT cells.app, cells.store, coalesce(n, 0) AS count, CASE WHEN coalesce(n, 0) > 0 THEN '수집'
  WHEN cells.store = 'app_store' THEN '결과 없음(수동 입력 권장)' ELSE '결과 없음' END AS status
FROM cells JOIN req USING (app) LEFT JOIN cnt ON cnt.app_name = cells.app AND cnt.store = cells.store
UNION ALL SELECT app, '-', 0, '미등록' FROM req WHERE app NOT IN (SELECT name FROM apps)""")
add("source_manifest", EVENTS, """SELECT app_name || ' ' || store AS source_name, 'review' AS source_type, app_name,
  '' AS url_or_file, CASE store WHEN 'google_play' THEN 'google_play_scraper' ELSE 'manual_download' END
  AS collection_method, '2024-02-01T00:00:00+00:00' AS collected_at, count(*) || ' reviews' AS terms_note,
  'collected' AS status FROM ev GROUP BY app_name, store""")
HISTORY = """hist AS (SELECT app_name AS section, 'rows_' || store AS metric, CAST(count(*) AS VARCHAR) AS value,
  strftime(date, '%Y-%m-%d') AS updated_at FROM ev GROUP BY app_name, store, date),
latest AS (SELECT * FROM hist QUALIFY updated_at = max(updated_at) OVER (PARTITION BY section))"""
add("metrics_latest", EVENTS, HISTORY, "SELECT section, metric, value, updated_at FROM latest")
add("metrics_upsert", EVENTS, HISTORY, f"""SELECT section, metric, value, updated_at FROM latest
WHERE section <> {s(EV_OWN)} AND section NOT IN (SELECT lang FROM documents)
UNION ALL SELECT {s(EV_OWN)}, 'total', CAST(count(*) AS VARCHAR), '2024-02-01' FROM ev WHERE app_name = {s(EV_OWN)}
UNION ALL SELECT lang, 'reviews', CAST(count(*) AS VARCHAR), '2024-02-01' FROM documents GROUP BY lang""")
add("run_log_latest", """runs AS (SELECT conv_id AS run_id, 'kind' || (conv_id % 3) AS kind,
  lpad(CAST(conv_id AS VARCHAR), 12, '0') AS timestamp, count(*) AS total, sum(length(text)) / 100 AS elapsed_sec
  FROM conversations GROUP BY conv_id)""", """SELECT kind, timestamp, run_id, total,
  round(elapsed_sec, 6) AS elapsed_sec, round(elapsed_sec / total, 6) AS avg_sec_per_reply,
  coalesce((SELECT string_agg(c.text, ', ' ORDER BY c.turn) FROM (SELECT * FROM conversations
    WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 10) c
    WHERE c.conv_id = runs.run_id), '') AS errors
FROM runs QUALIFY row_number() OVER (PARTITION BY kind ORDER BY timestamp DESC, run_id DESC) = 1""")

# --- reports --------------------------------------------------------------------------------

OWN_PARTS = f"""own AS (SELECT * FROM clean WHERE app_name = {s(OWN)}),
own_m AS (SELECT * FROM metrics WHERE app_name = {s(OWN)}),
own_c AS (SELECT * FROM complaints WHERE app_name = {s(OWN)}),
evid AS (SELECT CAST(row_number() OVER (ORDER BY ingest_seq) AS INTEGER) AS no, app_name || ' 리뷰' AS source,
  substr(clean_text, 1, 120) AS text FROM own WHERE rating <= 2 QUALIFY no <= 3)"""
add("own_report_inputs", CLS, COMPLAINTS, metrics("clean"), OWN_PARTS, f"""
SELECT 'kpi' AS section, 1 AS item_no, 'review_count' AS name, CAST(review_count AS DOUBLE) AS value,
  CAST(NULL AS VARCHAR) AS text FROM own_m
UNION ALL SELECT 'kpi', 2, 'avg_rating', coalesce(round(avg_rating, 2), 0), NULL FROM own_m
UNION ALL SELECT 'kpi', 3, 'negative_ratio', round(negative_ratio, 6), NULL FROM own_m
UNION ALL SELECT 'sentiment', NULL, {SERVING_LABEL}, count(*), NULL FROM own GROUP BY 3
UNION ALL SELECT 'complaints', rank, issue_type, n, NULL FROM own_c
UNION ALL SELECT 'benchmark', 1, 'review_count', review_count, app_name FROM metrics
UNION ALL SELECT 'benchmark', 2, 'avg_rating', round(avg_rating, 6), app_name FROM metrics
UNION ALL SELECT 'benchmark', 3, 'negative_ratio', round(negative_ratio, 6), app_name FROM metrics
UNION ALL SELECT 'evidence', no, source, NULL, text FROM evid""")
ALL_PARTS = OWN_PARTS.replace("FROM own WHERE", "FROM clean WHERE")
add("report_inputs", CLS, COMPLAINTS, metrics("clean"), RANKED, ALL_PARTS, f"""
SELECT 'kpi' AS section, 1 AS item_no, 'total_reviews' AS name, CAST((SELECT count(*) FROM clean) AS DOUBLE) AS value,
  CAST(NULL AS VARCHAR) AS text FROM own_m
UNION ALL SELECT 'kpi', 2, 'avg_rating', coalesce(round(avg_rating, 2), 0), NULL FROM own_m
UNION ALL SELECT 'kpi', 3, 'negative_ratio', round(negative_ratio, 6), NULL FROM own_m
UNION ALL SELECT 'kpi', 4, 'rating_rank', rating_rank, NULL FROM ranked WHERE app_name = {s(OWN)}
UNION ALL SELECT 'sentiment', NULL, {TRAIN_LABEL}, count(*), NULL FROM clean WHERE rating IS NOT NULL GROUP BY 3
UNION ALL SELECT 'complaints', rank, issue_type, n, NULL FROM own_c
UNION ALL SELECT 'benchmark', 1, 'review_count', review_count, app_name FROM metrics
UNION ALL SELECT 'benchmark', 2, 'avg_rating', round(avg_rating, 6), app_name FROM metrics
UNION ALL SELECT 'benchmark', 3, 'negative_ratio', round(negative_ratio, 6), app_name FROM metrics
UNION ALL SELECT 'evidence', no, source, NULL, text FROM evid""")
BLOCKS = f"""ri AS ({ORACLE_SQL["report_inputs"]}),
it AS (SELECT section, coalesce(item_no, 0) AS no, coalesce(name, '') AS name,
  coalesce(CAST(CAST(value AS DECIMAL(30, 6)) AS VARCHAR), '') AS v, coalesce(text, '') AS t FROM ri),
bl AS (SELECT x.s AS section, coalesce(CAST((SELECT to_json(list({{'no': no, 'name': name, 'value': v, 'text': t}}
    ORDER BY no, name, v, t)) FROM it WHERE it.section = x.s) AS VARCHAR), '[]') AS block
  FROM (VALUES ('kpi'), ('sentiment'), ('complaints'), ('topics'), ('benchmark'), ('evidence')) x(s))"""
add("report_blocks", BLOCKS, "SELECT section, block FROM bl")
add("report_prompt", BLOCKS, " || ' | ' || ".join(["SELECT (SELECT block FROM bl WHERE section = 'kpi')"] + [
    f"(SELECT block FROM bl WHERE section = {s(name)})" for name in ("sentiment", "topics", "evidence")]) + " AS prompt")
_F = fv.REPORT_FORMATS


def fmt(key: str, **cols: str) -> str:
    out = s(_F[key])
    for name, expr in cols.items():
        out = f"replace({out}, '{{{name}}}', {expr})"
    return out


_two = "printf('%.2f', round(avg_rating, 2))"
_limits = " ".join(f"UNION ALL SELECT 6, {i}, {s(_F[f'limit_{i}'])}" for i in range(1, 5))
def report_sql(name: str, told: str, parts: str, total: str) -> None:
    """told: the rows that total, sentiment and evidence are about."""
    add(name, CLS, COMPLAINTS, metrics("clean"), RANKED, parts, f"""
bet AS (SELECT *, CAST(row_number() OVER (ORDER BY avg_rating DESC, app_name) AS INTEGER) AS no FROM metrics
  WHERE app_name <> {s(OWN)} AND avg_rating > (SELECT avg_rating FROM own_m) QUALIFY no <= 3),
dist AS (SELECT {TRAIN_LABEL} AS l, count(*) AS n FROM {told} WHERE rating IS NOT NULL GROUP BY 1)""", f"""
SELECT 1 AS section, 1 AS line_no, {fmt("summary_kpi", total=total, app=s(OWN), avg=f"coalesce({_two}, 'N/A')", neg=pct("negative_ratio"))} AS text FROM own_m
UNION ALL SELECT 1, 2, {fmt("summary_rank", rank="CAST(rating_rank AS VARCHAR)")} FROM ranked WHERE app_name = {s(OWN)}
UNION ALL SELECT 1, 3, {fmt("summary_sentiment", dist="coalesce((SELECT string_agg(l || ' ' || n, ', ' ORDER BY n DESC, l) FROM dist), '')")}
UNION ALL SELECT 1, 4, {fmt("summary_complaints", complaints=f"coalesce((SELECT string_agg(issue_type || '(' || n || ')', ', ' ORDER BY rank) FROM own_c), {s(fv.COMPLAINTS_NONE)})")}
UNION ALL SELECT 2, rank, {fmt("cause", type="issue_type", n="CAST(n AS VARCHAR)")} FROM own_c WHERE rank <= 3
UNION ALL SELECT 2, 1, {s(_F["cause_none"])} WHERE NOT EXISTS (SELECT 1 FROM own_c)
UNION ALL SELECT 3, rank, {fmt("priority", prio=f"[{values_list(fv.PRIORITY_WORDS)}][rank]", type="issue_type", n="CAST(n AS VARCHAR)")} FROM own_c WHERE rank <= 3
UNION ALL SELECT 3, 1, {s(_F["priority_none"])} WHERE NOT EXISTS (SELECT 1 FROM own_c)
UNION ALL SELECT 4, no, {fmt("better", comp="app_name", avg=_two, neg=pct("negative_ratio"), app=s(OWN))} FROM bet
UNION ALL SELECT 4, 1, {fmt("better_none", app=s(OWN))} WHERE NOT EXISTS (SELECT 1 FROM bet)
UNION ALL SELECT 4, 4, {s(_F["better_note"])}
UNION ALL SELECT 5, no, {fmt("evidence", i="CAST(no AS VARCHAR)", source="source", text="text")} FROM evid
UNION ALL SELECT 5, 1, {s(_F["evidence_none"])} WHERE NOT EXISTS (SELECT 1 FROM evid)
{_limits}""")


report_sql("report_rows", "clean", ALL_PARTS, "CAST((SELECT count(*) FROM clean) AS VARCHAR)")
report_sql("own_report_rows", "own", OWN_PARTS, "CAST(review_count AS VARCHAR)")
add("success_gate", REVIEWS, JUDGED, MACRO, SCORED, f"""fact AS (SELECT
  (SELECT passed FROM ({ORACLE_SQL["quality_gate_verdict"]})) AS gate, (SELECT count(*) FROM reviews) AS total,
  (SELECT f1_macro FROM mm) AS f1, (SELECT count(*) FILTER (NOT is_safe) = 0 FROM scored) AS safe,
  (SELECT avg(tone_score + helpfulness_score) / 2 >= 2.0 FROM scored) AS good)""", """
SELECT 'data_quality_pass' AS check_name, gate AS passed, true AS decides FROM fact
UNION ALL SELECT 'min_reviews', total >= 1000, true FROM fact
UNION ALL SELECT 'sentiment_f1_target', f1 >= 0.75, false FROM fact
UNION ALL SELECT 'reply_safety_pass', safe, true FROM fact
UNION ALL SELECT 'reply_quality_pass', good, true FROM fact
UNION ALL SELECT 'overall_pass', gate AND total >= 1000 AND safe AND good, true FROM fact""")

# The same figures, read from the daily sums.
for _name in ("app_metrics", "recent_change", "kpi_row", "trend_daily", "trend_monthly", "period_benchmark"):
    ORACLE_SQL[f"{_name}_state"] = ORACLE_SQL[_name]
