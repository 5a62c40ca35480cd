import random
import re

import pytest
from pyspark.sql import functions as F

from reviewloom.functions import text as tx
from reviewloom.functions.rules import IssueRules
from reviewloom.operators import grams as gr
from reviewloom.operators import issues as iss
from reviewloom.operators import search as se

RULES = IssueRules()
TEXTS = ["OTP 인증번호 오류", "로그인이 안 돼요 LOG IN", "", None, "a", "송금 오류 송금", "x" * 5000 + "인증", "ß Straße STRASSE", "İstanbul ıI", "ΣΟΦΟΣ σοφος", "a.b*c (d)", "the theory of", "인증 인 증"]


def texts(spark):
    rows = [(i, f"app{i % 2}", "en", float(i % 5 + 1), t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "ingest_seq long, app_name string, store string, rating double, clean_text string")


def test_keyword_table_equals_the_compiled_dictionary(spark):
    df = texts(spark).select("ingest_seq", "clean_text")
    words = [(t, w) for t, ws in RULES.issue_types.items() for w in ws]
    table = spark.createDataFrame(words + words[:3] + [("none", ""), ("none", " "), ("none", None)], "issue_type string, keyword string")
    got = sorted(map(tuple, gr.keyword_matches(df, table).collect()))
    assert got == sorted(map(tuple, iss.matched_keywords(df, RULES).collect())) and got


def test_keyword_table_of_ten_thousand_words(spark):
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abcde") for _ in range(n))
    docs = [(i, word(rnd.randint(0, 60))) for i in range(150)] + [(150, None), (151, "a b\tc D")]
    words = sorted({word(rnd.randint(1, 9)) for _ in range(30_000)})
    assert len(words) > 10_000
    df = spark.createDataFrame(docs, "ingest_seq long, clean_text string")
    table = spark.createDataFrame([("t", w) for w in words], "issue_type string, keyword string")
    norm = {i: "".join((t or "").lower().split()) for i, t in docs}
    want = {(i, "t", w) for i, t in norm.items() for w in words if w in t}
    got = list(map(tuple, gr.keyword_matches(df, table).collect()))
    assert len(got) == len(want) and set(got) == want
    assert gr.keyword_matches(df, table.limit(0)).count() == 0


@pytest.mark.parametrize("pattern, pieces", [
    ("abc", ["abc"]), ("abc?d", ["ab", "d"]), ("ab+c", ["ab", "c"]), ("ab.*cd", ["ab", "cd"]), ("a|bcd", []), ("(abc|d)efg", ["efg"]), ("abc(", []), ("abc)", []),
    ("ab[xyz]cde", ["ab", "cde"]), ("abc{2}de", ["ab", "de"]), (r"a\.bcd", ["a", "bcd"]), (r"\Qa|b\E", []), (r"\bword", []), ("(?i)abc", []), ("[]x]abc", ["abc"]), ("[a[bc]]def", []), ("*a", []), ("", [])])
def test_literal_pieces(pattern, pieces):
    assert gr.literal_pieces(pattern) == pieces


def test_every_match_holds_the_pieces():
    rnd = random.Random(7)
    for _ in range(3000):
        pattern = "".join(rnd.choice(["a", "b", "ab", ".", "a?", "b*", "(ab)", "(a|b)?", "[ab]", "+", "{2}", "|", "^"]) for _ in range(rnd.randint(1, 6)))
        try:
            compiled = re.compile(pattern)
        except re.error:
            continue
        pieces = gr.literal_pieces(pattern)
        for _ in range(5):
            found = compiled.search("".join(rnd.choice("ab") for _ in range(9)))
            assert not found or all(p in found.string for p in pieces), pattern


def test_indexed_search_gives_the_rows_of_the_scan(spark, tmp_path):
    df = texts(spark)
    index = gr.text_index(df, folder=str(tmp_path))
    cases = [("인증", False), ("인증번호", False), ("otp 인증", True), ("STRASSE", False), ("straße", False), ("ISTANBUL", False), ("σοφοσ", True), ("theo.* of", False), ("a.b*c", True),
             ("인증번호|송금", False), ("", False), ("no such text", False), ("xxxxx", True), ("log[ i]+n", False)]
    for keyword, literal in cases:
        want = se.faceted_search(df, keyword=keyword, literal=literal, rating_min=2)
        got = gr.indexed_search(df, index, keyword, literal, rating_min=2)
        assert sorted(r.ingest_seq for r in got.collect()) == sorted(r.ingest_seq for r in want.collect()), keyword
    plan = gr.indexed_search(df, index, "인증번호")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[(In|Or|IsNotNull\(run\), In|In)\(?.*run", plan)


def test_fold_makes_case_variants_equal(spark):
    row = spark.range(1).select(*[gr.fold(F.lit(t)).alias(f"c{i}") for i, t in enumerate(["ΣΟΦΟΣ", "σοφος", "İx", "ix", "ſ", "s"])]).first()
    assert row.c0 == row.c1 and row.c2 == row.c3 and row.c4 == row.c5
    assert tx.normalize_word("A b") == "ab"
