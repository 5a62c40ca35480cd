import pytest
from pyspark.sql import functions as F

from reviewloom.functions import labels as lb
from reviewloom.functions import text as tx


def run(spark, expr, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_every_personal_data_pattern_is_masked(spark):
    texts = [
        "write to some.one+x@mail.example.org now", "id 900101-1234567 end", "call 010-1234-5678 now",
        "call 02-123-4567 now", "account 110-234-567890 here", "born 1990.01.02 ok",
        "card 1234 5678 1234 5678 ok", "OTP: 123456 ok", "number 12345678901234 ok", "call 010 1234 5678 x",
    ]
    for text, out in zip(texts, run(spark, tx.mask_pii, texts)):
        assert "[MASKED]" in out, text
        assert not any(ch.isdigit() for ch in out), (text, out)


def test_ordinary_text_is_not_masked(spark):
    texts = ["version 2.0 is fine", "5 stars, 100% good", "room 12345", "010-1234-5678로", "a @ b"]
    assert run(spark, tx.mask_pii, texts) == texts


def test_masking_twice_changes_nothing(spark):
    texts = ["a@b.co and 010-1234-5678 and 1990-01-02", "plain"]
    once = run(spark, tx.mask_pii, texts)
    assert run(spark, tx.mask_pii, once) == once


def test_clean_text(spark):
    texts = ["good 👍👍 app!!", "call [MASKED] now", "a\n\tb   c", "★별 다섯★", "  ", None, "50% (ok) ~ [x]"]
    assert run(spark, tx.clean_text, texts) == [
        "good app!!", "call [MASKED] now", "a b c", "별 다섯", "", "", "50% (ok) ~ [x]"]


def test_clean_text_equals_stepwise_definition(spark):
    import re
    texts = ["Où est l'été? Très   bien…", "x​y", "emoji ☀️ sun", "탭\t한글-영문_1"]
    want = [re.sub(r"\s+", " ", re.sub(r"[^0-9A-Za-z가-힣\s.,!?~%()\[\]]", " ", t)).strip() for t in texts]
    assert run(spark, tx.clean_text, texts) == want


def test_normalize_and_blank(spark):
    assert run(spark, tx.normalize, ["Log In　FAIL\x1c", None]) == ["loginfail", ""]
    assert run(spark, tx.not_blank, ["  \n", "", None, "x"]) == [False, False, False, True]
    assert run(spark, tx.unicode_trim, ["　 a b \n"]) == ["a b"]


def test_tokens_and_ngrams(spark):
    assert run(spark, tx.tokens, ["정말 앱이 a1 x 느려요-느려요 을", None]) == [["앱이", "a1", "느려요", "느려요"], []]
    assert run(spark, tx.topic_tokens, ["은행 앱 로그인 너무 느림"]) == [["로그인", "느림"]]
    arrays = [["a", "b", "c"], ["a"], []]
    assert run(spark, lambda c: tx.ngrams(c, 2), arrays, "array<string>") == [["a b", "b c"], [], []]
    assert run(spark, lambda c: tx.terms(c, 1, 3), arrays, "array<string>") == [
        ["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]


@pytest.mark.parametrize("value,label_train,label_serving", [
    (1.0, "negative", "negative"), (2.9, "negative", "positive"), (3.0, "neutral", "neutral"),
    (3.9, "neutral", "positive"), (4.0, "positive", "positive"), (None, None, "neutral"),
    (0.0, "negative", "negative"), (7.0, "positive", "positive"), (1e11, "positive", "positive"), (-1e11, "negative", "negative"),
    (float("inf"), "positive", "positive"), (float("-inf"), "negative", "negative"), (float("nan"), None, "positive")])
def test_weak_labels(spark, value, label_train, label_serving):
    assert run(spark, lb.weak_label_train, [value], "double") == [label_train]
    assert run(spark, lb.weak_label_serving, [value], "double") == [label_serving]


def test_coercion(spark):
    assert run(spark, lb.to_rating, ["5", " 3.5", "five", "NaN", "", None]) == [5.0, 3.5, None, None, None, None]
    days = run(spark, lb.to_review_date, ["2026-01-31", "2026/02/01", "2026.02.03", "20260204", "2026-02-05 10:11:12",
                                         "2026-13-01", "soon", None])
    assert [d and d.isoformat() for d in days] == [
        "2026-01-31", "2026-02-01", "2026-02-03", "2026-02-04", "2026-02-05", None, None, None]
    assert run(spark, lb.percent_text, [0.41249, 1.0, None], "double") == ["41.2%", "100.0%", None]


def test_date_formats_of_stores(spark):
    texts = ["2026-01-02 10:11", "2026-01-02T10:11:12Z", "2026-1-2", "2026-01-02", "2026-13-40", "soon"]
    assert [str(x) if x else None for x in run(spark, lb.to_review_date, texts)] == ["2026-01-02"] * 4 + [None, None]
