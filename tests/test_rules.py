import pytest

from reviewloom.functions.rules import IssueRules, ReplyPolicy
from reviewloom.functions import text as tx
from reviewloom.operators import issues as iss
from reviewloom.operators import replies as rp

RULES, POLICY = IssueRules(), ReplyPolicy()
SCHEMA = "ingest_seq long, app_name string, rating double, clean_text string"


def classify(spark, rows):
    df = spark.createDataFrame([(i, "앱", r, t) for i, (t, r) in enumerate(rows)], SCHEMA)
    return [(r.issue_types, r.severity) for r in iss.classify(df, RULES).orderBy("ingest_seq").collect()]


def test_issue_types(spark):
    cases = [
        ("아침마다 로 그인 화면", "로그인"), ("공동인증 절차", "인증"), ("버벅거림", "속도"), ("ERROR 코드", "오류"),
        ("쿠폰 주세요", "혜택"), ("자동 이체 설정", "송금"), ("펀드 상품", "투자"), ("글씨 크기", "UX"),
        ("피싱 문자", "보안")]
    out = classify(spark, [(t, 3.0) for t, _ in cases])
    for (text, want), (types, _) in zip(cases, out):
        assert want in types, text
    several, none, empty, null = classify(spark, [
        ("로그인 오류에 송금까지 느려요", 3.0), ("산책하기 딱 맞는 날씨", 3.0), ("", 3.0), (None, 3.0)])
    assert several[0] == ["로그인", "속도", "오류", "송금"]
    assert none[0] == empty[0] == null[0] == ["기타"]


@pytest.mark.parametrize("text,rating,want", [
    ("로그인이 안 됩니다", 5.0, "high"), ("송금 실패 했어요", 3.0, "high"), ("보안이 걱정", 2.0, "high"),
    ("보안이 걱정", None, "medium"), ("정말 편리하고 최고", 5.0, "positive"), ("편리하지만 최악", 5.0, "medium"),
    ("편리한 인증", 5.0, "medium"), ("그저 그래요", 1.0, "medium"), ("어디서 확인하나요", 3.0, "low"),
    ("정말 편리", None, "low")])
def test_severity(spark, text, rating, want):
    assert classify(spark, [(text, rating)])[0][1] == want


def test_matched_keywords(spark):
    df = spark.createDataFrame([(1, "OTP 인증번호 오류")], "ingest_seq long, clean_text string")
    got = {(r.issue_type, r.keyword) for r in iss.matched_keywords(df, RULES).collect()}
    assert got == {("인증", "인증"), ("인증", "인증번호"), ("인증", "otp"), ("오류", "오류")}


def flags(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, reply_draft string")
    return [r.safety_flags for r in rp.with_safety(df, POLICY).orderBy("i").collect()]


def test_safety_flags(spark):
    out = flags(spark, [
        "본인 확인을 위해 인증번호를 보내 주세요", "꼭 빠르게 처리하겠습니다", "환불해 드리겠습니다", "이 상품을 추천해요",
        "수익률은 확실합니다", "불편을 드려 죄송합니다. 고객센터로 문의해 주세요.",
        "비밀번호와 인증번호는 누구와도 공유하지 마세요", None, "꼭 처리"])
    assert "personal_info_request" in out[0]
    assert "definitive_promise" in out[1]
    assert out[2] == ["banned_phrase:환불해드리", "definitive_promise"]
    assert "investment_advice" in out[3] and "investment_advice" in out[4]
    assert out[5] == out[6] == out[7] == []
    assert out[8] == ["definitive_promise"]


def drafts(spark, rows, response=False):
    schema = SCHEMA + (", response string" if response else "")
    df = iss.classify(spark.createDataFrame(rows, schema), RULES)
    out = rp.merge_responses(df, POLICY) if response else rp.rule_drafts(df, POLICY)
    return out.orderBy("ingest_seq").collect()


def test_rule_drafts(spark):
    good, hacked, transfer, plain = drafts(spark, [
        (0, "마이앱", 5.0, "정말 편리하고 만족"), (1, "마이앱", 1.0, "해킹 당한 것 같아요"),
        (2, "마이앱", 4.0, "이체 한도 문의"), (3, "마이앱", 3.0, "어디서 보나요")])
    assert good.reply_type == "thanks_positive" and "마이앱" in good.reply_draft and not good.needs_human_review
    assert good.reason == "[fallback] 룰 기반 생성, 특이사항 없음"
    assert hacked.reply_type == "security_sensitive" and hacked.needs_human_review
    assert hacked.reason == ("[fallback] 정책상 검수 강제: severity=high; issue_types=['보안']; keywords=['해킹'] / "
                             "유형 security_sensitive 기본 검수")
    assert transfer.needs_human_review and transfer.force_flags == ["issue_types=['송금']"]
    assert plain.reply_type == "how_to_guidance" and plain.safety_flags == []


def test_model_responses(spark):
    text = "어디서 보나요"
    ok, wrapped, broken, blank, none, unsafe, asked = drafts(spark, [
        (0, "앱", 3.0, text, '{"reply_draft": " 안내드립니다 ", "reply_type": "thanks_positive"}'),
        (1, "앱", 3.0, text, 'Sure:\n{"reply_draft": "안내드립니다"}\nbye'),
        (2, "앱", 3.0, text, "not json"), (3, "앱", 3.0, text, '{"reply_draft": "  "}'), (4, "앱", 3.0, text, None),
        (5, "앱", 3.0, text, '{"reply_draft": "100% 보상해 드려요"}'),
        (6, "앱", 3.0, text, '{"reply_draft": "네", "needs_human_review": true}')], response=True)
    assert (ok.reply_draft, ok.reply_type, ok.reason) == ("안내드립니다", "thanks_positive", "[llm] 특이사항 없음")
    assert (wrapped.reply_draft, wrapped.reply_type) == ("안내드립니다", "how_to_guidance")
    for r in (broken, blank):
        assert r.reason.startswith("[fallback]") and "LLM 오류" in r.reason and r.reply_draft
    assert none.reason == "[fallback] 룰 기반 생성, 특이사항 없음"
    assert unsafe.needs_human_review and "definitive_promise" in unsafe.safety_flags
    assert asked.needs_human_review and asked.reason == "[llm] LLM 검수 권고"


def test_scores(spark):
    df = spark.createDataFrame([(0, "감사합니다. 확인하겠습니다."), (1, "네"), (2, ""), (3, None)],
                               "ingest_seq long, reply_draft string")
    rows = rp.score_replies(df, POLICY).orderBy("ingest_seq").collect()
    assert [(r.tone_score, r.helpfulness_score, r.safety_score) for r in rows] == [
        (3, 3, 3), (1, 1, 3), (0, 0, 3), (0, 0, 3)]


def test_prompt_fills_every_placeholder(spark):
    df = iss.classify(spark.createDataFrame([(0, "마이앱", 1.0, "해킹 {severity}")], SCHEMA), RULES)
    prompt = rp.reply_prompts(df, POLICY, guidance=" 1588 ").first().prompt
    assert "마이앱" in prompt and "1588" in prompt and "해킹 {severity}" in prompt
    assert POLICY.contact_security in prompt and "{app_name}" not in prompt


def test_draft_lookup_with_a_hot_text(spark):
    reviews = spark.createDataFrame(
        [(i, "앱", 1.0, "같은 글" if i % 3 else f"글 {i}") for i in range(90)], SCHEMA)
    drafts_df = spark.createDataFrame(
        [(5, "같은 글", ["x"], "low"), (2, "같은 글", ["y"], "high")],
        "ingest_seq long, review_text string, issue_types array<string>, severity string")
    for hot_rows in (10, 1000):  # salted and not
        rows = rp.lookup_drafts(reviews, drafts_df, RULES, hot_rows=hot_rows).collect()
        assert len(rows) == 90
        assert {(r.issue_types, r.severity) for r in rows if r.from_draft} == {("y", "high")}
        assert sum(r.from_draft for r in rows) == 60
        assert {r.issue_types for r in rows if not r.from_draft} == {RULES.other}


def test_dictionary_words_are_normalised(spark):
    rules = IssueRules(issue_types={"pay": ["Pay Fail"]}, high_triggers=[], negative_signals=[],
                       positive_signals=[], risky_types=[], complaint_types=[], other="other")
    df = spark.createDataFrame([(0, "a", 3.0, "my PAY  fail again")], SCHEMA)
    assert iss.classify(df, rules).first().issue_types == ["pay"]
    assert tx.normalize_word("Pay Fail") == "payfail"
