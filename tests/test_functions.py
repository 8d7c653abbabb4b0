"""Exact values of text, number and policy functions."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from mnemolake.functions import numbers as N
from mnemolake.functions import policy as P
from mnemolake.functions import text as X


def one(spark, c, **columns):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])
    return df.select(c.alias("v")).first().v


def test_terms(spark):
    assert one(spark, X.terms(F.col("t")), t="Straße, foo-bar_1 ½ 中文!") == ["strasse", "foo-bar_1", "½", "中文"]
    assert one(spark, X.terms(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize("text", ["", "a", "hello world", "中文字符 mixed é\t\n", "x" * 100, "日本" * 50 + " ok"])
def test_estimate_tokens(spark, text):
    cjk = sum("一" <= c <= "鿿" for c in text)
    plain = sum(ord(c) < 128 and not c.isspace() for c in text)
    assert one(spark, X.estimate_tokens(F.col("t")), t=text) == max(1, math.ceil(round(cjk / 1.8 + plain / 4 + (len(text) - cjk - plain) / 3, 9)))


def test_substring_markers(spark):
    assert one(spark, X.contains_any(F.col("t"), X.TEMPORAL_WORDS), t="I know") is True  # 'now' within 'know'
    assert one(spark, X.contains_any(F.col("t"), X.UPDATE_WORDS, pad=True), t="I know") is False
    assert one(spark, X.contains_any(F.col("t"), X.UPDATE_WORDS, pad=True), t="now") is True
    assert one(spark, X.contains_any(F.lit(None).cast("string"), X.UPDATE_WORDS)) is False


def test_answers(spark):
    assert one(spark, X.normalize_answer(F.col("t")), t="The  cat, don’t 不知") == "cat do not 不 知"
    for text, says in (("I don't know.", True), ("Unknown", True), ("无法回答", False), ("nothing", False)):
        assert one(spark, X.is_abstention_answer(F.col("t")), t=text) is says
    f1 = X.token_f1(X.answer_tokens(F.col("a")), X.answer_tokens(F.col("b")))
    assert one(spark, f1, a="red red blue", b="red green") == pytest.approx(2 * (1 / 3) * (1 / 2) / (1 / 3 + 1 / 2))
    assert one(spark, X.contains_sequence(X.answer_tokens(F.col("a")), X.answer_tokens(F.col("b"))), a="it is 12 rows", b="12 rows") == 1.0
    assert one(spark, X.contains_sequence(X.answer_tokens(F.col("a")), X.answer_tokens(F.col("b"))), a="it is 112 rows", b="12 rows") == 0.0


def test_merging(spark):
    texts = F.array(F.lit("a b\n\nc"), F.lit("c\n\n a  b \n\nd"), F.lit(None))
    assert one(spark, X.merge_paragraphs(texts)) == "a b\n\nc\n\nd"
    assert one(spark, X.merge_summaries(F.array(F.lit("x"), F.lit(""), F.lit("x"), F.lit("y")))) == "x; y"
    assert one(spark, X.merge_summaries(F.array().cast("array<string>"))) == "Merged memory"


def test_names(spark):
    assert one(spark, X.safe_id(F.col("t")), t="__a b/c__") == "a_b_c"
    assert one(spark, X.safe_id(F.col("t")), t="!!") == "unknown"
    assert one(spark, X.truncate(F.col("t"), 5), t="abc  fgh") == "abc…"
    with_ = X.with_provenance(F.lit("body"), F.lit("s1"), F.lit("2025-01-01"))
    assert one(spark, X.provenance_session(with_)) == "s1" and one(spark, X.strip_provenance(with_)) == "body"


def test_privacy(spark):
    for text, risk in (("mail me a.b@c.org", 0.6), ("call +1 (555) 123-4567", 0.65), ("my API_KEY is", 0.9), ("我的手机号", 0.75), ("nothing", 0.0)):
        assert one(spark, X.privacy_risk(F.col("t")), t=text) == risk


def test_privacy_of_any_script(spark, tmp_path):
    """Every document with a text comes out, with the risk that the patterns have in Python."""
    import re

    from mnemolake.plans import all_queries

    texts = [
        "josé.müller@exämple.org", "写信给a.b@c.org吧", "写信给 a.b@c.org。", "Anruf – +49 (30) 1234567", "电话 ٠١٢٣٤٥٦٧٨٩", "电话１２３４５６７８９０", "555\u00a0123\u20094567", "²5551234567", "密码password是", "密码：password。", "“Token” → x", "clé paſſword",
        "API\u2013KEY", "api_KEY …", "请填身份证", "我的手机号 a@b.cd", "银行卡 token", "über nichts", "plain", "secret", "", "e\u0301secret", "secret\u0301", "a@b.cdé", "\n555 1234 567\n", None,
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = lambda t: max(0.6 * bool(re.search(X.EMAIL, t)), 0.65 * bool(re.search(X.PHONE, t)), 0.9 * bool(re.search(X.SECRET, t)), 0.75 * any(w in t for w in X.PRIVATE_WORDS))
    want = {i: found(t) for i, t in enumerate(texts) if t is not None}
    assert {r.doc_id: r.risk for r in all_queries()[0]["privacy_risk_all"](spark, str(tmp_path)).collect()} == want and set(want.values()) == {0.0, 0.6, 0.65, 0.75, 0.9}


def test_numbers(spark):
    assert one(spark, N.clamp01(F.lit(float("nan")))) == 0.0 and one(spark, N.clamp01(F.lit(2.0))) == 1.0
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    assert one(spark, N.cosine(v(1, 0), v(1, 1))) == pytest.approx(2**-0.5)
    assert one(spark, N.cosine(v(1, 0), v(-1, 0))) == 0.0 and one(spark, N.cosine(v(1), v(1, 1))) == 0.0 and one(spark, N.cosine(v(0, 0), v(1, 1))) == 0.0
    assert one(spark, N.softmax(v(0, 0))) == [0.5, 0.5]
    assert one(spark, N.access_frequency(F.lit(20))) == 1.0 and one(spark, N.access_frequency(F.lit(0))) == 0.0


@pytest.mark.parametrize(
    "text,want",
    [("2025/02/23 (Sun) 14:28", (2025, 2, 23, 14, 28)), ("2025-03-26", (2025, 3, 26, 0, 0)), ("2025-01-01T10:00:00Z", (2025, 1, 1, 10, 0)), ("2025-01-01T10:00:00+02:00", (2025, 1, 1, 8, 0)), ("2025-01-01 junk", (2025, 1, 1, 0, 0)), ("14.11.2025", None), ("", None), ("2025/02/23", None), ("2025-13-01", None)],
)
def test_dates(spark, text, want):
    got = one(spark, F.date_format(N.parse_date(F.col("t")), "yyyy-MM-dd HH:mm"), t=text)
    assert got == (None if want is None else dt.datetime(*want).strftime("%Y-%m-%d %H:%M"))


def test_recency(spark):
    a, b = F.lit("2025-01-01").cast("timestamp"), F.lit("2025-01-31").cast("timestamp")
    assert one(spark, N.recency(a, b)) == 0.5 and one(spark, N.recency(b, a)) == 1.0 and one(spark, N.recency(F.lit(None).cast("timestamp"), a)) == 0.5
    assert one(spark, N.half_life(a, b, 30)) == 0.5
    assert one(spark, N.episodic_recency(a, b)) == pytest.approx(0.5 ** (30 / 14))


BASE = {"importance": 0.9, "novelty": 0.8, "confidence": 0.85, "actionability": 0.7, "scope_match": 1.0, "redundancy": 0.1, "privacy_risk": 0.0}


@pytest.mark.parametrize(
    "name,f,score,op",
    [
        ("write", BASE, 0.825, "ADD"),
        ("write", {"importance": 0.2, "novelty": 0.1, "confidence": 0.5, "actionability": 0.1, "scope_match": 0.5, "redundancy": 0.8, "privacy_risk": 0.2}, 0.07, "IGNORE"),
        ("retrieve", {"semantic_relevance": 0.9, "importance": 0.8, "scope_match": 0.9, "confidence": 0.8, "success_contribution": 0.6, "recency": 0.7, "contradiction": 0.1, "redundancy": 0.2, "token_cost": 0.1}, 0.745, "RETRIEVE"),
        ("update", {"contradiction": 0.6, "recency": 1.0, "confidence": 0.9, "similarity": 0.8, "source_priority": 0.8}, 0.785, "UPDATE"),
        ("update", {"contradiction": 0.2, "recency": 1.0, "confidence": 0.9, "similarity": 0.8, "source_priority": 0.8}, 0.665, "IGNORE"),
    ],
)
def test_scores(spark, name, f, score, op):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in f.items()]).select(P.score(name).alias("s"), P.decision(name).alias("d")).first()
    assert row.s == pytest.approx(score) and row.d == op


def test_scope_match(spark):
    for a, b, want in (("global", None, 0.5), ("x", None, 0.7), ("a/b", "a/b", 1.0), ("global", "x", 0.65), ("a/b", "a", 0.85), ("a-b", "c", 0.25)):
        assert one(spark, P.scope_match(F.lit(a), F.lit(b).cast("string"))) == pytest.approx(want)
