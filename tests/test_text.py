"""Goldens from the survey plus a property check against a
plain-Python statement of the cleaning rule."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lensmap.functions import text as TX

GOLDENS = [
    ("这车比同级别贵两万，不划算。", "这车比同级别贵两万不划算"),
    ("  a - b　\tc!!!??  ", "a  b c!?"),
    ("it's \"ok\" 100%；；😀🤣", "its \"ok\" 100；😀"),
    ("—。—", ""),
    (None, ""),
    ("", ""),
    ("（括号）【方】", "（括号）【方】"),
    ("a\x1cb\x85c d", "a b c d"),
    ("..,,!!??；；：：", ".,!?；："),
    ("🇨🇳 flag 🚀", "🇨🇳 flag 🚀"),
]


def _clean(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(TX.clean_text("t")).collect()]


def test_clean_text_goldens(spark):
    assert _clean(spark, [g[0] for g in GOLDENS]) == [g[1] for g in GOLDENS]


def _keep(ch: str) -> bool:
    cp = ord(ch)
    return (ch.isalnum() or ch == "_" or 0x4E00 <= cp <= 0x9FFF or ch in '.,!?；："（）【】'
            or ch.isspace() or 0x1F600 <= cp <= 0x1F64F or 0x1F300 <= cp <= 0x1F5FF
            or 0x1F680 <= cp <= 0x1F6FF or 0x1F1E0 <= cp <= 0x1F1FF)


def spec_clean(t):
    """The rule as stated in the survey, in plain Python."""
    if not t:
        return ""
    t = re.sub(r"\s+", " ", t.strip())
    t = "".join(ch for ch in t if _keep(ch))
    t = re.sub(r"([,.!?；：])\1+", r"\1", t)
    return t.strip()


ALPHABET = st.sampled_from(list("abcXYZ019_ éüßñ,.!?；：，。！？、'\"-/%@#:（）【】\t\n　\x1c\x85")
                           + ["这", "车", "😀", "🤣", "🚀", "🇨", "—", " ", " "])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=1, max_size=20))
def test_clean_text_matches_spec(spark, texts):
    assert _clean(spark, texts) == [spec_clean(t) for t in texts]


def test_clean_text_output_properties(spark):
    out = _clean(spark, ["!!! a,,b ..  c??", "x；；；y", " , , "])
    for o in out:
        assert not re.search(r"([,.!?；：])\1", o)
        assert o == o.strip()


def _one(spark, col, schema, row):
    return spark.createDataFrame([row], schema).select(col.alias("x")).first()[0]


KS = "a string, i string, s string, d string, ex array<string>, kw array<string>"


def _ktext(spark, row, **kw):
    return _one(spark, TX.knowledge_text("a", "i", "s", "d", "ex", "kw", **kw), KS, row)


def test_knowledge_text_parts_and_order(spark):
    row = ("价格", "太贵了。", "negative", "描述", ["例1!!", "", "例2", "例4"], ["k1", "", "k2"])
    assert _ktext(spark, row) == ("维度：价格 | 观点：太贵了 | 情感：negative | 描述：描述 | "
                                  "例子：例1! | 例2 | 关键词：k1 k2")


def test_knowledge_text_examples_slice_then_filter(spark):
    # the 4th example is not used even though the 2nd is empty
    row = (None, None, None, None, ["e1", "", "e3", "e4"], None)
    assert _ktext(spark, row) == "例子：e1 | e3"
    # an example that cleans to empty stays in the join
    row = (None, None, None, None, ["—", "e2"], None)
    assert _ktext(spark, row) == "例子： | e2"


def test_knowledge_text_fallbacks(spark):
    # insight cleans to empty: fall back to the raw insight
    assert _ktext(spark, (None, "—。—", None, None, None, None)) == "—。—"
    # nothing present at all
    assert _ktext(spark, (None, None, None, None, None, None),
                  insight_present=F.lit(False), aspect_present=F.lit(False)) == "未知内容"
    # insight missing, aspect present
    assert _ktext(spark, ("—", None, None, None, None, None),
                  insight_present=F.lit(False), aspect_present=F.lit(True)) == "—"


@pytest.mark.parametrize("raw,summary,expected", [
    ("", None, "空内容"),
    ("—。—", "摘要", "空内容"),
    ("贵了！", None, "用户反馈：贵了"),
    ("贵了", "价格贵", "摘要：价格贵 | 原文：贵了"),
    ("贵了", "。。", "用户反馈：贵了"),
])
def test_feedback_text(spark, raw, summary, expected):
    assert _one(spark, TX.feedback_text("r", "s"), "r string, s string", (raw, summary)) == expected
    df = spark.createDataFrame([(raw, summary)], "r string, s string")
    assert TX.with_feedback_text(df, "r", "s").first()["text_for_embedding"] == expected


def test_with_knowledge_text_equals_column_form(spark):
    rows = [("价格", "太贵了。", "negative", None, ["例1!!", "", "例2"], ["k"]),
            (None, "—。—", None, None, None, None), ("a", None, None, "d", [], [])]
    df = spark.createDataFrame(rows, KS)
    a = [r[0] for r in df.select(TX.knowledge_text("a", "i", "s", "d", "ex", "kw")).collect()]
    b = [r[0] for r in TX.with_knowledge_text(df, "a", "i", "s", "d", "ex", "kw")
         .select("text_for_embedding").collect()]
    assert a == b


def test_query_text_not_cleaned(spark):
    df = spark.createDataFrame([("价格，贵！",)], "q string")
    assert df.select(TX.query_text("q", "knowledge")).first()[0] == "查询: 价格，贵！"
    assert df.select(TX.query_text("q", "feedback")).first()[0] == "用户反馈: 价格，贵！"


def test_hash_and_length(spark):
    t = "维😀é"
    df = spark.createDataFrame([(t,)], "t string")
    r = df.select(TX.text_hash("t"), TX.text_length("t"), TX.is_blank("t")).first()
    assert r[0] == hashlib.md5(t.encode("utf-8")).hexdigest()
    assert r[1] == 3 and r[2] is False


def test_is_blank(spark):
    vals = [None, "", " \t\n　\x1c", " a ", "​"]
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    got = [r[0] for r in df.select(TX.is_blank("t")).collect()]
    assert got == [(v is None) or (not v.strip()) for v in vals]
