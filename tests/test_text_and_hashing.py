import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.functions import hashing, text, vectors


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


def test_masking_order_and_boundaries(spark):
    cases = {
        "身份 11010119900307123X 完": "身份 [身份证] 完",
        "卡6222021234567890123。": "卡[卡号]。",
        "电话13812345678，邮箱 a.b+c@x-y.com": "电话[手机号]，邮箱 [邮箱]",
        "12345678901234567890": "12345678901234567890",  # too long for any
        "１３８１２３４５６７８": "１３８１２３４５６７８",  # full-width digits: 1[3-9] is ASCII
        "x13812345678y 213812345678": "x[手机号]y 213812345678",
        "": "",
    }
    for given_, want in cases.items():
        assert one(spark, given_, text.mask_pii) == want


def test_normal_forms(spark):
    assert one(spark, " 　a  b\n", text.collapse) == "a b"
    assert one(spark, "　a ", text.strip) == "a"
    assert one(spark, "“[他行] 收益-高”", text.evidence_key) == "他行收益高"
    assert one(spark, "客户🙂贷款咨询", lambda c: F.substring(c, 1, 4)) == "客户🙂贷"
    assert one(spark, "abc", lambda c: text.clip_line(c, 2)) == "ab…"
    assert one(spark, "贷款ab", text.estimate_tokens) == 3  # 1.4 + 0.7 rounded up
    assert one(spark, "x {\"a\": {\"b\": 1}} y", text.json_object) == "{\"a\": {\"b\": 1}}"
    assert one(spark, "none", text.json_object) is None
    assert one(spark, "3.5 % 和 20万", text.numbers_in) == ["3.5%", "20万"]
    assert one(spark, "理财 a 的 收益", lambda c: text.business_tokens(text.tokens(c), F.array(F.lit("收益")))) == ["理财"]
    assert one(spark, "2024-08-19", lambda c: text.period_label(F.to_date(c))) == "8月中旬"
    assert text.window_label(30) == "近1个月" and text.window_label(7) == "近7天"


def test_evidence(spark):
    rows = spark.createDataFrame([("“利息 高”", "今天 利息-高吗"), ("", "x"), ("？", "？"), (None, "x")], "e string, s string")
    got = [r.ok for r in rows.select(text.is_evidenced(F.col("e"), F.col("s")).alias("ok")).collect()]
    assert got == [True, False, False, False]


def java(s):
    h = 0
    for c in s:
        h = (31 * h + ord(c)) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(st.characters(min_codepoint=32, max_codepoint=0x9FFF), min_size=0, max_size=12), min_size=1, max_size=6))
def test_java_hash(spark, words):
    rows = spark.createDataFrame([(w,) for w in words], "x string").select("x", hashing.java_hash(F.col("x")).alias("h"), hashing.shard_number(F.col("x")).alias("s")).collect()
    for r in rows:
        assert r.h == java(r.x) and r.s == java(r.x) % 20 + 1


@settings(max_examples=20, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=6), st.lists(st.sampled_from("abcdef"), max_size=6))
def test_jaccard(spark, a, b):
    got = spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(vectors.jaccard(F.col("a"), F.col("b")).alias("j")).first().j
    union = set(a) | set(b)
    assert abs(got - (len(set(a) & set(b)) / len(union) if union else 0)) < 1e-12


def test_cosine_of_zero(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [round(r.c, 6) for r in rows.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == [1.0, 0.707107]


def test_patterns_are_as_fixed():
    assert re.search(text.EMAIL, "a@b.co")


def test_shorter_patterns_find_the_same(spark):
    space = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
    pieces = [" ", "  ", "\t", "\u3000", "\xa0 ", "\r\n", "\u2009\u2009", "a", "b_", "1", "12.5", "1.2.3", ".", "99 ", "5\n", "%", "万", "元x", "1234567890123", "１", "\x1c", "🙂"]
    rng = np.random.default_rng(5)
    cases = sorted({"".join(rng.choice(pieces, rng.integers(1, 9))) for _ in range(2000)})
    rows = spark.createDataFrame([(c,) for c in cases], "x string").select("x", text.collapse(F.col("x")).alias("c"), text.numbers_in(F.col("x")).alias("n")).collect()
    quantity = re.compile("[0-9]+(?:\\.[0-9]+)?[\t-\r ]*(?:%|％|万|元|亿)")
    for r in rows:
        assert r.c == re.sub(space, " ", r.x).strip(" ")
        assert r.n == [re.sub(space, "", q) for q in quantity.findall(r.x)]
