"""Words by dictionary, intents, models that fail, summary lists and what may be used again."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.functions.hashing import config_fingerprint
from parley.functions.segment import Dictionary, segmented
from parley.functions.text import business_tokens
from parley.operators import ml, sessions, topics
from parley.plans import contacts, intents
from parley.plans.providers import Asked, Busy, Denied, SlidingWindow, Unavailable, checked_vectors
from parley.settings import Settings
from parley.sources.tables import Store


def test_words_of_a_dictionary(spark):
    words = {"定期": 30, "存款": 50, "定期存款": 20, "利率": 40, "多少": 60, "款利": 1}
    d = Dictionary(words)
    assert d.cut("定期存款利率多少") == ["定期存款", "利率", "多少"] and d.cut("我问利率") == ["我", "问", "利率"]
    assert d.words("APP里的 定期，存款 2024") == ["app", "里", "的", "定期", "存款", "2024"] and d.words(None) == [] and Dictionary([]).words("好 ok") == ["好", "ok"]

    def cuts(run):  # every way to cut
        return [[]] if not run else [[run[:k], *rest] for k in range(1, len(run) + 1) if k == 1 or run[:k] in words for rest in cuts(run[k:])]

    def cost(ws):
        return sum(d.cost.get(w, d.unknown) for w in ws)

    for run in ("定期存款利率", "存款利率多少款", "期存定期款利率"):
        assert cost(d.cut(run)) == pytest.approx(min(map(cost, cuts(run))))
    rows = spark.createDataFrame([(1, "定期存款利率是多少 abc"), (2, None)], "id int, text string")
    got = {r.id: r.w for r in rows.select("id", business_tokens(segmented(F.col("text"), words)).alias("w")).collect()}
    assert got == {1: ["定期存款", "利率", "多少"], 2: []}


def limiter(waits):
    now = [0.0]

    def sleep(seconds):
        waits.append(seconds)
        now[0] += seconds

    return SlidingWindow(1000, 60, 10**9, 60, lambda: now[0], sleep)


def test_a_model_is_asked_again_by_rule():
    waits, seen = [], []
    script = [Busy(7), ("x", 5, True), ("no json", 5, False), ("{}", 5, False)]

    def call(prompt, room):
        seen.append((prompt, room))
        step = script.pop(0)
        if isinstance(step, Exception):
            raise step
        return step

    model = Asked(call, limiter(waits), lambda t: None if t.startswith("{") else "no JSON", attempts=4, room=100)
    assert model(["p"]) == ["{}"] and waits == [7] and [r for _, r in seen] == [100, 100, 200, 200] and "no JSON" in seen[3][0]
    assert model.log[0]["status"] == "ok" and (model.log[0]["attempts"], model.log[0]["tokens"]) == (4, 15)
    script += [Unavailable("off"), Unavailable("off"), Unavailable("off"), Unavailable("off"), Denied("401")]
    assert model(["a", "b", "c"]) == [None, None, None] and not script and waits[1:] == [2, 4, 8, 16]
    assert [r["status"] for r in model.log[1:]] == ["failed", "denied", "failed"] and model.log[3]["error"] == "401"


def test_vectors_are_checked():
    assert checked_vectors(np.ones((2, 3)), ["a", "b"]).dtype == np.float32
    for bad in (np.ones((1, 3)), np.full((2, 3), np.nan)):
        with pytest.raises(ValueError, match="embedded"):
            checked_vectors(bad, ["a", "b"])


def test_intents_from_a_model_and_without(spark):
    rows = [(t, t * 10 + m, f"{t}-{m}-{i}", f"text {i}", [float(i % 3), 1.0]) for t, m, n in ((1, 0, 30), (1, 1, 2), (2, 0, 3)) for i in range(n)]
    texts = intents.pool(spark.createDataFrame(rows, "topic_id int, member int, session_id string, text string, vector array<double>"), Settings(pool_size=8))
    assert {r.topic_id: r["count"] for r in texts.groupBy("topic_id").count().collect()} == {1: 8, 2: 3}
    board = spark.createDataFrame([(1, ["存款", "利率", "基金", "x"]), (2, []), (3, None)], "topic_id int, words array<string>")
    plain = {r.topic_id: r for r in intents.described(board, texts, None).collect()}
    assert plain[1].customer_intent == "客户关注存款、利率、基金" and plain[3].customer_intent == "客户关注相关业务" and plain[3].representative == []

    def answer(prompts):
        return ["so " + json.dumps({"intent": " ask ", "business_words": ["利率", "made up"]}) if "利率" in p else "nothing" for p in prompts]

    got = {r.topic_id: r for r in intents.described(board, texts, answer).collect()}
    assert (got[1].customer_intent, got[1].business_words) == ("ask", ["利率"]) and 1 <= len(got[1].representative) <= 5
    assert got[2].customer_intent == "客户关注相关业务" and got[2].business_words == []


def test_gates_make_noise(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.05, (20, 3)) for c in ([0, 0, 0], [5, 0, 0])] + [[[2.5, 9.0, 0.0]]])
    rows = spark.createDataFrame([(str(i), v.tolist(), 1) for i, v in enumerate(x)], "session_id string, vector array<double>, msg_count long")
    out = ml.cluster_topics(rows, s=Settings(clusters=2, pca_components=3, max_distance=2.0))
    noise = [r.session_id for r in out.where("topic_id = -1").collect()]
    assert noise == ["40"] and topics.without_noise(out).count() == 40
    assert ml.cluster_topics(rows, s=Settings(clusters=2, pca_components=3)).where("topic_id = -1").count() == 0


def test_sessions_are_carried_over_from_stored_days(spark):
    def at(text):
        return F.to_timestamp(F.lit(text))

    rows = spark.range(2).select("id", F.lit("m").alias("manager"), F.lit("c").alias("customer"), (F.col("id") == 0).alias("from_customer"), F.lit("x").alias("content"), F.when(F.col("id") == 0, at("2024-01-02 00:10:00")).otherwise(at("2024-01-02 09:00:00")).alias("msg_time"))
    stored = spark.range(1).select(F.lit("m").alias("manager"), F.lit("c").alias("customer"), at("2024-01-01 23:55:00").alias("last_msg_time"))
    alone, carried = sessions.day_stats(rows).first(), sessions.day_stats(rows, before=stored).first()
    assert (alone.session_count, alone.customer_initiated) == (2, 1) and (carried.session_count, carried.customer_initiated) == (1, 0)


def test_summaries_by_signal(spark):
    rows = [("m", "a", 3, "2024-01-03", [("S1", "open")], "success"), ("m", "b", 9, "2024-01-01", [("S1", "closed")], "review"), ("m", "c", 5, "2024-01-05", None, "success")]
    summaries = spark.createDataFrame(rows, "manager string, customer string, session_count long, last_contact string, signals array<struct<code:string,status:string>>, status string")

    def order(**options):
        return [r.customer for r in contacts.summary_list(summaries, **options).collect()]

    assert order() == ["c", "a", "b"] and order(order="session_count") == ["b", "c", "a"] and order(order="signal_change") == ["b", "c", "a"]
    assert order(signal="S1") == ["a", "b"] and order(signal="S1", signal_status="closed") == ["b"] and order(signal="S2") == []
    assert contacts.summary_detail(summaries, "m", "b").first().status == "review"


def test_what_of_a_day_may_be_used_again(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    a, b = config_fingerprint({"model": "a", "n": 1}), config_fingerprint({"n": 1, "model": "b"})
    assert a == config_fingerprint({"n": 1, "model": "a"}) != b and store.reuse("2024-01-01", a, a) == "nothing"
    row = spark.createDataFrame([("s", "x", "c", 1, "t", "h", [1.0], a)], "session_id string, staff string, customer string, msg_count long, text string, text_hash string, vector array<float>, config_fp string")
    store.replace_day("vectors", row, "2024-01-01")
    store.replace_day("manifests", spark.createDataFrame([(1, a, a, "r")], "records long, embed_fp string, token_fp string, run_id string"), "2024-01-01")
    assert [store.reuse("2024-01-01", *x) for x in ((a, a), (a, b), (b, a))] == ["all", "vectors", "nothing"]
    kept = store.written("answers", row)
    assert kept.count() == 1 and kept.schema == row.schema
