from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.operators import sessions
from parley.streaming.sessions import streaming_sessions, upsert_stream

T0 = datetime(2026, 8, 18, 9)
SCHEMA = "id long, manager string, customer string, from_customer boolean, content string, msg_time timestamp"


def messages(spark, rows):
    return spark.createDataFrame([(i, "m", "c", who, "x", t) for i, (t, who) in enumerate(rows)], SCHEMA)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 300)), min_size=1, max_size=25))
def test_sessionize_like_a_loop(spark, rows):
    data = [(i, k, T0 + timedelta(minutes=m)) for i, (k, m) in enumerate(rows)]
    got = {r.id: r.session_seq for r in sessions.sessionize(spark.createDataFrame(data, "id long, k string, msg_time timestamp"), ["k"]).collect()}
    last, seq = {}, {}
    for i, k, t in sorted(data, key=lambda x: (x[2], x[0])):
        if k not in last:
            seq[k] = 0
        elif t - last[k] > timedelta(minutes=30):
            seq[k] += 1
        last[k] = t
        assert got[i] == seq[k]


def test_session_rows(spark):
    rows = spark.createDataFrame([(2, "m:1", "c", T0 + timedelta(minutes=30), "电话13812345678"), (1, "m:1", "c", T0, "你好"), (3, "m:1", "c", T0 + timedelta(minutes=61), "b")], "id long, staff string, customer string, msg_time timestamp, content string")
    out = sessions.aggregate_sessions(sessions.sessionize(rows, ["staff", "customer"]), ["staff", "customer"]).orderBy("session_seq").collect()
    assert [(r.session_id, r.msg_count, r.text) for r in out] == [("m:1:c:0", 2, "你好 电话[手机号]"), ("m:1:c:1", 1, "b")]


def test_keep_filter(spark):
    rows = spark.createDataFrame([(1, "text", " 谢谢您的帮助 "), (2, "text", "四个字符"), (3, "image", "long enough"), (4, "text", "long enough")], "id long, msg_type string, content string")
    chit = spark.createDataFrame([("谢谢您的帮助",)], "word string")
    assert [r.id for r in sessions.keep_messages(rows, chit).collect()] == [4]
    assert sorted(r.id for r in sessions.keep_messages(rows).collect()) == [1, 4]


def test_pairs(spark):
    log = spark.createDataFrame([(1, "wm1", "s1", None, T0), (2, "s1", "wo2", "a", T0), (3, "s1", "s2", "a", T0), (4, "wm1", "wo2", "a", T0), (5, "WM1", "s1", "a", T0)], "id long, from_user string, to_user string, content string, msg_time timestamp")
    got = {(r.id, r.manager, r.customer, r.from_customer, r.content) for r in sessions.pair_messages(log).collect()}
    assert got == {(1, "s1", "wm1", True, ""), (2, "s1", "wo2", False, "a")}


def test_day_stats_gap_and_midnight(spark):
    day = sessions.day_stats(messages(spark, [(T0, True), (T0 + timedelta(minutes=30), False), (T0 + timedelta(minutes=61), False)])).first()
    assert (day.session_count, day.customer_initiated, day.msg_count, day.customer_msg_count, day.manager_msg_count) == (2, 1, 3, 1, 2)
    late = datetime(2026, 8, 18, 23, 50)
    days = {str(r.stat_date): r for r in sessions.day_stats(messages(spark, [(late, True), (late + timedelta(minutes=20), True)])).collect()}
    assert (days["2026-08-18"].session_count, days["2026-08-19"].session_count, days["2026-08-19"].customer_initiated) == (1, 0, 0)


def test_fingerprint_follows_content(spark):
    a = sessions.day_stats(messages(spark, [(T0, True)])).first().source_fp
    b = sessions.day_stats(messages(spark, [(T0, False)])).first().source_fp
    assert a != b and a == sessions.day_stats(messages(spark, [(T0, True)])).first().source_fp


def test_window_bounds(spark):
    days = sessions.day_stats(messages(spark, [(T0, True), (T0 - timedelta(days=29), True), (T0 - timedelta(days=30), True)]))
    row = sessions.window_stats(days, "2026-08-18").first()
    assert (row.active_days, row.session_count, str(row.last_contact)) == (2, 2, "2026-08-18")


def test_trailing_load(spark):
    calls = spark.createDataFrame([("k", T0 + timedelta(seconds=s), 400) for s in (0, 0.5, 1, 2)], "k string, ts timestamp, tokens long")
    got = sorted((r.ts, r.calls_in_window, r.weight_in_window) for r in sessions.trailing_load(calls, ["k"], "ts", F.col("tokens"), 1, 2).collect())
    assert [x[1:] for x in got] == [(1, 400), (2, 800), (3, 1200), (2, 1600)]


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("id"), F.col("user_id"), F.col("ts").cast("timestamp").alias("msg_time"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    end = spark.createDataFrame([(-1, -1, datetime(2030, 1, 1))], events.schema)
    events.union(end).repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    upsert_stream(streaming_sessions(stream, ["user_id"]), lambda batch, i: batch.write.mode("append").parquet(out), str(tmp_path / "cp"))
    got = {(r.user_id, r.started, r.ended, r.msg_count) for r in spark.read.parquet(out).collect()}
    batch = sessions.aggregate_sessions(sessions.sessionize(events, ["user_id"]), ["user_id"], content=None)
    assert got == {(r.user_id, r.started, r.ended, r.msg_count) for r in batch.collect()}
