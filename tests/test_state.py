"""Stateful streams against the batch operators: any order of micro-batches, failures between them, and state that goes."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.operators import contacts, sessions
from parley.streaming import state

KEYS = ["staff", "customer"]


def messages(spark, n=400, seed=1, days=4):
    rng = np.random.default_rng(seed)
    rows = [(i, f"m{rng.integers(3)}" if rng.random() > 0.05 else None, int(rng.integers(5)), int(rng.integers(days * 24 * 12)) * 300) for i in range(n)]  # steps of five minutes: gaps of exactly half an hour
    rows += rows[:20]  # repeated rows are messages too
    df = spark.createDataFrame(rows, "id long, staff string, customer long, at long")
    return df.select("id", "staff", "customer", F.timestamp_seconds(F.col("at") + 1_700_000_000).alias("msg_time"))


def batch_sessions(rows):
    out = sessions.aggregate_sessions(sessions.sessionize(rows, KEYS), KEYS, content=None)
    return sorted(map(str, out.select(*KEYS, "session_seq", "msg_count", "started", "ended", "session_id").collect()))


def streamed(changes):
    return sorted(map(str, state.current_sessions(changes, KEYS).collect()))


def test_shuffled_batches_end_in_the_batch_rows(spark):
    """Rows of all days in every batch; the watermark waits for all of them."""
    rows = messages(spark)
    changes = state.replayed(rows, F.col("id") % 3, 3, lambda x: state.session_changes(x, KEYS, watermark="10 days"))
    assert streamed(changes) == batch_sessions(rows)


def test_sessions_close_behind_the_watermark_and_keep_their_numbers(spark):
    """In order of time, a day a batch with half an hour of disorder: the state holds open sessions only."""
    rows = messages(spark, 600, 2, 6)
    day = F.floor((F.unix_timestamp("msg_time") - 1_700_000_000 + F.pmod(F.xxhash64("id"), F.lit(1800))) / 86_400).cast("int")
    seen = []

    def changes_of(stream):
        seen.append(stream)
        return state.session_changes(stream, KEYS, watermark="1 hour")

    changes = state.replayed(rows, F.least(day, F.lit(5)), 6, changes_of).persist()
    assert streamed(changes) == batch_sessions(rows) and len(seen) == 6
    last = changes.where(F.col("batch") == changes.agg(F.max("batch")).first()[0])
    assert last.agg(F.max("base")).first()[0] > 5 and last.count() < len(streamed(changes)) / 2  # earlier ones are only counted


def test_a_failure_between_writing_and_committing_changes_nothing(spark, tmp_path):
    rows = messages(spark, 300, 3)
    folder = f"file://{tmp_path}"
    for k in range(3):
        rows.where(F.col("id") % 3 == k).write.mode("append").parquet(f"{folder}/in")
        stream = state.session_changes(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), KEYS, watermark="10 days")
        if k == 1:
            with pytest.raises(Exception, match="stopped after batch"):
                state.append_changes(stream, f"{folder}/out", f"{folder}/checkpoint", lambda n: True)
            assert state.changes_at(stream, f"{folder}/out").count() > 0
            stream = state.session_changes(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), KEYS, watermark="10 days")
        state.append_changes(stream, f"{folder}/out", f"{folder}/checkpoint")
    assert streamed(state.changes_at(stream, f"{folder}/out")) == batch_sessions(rows)


def test_a_silent_key_is_forgotten_and_its_sessions_stay(spark):
    rows = spark.createDataFrame([("m", 1, 0), ("m", 1, 600), ("m", 2, 0), ("m", 2, 40 * 86_400), ("m", 2, 41 * 86_400), ("m", 1, 42 * 86_400)], "staff string, customer long, at long")
    part = F.when(F.col("at") < 1000, 0).when(F.col("at") < 41 * 86_400, 1).when(F.col("at") < 42 * 86_400, 2).otherwise(3)
    rows = rows.select("staff", "customer", F.timestamp_seconds(F.col("at") + 1_700_000_000).alias("msg_time"), part.alias("part"))
    changes = state.replayed(rows, F.col("part"), 4, lambda x: state.session_changes(x, KEYS, watermark="1 hour", ttl_days=30)).persist()
    got = sorted((r.customer, r.session_seq, r.msg_count) for r in state.current_sessions(changes, KEYS).collect())
    assert got == [(1, 0, 1), (1, 0, 2), (2, 0, 1), (2, 1, 1), (2, 2, 1)]
    assert changes.where("customer = 1").select("generation").distinct().count() == 2


piece = st.tuples(st.integers(0, 40), st.integers(0, 6), st.integers(1, 3))


@settings(max_examples=200, deadline=None)
@given(st.lists(piece, min_size=1, max_size=12), st.integers(0, 5))
def test_merged_pieces_like_messages(pieces, gap):
    start, length, count = (np.array(x) for x in zip(*pieces, strict=True))
    got = [x.tolist() for x in state.merged_sessions(start, start + length, count, gap)]
    want, reach = [], None
    for s, e, n in sorted((s, s + m, n) for s, m, n in pieces):
        if reach is None or s - reach > gap:
            want.append([s, e, n])
        else:
            want[-1][1:] = [max(want[-1][1], e), want[-1][2] + n]
        reach = max(e, reach) if reach is not None else e
    assert list(zip(*got, strict=True)) == [tuple(w) for w in want]


def signals(spark, seed=1, n=500):
    rng = np.random.default_rng(seed)
    rows = [(f"m{rng.integers(2)}", int(rng.integers(4)), i, str(rng.choice(["A", "B", "C"])), str(rng.choice(["open", "closed", "odd"], p=[0.6, 0.35, 0.05])), int(rng.integers(30))) for i in range(n)]
    df = spark.createDataFrame(rows, "manager string, customer long, event_id long, code string, status string, day int")
    return df.withColumn("event_date", F.date_add(F.lit("2024-03-01").cast("date"), F.col("day"))).drop("day")


def test_open_signals_of_shuffled_batches(spark):
    rows = signals(spark)
    changes = state.replayed(rows, F.col("event_id") % 3, 3, lambda x: state.signal_changes(x, ["manager", "customer"], watermark="40 days"))
    want = contacts.open_signals(rows)
    assert sorted(map(str, state.current_signals(changes, ["manager", "customer"]).collect())) == sorted(map(str, want.select("manager", "customer", "code", "since").collect())) != []


def test_signals_opened_before_the_look_back_are_not_open(spark):
    rows = [("m", 1, 1, "A", "open", 0), ("m", 1, 2, "B", "open", 50), ("m", 2, 3, "A", "open", 0), ("m", 2, 4, "A", "open", 60), ("m", 3, 5, "A", "open", 95), ("m", 3, 6, "C", "closed", 96), ("m", 4, 7, "A", "open", 125)]
    rows = spark.createDataFrame([(*r, min(r[5] // 40, 3)) for r in rows], "manager string, customer long, event_id long, code string, status string, day int, part int")
    rows = rows.withColumn("event_date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")))
    changes = state.replayed(rows, F.col("part"), 4, lambda x: state.signal_changes(x, ["manager", "customer"], watermark="1 day"))
    got = {(r.customer, r.code, str(r.since)) for r in state.current_signals(changes, ["manager", "customer"]).collect()}
    late = contacts.open_signals(rows, F.lit("2024-05-05").cast("date") - F.expr("INTERVAL 1 DAY"))
    want = {(r.customer, r.code, str(r.since)) for r in late.collect()}
    assert want <= got | {(4, "A", "2024-05-05")} and (1, "A", "2024-01-01") not in got and (2, "A", "2024-03-01") in got


def entries(spark, path):
    """Entries of the state after a stream's last batch."""
    return spark.read.format("statestore").load(f"file://{path}/checkpoint").count()


def test_many_keys_share_entries_of_the_state(spark, tmp_path):
    """An entry a key took a call of Python each; null keys, and numbers that no double holds, stay apart in a bucket."""
    number = F.when(F.col("id") % 50 == 0, None).otherwise(F.lit((1 << 53) + 1) + F.col("id") % 999)
    rows = spark.range(3000).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("m"), F.col("id") % 2)).alias("staff"), number.alias("customer"), F.timestamp_seconds(F.col("id") * 311 % 40_000 + 1_700_000_000).alias("msg_time"))
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = state.session_changes(spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in"), KEYS)
    state.append_changes(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint", partitions=4)
    assert streamed(state.changes_at(stream, f"file://{tmp_path}/out")) == batch_sessions(rows)
    assert 0 < entries(spark, tmp_path) <= state.BUCKETS < rows.select(*KEYS).distinct().count()


def test_many_signals_share_entries_of_the_state(spark, tmp_path):
    rows = spark.range(3000).select(F.lit(None).cast("string").alias("manager"), (F.lit((1 << 53) + 1) + F.col("id") % 999).alias("customer"), F.col("id").alias("event_id"), F.concat(F.lit("C"), F.col("id") % 2).alias("code"))
    rows = rows.select("*", F.when(F.xxhash64("event_id") % 3 == 0, "closed").otherwise("open").alias("status"), F.expr("date_add(DATE'2024-03-01', CAST(event_id % 11 AS INT))").alias("event_date"))
    rows.write.parquet(f"file://{tmp_path}/in")
    keys = ["manager", "customer"]
    stream = state.signal_changes(spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in"), keys, "20 days")
    state.append_changes(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint", partitions=4)
    got = {(r.customer, r.code, str(r.since)) for r in state.current_signals(state.changes_at(stream, f"file://{tmp_path}/out"), keys).collect()}
    want = contacts.open_signals(rows.fillna("-", ["manager"])).select("customer", "code", "since").collect()
    assert got == {(r.customer, r.code, str(r.since)) for r in want} and len(got) > 900
    assert 0 < entries(spark, tmp_path) <= state.BUCKETS


def test_a_replay_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def noted(n):
        seen.add(1)
        return n

    rows = messages(spark, 60).withColumn("id", F.udf(noted, "long").asNondeterministic()("id"))
    changes = state.replayed(rows, F.col("id") % 2, 2, lambda x: state.session_changes(x, KEYS, watermark="10 days"), 2)
    assert seen.value == 80 and changes.where("batch >= 0").count() > 0
