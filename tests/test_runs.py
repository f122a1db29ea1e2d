"""What runs note, models that are asked again, vectors kept for other days, jobs that cover a request, and the commands."""

import json
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_plans import chat

from parley.__main__ import main, past_day
from parley.functions.vectors import is_subset
from parley.operators import contacts
from parley.operators.sessions import pair_messages
from parley.plans import contacts as contact_plan
from parley.plans import hotspots
from parley.plans.providers import Asked, Busy, Denied, Embedding, SlidingWindow, Unavailable
from parley.settings import Settings
from parley.sources.tables import Store

S = Settings(clusters=2, pca_components=4, merge_similarity=0.95, split_min_sessions=4)


def test_runs_note_their_stages_and_the_drift(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    run = hotspots.run_daily(store, chat(spark), "2026-08-18", s=S)
    got = {r.stage: r for r in hotspots.stages(store, run).collect()}
    assert got["vectors"].rows == got["tokens"].rows == 12 and got["boards"].rows == 2 and all(r.seconds > 0 for r in got.values())
    roster = spark.createDataFrame([("A", "m0"), ("B", "m0"), ("B", "m1")], "department string, manager string")
    hotspots.run_departments(store, roster, "2026-08-18", s=S)
    (drift,) = store.read("stages").where("stage = 'drift'").collect()
    assert drift.kind == "departments" and drift.rows == 2 and 0 < drift.least <= drift.median <= 1.0001


def test_short_texts_are_embedded_once_for_all_days(spark, tmp_path):
    store, s = Store(spark, f"file://{tmp_path}"), Settings(clusters=2, pca_components=2, cacheable_chars=12)
    rows = [(i, f"wm{i}", "m0", "text", text, f"2026-08-{day}") for i, (text, day) in enumerate([("短句一二三四", 18), ("这一句很长很长很长很长很长很长", 18), ("短句一二三四", 19), ("这一句很长很长很长很长很长很长", 19)])]
    log = spark.createDataFrame(rows, "id long, from_user string, to_user string, msg_type string, content string, create_date string").withColumn("msg_time", F.to_timestamp("create_date"))
    asked = spark.sparkContext.accumulator(0)

    def embed(texts):
        asked.add(len(texts))
        return hotspots.hashing_embedder(texts)

    hotspots.run_daily(store, log, "2026-08-18", embed, s=s)
    hotspots.run_daily(store, log, "2026-08-19", embed, s=s)
    assert asked.value == 3 and store.read("text_vectors").count() == 1 and store.read("vectors").count() == 4
    hotspots.run_daily(store, log, "2026-08-19", embed, force=True, s=s)
    assert asked.value == 5


def test_embedding_is_asked_again_by_rule():
    waits, script = [], [Busy(7), Unavailable("off"), np.ones((2, 3)), Denied("401"), np.ones((1, 3)), Unavailable("a"), Unavailable("b"), Unavailable("c"), Unavailable("d")]

    def call(texts):
        step = script.pop(0)
        if isinstance(step, Exception):
            raise step
        return step

    embed = Embedding(call, 3, pause=2, sleep=waits.append)
    assert embed(["a", "b"]).shape == (2, 3) and waits == [7, 4]
    with pytest.raises(Denied):
        embed(["a"])
    with pytest.raises(ValueError, match="embedded"):
        embed(["a", "b"])
    with pytest.raises(Unavailable):
        embed(["a"])
    assert not script


def test_notes_of_an_asked_model_with_its_log_and_open_signals(spark, tmp_path):
    def one_answer(prompt, room):
        days = [x[1:11] for x in prompt.split("\n") if x.startswith("[2026")]
        return json.dumps({"days": [{"date": d, "topics": ["贷款"]} for d in days]}), 10, False

    store, messages = Store(spark, f"file://{tmp_path}"), pair_messages(chat(spark, (18,), 4))
    model = Asked(one_answer, SlidingWindow(10**6, 60, 10**9, 60))
    assert pickle.loads(pickle.dumps(model.limiter)).wait(1) == 0
    seen = store.spark.createDataFrame([("m0", "wm0", 1, "INV_FUND", "open", "2026-08-10"), ("m0", "wm0", 2, "GONE", "open", "2026-08-11"), ("m1", "wm1", 3, "INV_FUND", "open", "2026-01-01")], "manager string, customer string, event_id long, code string, status string, event_date string").withColumn("event_date", F.to_date("event_date"))
    prompts = []
    stats, notes, signals = contact_plan.daily_notes(messages, contacts.signal_table(spark), model, events=seen, write=lambda df: (prompts.append(df) if "prompt" in df.columns else None) or store.written("answers", df), calls=lambda rows: store.log_calls(rows, "note"))
    store.save_notes(stats, notes, signals)
    text = {r.customer: r.prompt for r in prompts[0].select("customer", "prompt").collect()}
    assert text["wm0"].startswith("open signals:\n- INV_FUND (08-10)\n\n[2026-08-18]") and text["wm1"].startswith("open signals:\nnone\n")
    calls = store.read("calls").collect()
    assert len(calls) == 4 and {(r.purpose, r.status, r.attempts, r.tokens, r.days) for r in calls} == {("note", "ok", 1, 10, 1)}
    assert {r.status for r in store.read("notes").collect()} == {"ok"} and store.read("day_stats").count() == 4


def test_answers_without_business_and_without_sense(spark):
    messages = pair_messages(chat(spark, (18,), 4))
    answers = {"wm0": '{"has_business_content": false, "days": []}', "wm1": "sorry", "wm2": '{"days": [{"date": "2026-08-18", "topics": "no list", "signals": [7, {"code": "INV_FUND", "status": "open", "evidence": "理财"}]}, 3]}', "wm3": '{"days": "none"}'}

    def model(prompts):
        return [answers[next(c for c in answers if p.rstrip().endswith(c[2:]) or f" {c[2:]}" in p)] for p in prompts]

    _, notes, signals = contact_plan.daily_notes(messages, contacts.signal_table(spark), model)
    assert {r.customer: r.status for r in notes.collect()} == {"wm0": "no_business", "wm1": "failed", "wm2": "ok", "wm3": "failed"}
    assert [(r.customer, r.code) for r in signals.collect()] == [("wm2", "INV_FUND")]


def test_subsets(spark):
    rows = spark.createDataFrame([([1, 2], [2, 1, 3]), ([1, 4], [1]), ([], [1]), ([], None), ([1], None), ([1, 1], [1])], "a array<int>, b array<int>")
    assert [r.x for r in rows.select(is_subset(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, True, True, False, True]


def test_commands(spark, tmp_path, capsys):
    log, root = f"file://{tmp_path}/log", f"file://{tmp_path}/store"
    main(["trial-log", "--out", log, "--dialogues", "60", "--days", "2", "--start", "2024-03-01"], spark)
    days = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [d["date"] for d in days] == ["2024-03-01", "2024-03-02"] and sum(d["messages"] for d in days) > 120
    main(["daily", "--root", root, "--date", "2024-03-01", "--log", log], spark)
    run = capsys.readouterr().out.strip()
    main(["board", "--root", root, "--date", "2024-03-01"], spark)
    board = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert board and {r["run_id"] for r in board} == {run} and [r["rank"] for r in board] == list(range(1, len(board) + 1))
    for wrong in ("2024-3-1", "20240301", "9999-01-01", "x"):
        with pytest.raises(ValueError, match="."):
            past_day(wrong)
    with pytest.raises(SystemExit):
        main(["departments", "--root", root, "--date", "2024-03-01"], spark)
