import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parley.operators import contacts, incremental
from parley.plans import contacts as contact_plan
from parley.plans import hotspots, providers
from parley.settings import Settings
from parley.sources import readers
from parley.sources.tables import Store

T0 = datetime(2026, 8, 18, 9)


def chat(spark, days=(18,), n=12):
    """Customers of three managers who talk of one of two things."""
    texts = {0: "提前还款 违约金 怎么 计算", 1: "理财 到期 赎回 收益"}
    rows = []
    for d in days:
        for i in range(n):
            at = T0.replace(day=d) + timedelta(hours=i % 8)
            for k in range(2):
                rows.append((len(rows), f"wm{i}", f"m{i % 3}", "text", f"{texts[i % 2]} {i}", at + timedelta(minutes=k), str(at.date())))
            rows.append((len(rows), f"m{i % 3}", f"wm{i}", "text", "您好，请稍等一下", at + timedelta(minutes=3), str(at.date())))
    return spark.createDataFrame(rows, "id long, from_user string, to_user string, msg_type string, content string, msg_time timestamp, create_date string")


def test_daily_board_trend_and_departments(spark, tmp_path):
    store, log = Store(spark, f"file://{tmp_path}"), chat(spark, (18, 19))
    s = Settings(clusters=2, pca_components=4, merge_similarity=0.95, split_min_sessions=4)
    first = hotspots.run_daily(store, log, "2026-08-18", s=s)
    hotspots.run_daily(store, log, "2026-08-19", s=s)
    day = hotspots.board(store, "2026-08-18").collect()
    assert [r["rank"] for r in day] == [1, 2] and sum(r.heat for r in day) == 24 and all(r.is_new for r in day)
    assert {r.run_id for r in day} == {first} and sum(r.session_count for r in day) == 12
    again = hotspots.board(store, "2026-08-19").collect()
    assert not any(r.is_new for r in again) and {r.heat_change_pct for r in again} == {0.0}
    roster = spark.createDataFrame([("A", "m0"), ("B", "m0"), ("B", "m1"), ("C", "nobody")], "department string, manager string")
    done = {r.department: r.topics for r in hotspots.run_departments(store, roster, "2026-08-19", s=s).collect()}
    assert set(done) == {"B"}  # A has two sessions of either topic, fewer than the floor
    assert sum(r.heat for r in hotspots.board(store, "2026-08-19", "department", "B").collect()) == 16
    assert hotspots.board(store, "2026-08-19", "department", "C").count() == 0
    assert hotspots.runs(store).count() == 2
    with pytest.raises(ValueError, match="no company run"):
        hotspots.run_departments(store, roster, "2026-08-20", s=s)
    assert store.expire("vectors", "2026-08-19") == ["2026-08-18"]


def test_empty_results_clear_a_scope(spark, tmp_path):
    path = f"file://{tmp_path}/boards"
    rows = spark.createDataFrame([(1, "d", "A"), (2, "d", "B")], "x int, stat_date string, scope string")
    incremental.overwrite_partitions(rows, path, ["stat_date", "scope"])
    incremental.replace_scope(rows.limit(0), path, stat_date="d", scope="A")
    assert [r.scope for r in spark.read.parquet(path).collect()] == ["B"]
    incremental.replace_scope(rows.where("x = 2").withColumn("x", F.lit(9)), path, stat_date="d", scope="B")
    assert [r.x for r in spark.read.parquet(path).collect()] == [9]


def test_upsert_and_patch(spark):
    old = spark.createDataFrame([("a", 1, "ok"), ("b", 2, "ok")], "k string, content int, status string")
    new = spark.createDataFrame([("b", 5, "failed"), ("c", 7, "failed")], "k string, content int, status string")
    assert {(r.k, r.content) for r in incremental.upserted(old, new, ["k"]).collect()} == {("a", 1), ("b", 5), ("c", 7)}
    got = incremental.patched(old, new, ["k"], F.col("status") == "failed", ["status"])
    assert {tuple(r) for r in got.collect()} == {("a", 1, "ok"), ("b", 2, "failed"), ("c", 7, "failed")}


def test_embedding_asks_for_each_text_once(spark):
    units = spark.createDataFrame([("s1", "a", "h1"), ("s2", "a", "h1"), ("s3", "b", "h2")], "session_id string, text string, text_hash string")
    cache = spark.createDataFrame([("h1", [9.0])], "text_hash string, vector array<float>")
    got = {r.session_id: r.vector for r in providers.embedded(units, lambda t: [[float(len(x))] for x in t], cache).collect()}
    assert got == {"s1": [9.0], "s2": [9.0], "s3": [1.0]}
    x = providers.hashing_embedder(["提前还款", "提前还款", ""])
    assert (x[0] == x[1]).all() and abs((x[0] ** 2).sum() - 1) < 1e-6


def test_limiter():
    now = [0.0]
    w = providers.SlidingWindow(3, 1.0, 1000, 2.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(3):
        assert w.wait(100) == 0
    assert w.wait(100) == 1.0
    now[0] = 1.5
    assert w.wait(800) == 0.5  # the tokens of the first three are held till 2.0
    w.acquire(800)
    assert now[0] == 2.0
    w.reconcile(800, 100)
    assert w.wait(800) == 0
    w.cool_down(5)
    assert w.wait(1) == 5.0
    with pytest.raises(ValueError, match="never"):
        w.wait(2000)


def test_roster_pages(spark):
    pages = {1: ["m1", "m2"], 2: ["m2", "m3"], 3: ["m4"]}
    failing = {2: 1}

    def fetch(department, page):
        if failing.get(page, 0) > 0:
            failing[page] -= 1
            raise OSError("503")
        return {"items": pages.get(page, []), "total": 5}

    assert [r.manager for r in readers.paged_roster(spark, "D", fetch, 2).collect()] == ["m1", "m2", "m3", "m4"]
    failing[3] = 5
    with pytest.raises(OSError):
        readers.paged_roster(spark, "D", fetch, 2)


def test_lexicon(spark, tmp_path):
    (tmp_path / "w.txt").write_text("ok\nOK\n 理财 \n\n")
    words = readers.read_words(spark, str(tmp_path / "w.txt"))
    assert {r.word.lower() for r in words.collect()} == {"ok", "理财"} and words.count() == 2
    lexicon = readers.lexicon_added(spark.createDataFrame([], "kind string, word string, enabled boolean"), words, "term")
    off = readers.lexicon_removed(lexicon, "OK", "term")
    assert [r.enabled for r in off.where("lower(word) = 'ok'").collect()] == [False]
    back = readers.lexicon_added(off, words.where("lower(word) = 'ok'"), "term")
    assert back.count() == 2 and back.where("enabled").count() == 2


def test_log_readers(spark):
    log = chat(spark)
    assert readers.customer_messages(log, "2026-08-18").count() == 24
    assert readers.day_messages(log, "2026-08-18").count() == 36 and readers.day_messages(log, "2026-08-19").count() == 0
    assert readers.manager_messages(log, "m0", "2026-08-18", "2026-08-18").count() == 12
    shards = readers.with_shard(log).select("shard").distinct().collect()
    assert all(1 <= r.shard <= 20 for r in shards)
    whole = log.withColumnRenamed("to_user", "manager")
    assert sum(readers.day_part(whole, k, 8).count() for k in range(8)) == log.count()


def test_contact_notes_and_summaries(spark):
    from parley.operators.sessions import pair_messages

    messages = pair_messages(chat(spark, (18, 19))).persist()
    asked = spark.sparkContext.accumulator(0)

    def provider(prompts):
        asked.add(len(prompts))
        out = []
        for p in prompts:
            days = [x[1:11] for x in p.split("\n") if x.startswith("[2026")]
            evidence = "提前还款" if "提前还款" in p else "理财 到期"
            out.append("```" + json.dumps({"days": [{"date": d, "topics": ["贷款"], "pending": ["回电"], "signals": [{"code": "NEED_YIELD", "status": "open", "evidence": evidence}]} for d in days]}) + "```")
        return out

    codes = contacts.signal_table(spark)
    stats, notes, signals = contact_plan.daily_notes(messages, codes, provider)
    notes = notes.persist()
    assert notes.count() == 24 and {r.status for r in notes.collect()} == {"ok"}
    assert signals.where("verified").count() == 24
    _, second, _ = contact_plan.daily_notes(messages, codes, provider, stored=notes)
    assert second.count() == 0
    out = contact_plan.contact_summaries(stats, notes, signals, codes, "2026-08-19", lambda p: ["短" for _ in p]).collect()
    assert len(out) == 12 and {r.status for r in out} == {"review"} and {r.business_days for r in out} == {2}
    assert "收益导向型：多次出现（2天）" in out[0].prompt and "- 8月中旬：回电" in out[0].prompt
    none = contact_plan.contact_summaries(stats, notes.withColumn("status", F.lit("no_business")), signals, codes, "2026-08-19")
    assert {r.status for r in none.collect()} == {"template"}
    assert contact_plan.summary_list(none, page=2, size=5).count() == 5
