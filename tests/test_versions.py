"""Publishing by versions: readers, runs that die, reuse, and merges by key."""

import json
import os
from datetime import date

import pytest
from pyspark.sql import functions as F
from test_plans import chat

from parley.operators import contacts
from parley.plans import hotspots
from parley.settings import Settings
from parley.sources.tables import SCHEMAS, Store
from parley.sources.versions import Scope, changes_of

S = Settings(clusters=2, pca_components=4, merge_similarity=0.95, split_min_sessions=4)
DAY = "2026-08-18"


def test_a_reader_keeps_its_version(spark, tmp_path):
    scope = Scope(spark, f"file://{tmp_path}/a")
    assert scope.current() is None and scope.read(None, "t", "x long").count() == 0
    for k in range(1, 5):
        draft = scope.draft()
        draft.write("t", spark.range(k).toDF("x"))
        if k == 1:
            draft.write("u", spark.range(7).toDF("x"))
        else:
            draft.keep("u")
        assert k == 1 or scope.current().rows("t") == k - 1  # nothing is seen before
        made = draft.publish(by=k)
        assert (made.number, made.rows("t"), made.rows("u"), scope.current().info) == (k, k, 7, {"by": k})
        if k == 3:
            bound = scope.current()
    assert scope.read(bound, "t", "x long").count() == 3 and scope.read(scope.current(), "t", "x long").count() == 4
    assert scope.read(scope.current(), "u", "x long").count() == 7  # written by the first version
    folders = sorted(x.name[:8] for x in (tmp_path / "a").iterdir() if x.is_dir())
    assert folders == ["00000001", "00000003", "00000004"]  # the second went, the first is still named


def test_a_run_that_dies_between_two_tables_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store, log = Store(spark, f"file://{tmp_path}"), chat(spark)
    first = hotspots.run_daily(store, log, DAY, s=S)
    names = ("vectors", "tokens", "moments", "assignments", "centroids", "catalog", "boards", "manifests")
    before = {n: sorted(map(str, store.read(n).collect())) for n in names}
    put = Store.put

    def dies(self, draft, name, rows, **values):
        if name == "catalog":
            raise OSError("no space left")
        return put(self, draft, name, rows, **values)

    monkeypatch.setattr(Store, "put", dies)
    with pytest.raises(OSError):
        hotspots.run_daily(store, log.where("id % 2 = 0"), DAY, s=S)
    assert {n: sorted(map(str, store.read(n).collect())) for n in names} == before
    assert [(r.status, r.error) for r in hotspots.runs(store).orderBy("status").collect()] == [("failed", "OSError: no space left"), ("success", None)]
    monkeypatch.undo()
    second = hotspots.run_daily(store, log.where("id % 2 = 0"), DAY, s=S)
    assert {r.run_id for r in hotspots.board(store, DAY).collect()} == {second} != {first}


def test_words_alone_are_made_anew(spark, tmp_path):
    store, log = Store(spark, f"file://{tmp_path}"), chat(spark)
    asked = spark.sparkContext.accumulator(0)

    def embed(texts):
        asked.add(len(texts))
        return hotspots.hashing_embedder(texts)

    hotspots.run_daily(store, log, DAY, embed, s=S)
    n, scope = asked.value, store.scope("company", DAY)
    old, manifest = scope.current(), store.manifest(DAY)
    assert n == 12 and manifest.records == 12 and old.rows("tokens") == 12
    hotspots.run_daily(store, log, DAY, embed, dictionary={"提前": 5, "还款": 9, "违约金": 3, "理财": 5, "到期": 2, "赎回": 2, "收益": 7}, stop=["怎么"], s=S)
    new = scope.current()
    assert asked.value == n and new.paths("vectors") == old.paths("vectors") and new.paths("moments") == old.paths("moments") and new.paths("tokens") != old.paths("tokens")
    assert store.manifest(DAY).token_fp != manifest.token_fp and set(changes_of(old, new)["vectors"]) == set()
    words = {w for r in hotspots.board(store, DAY).collect() for w in r.words}
    assert {"违约金", "赎回", "收益"} <= words and "怎么" not in words
    hotspots.run_daily(store, log, DAY, embed, dictionary={"提前": 5, "还款": 9, "违约金": 3, "理财": 5, "到期": 2, "赎回": 2, "收益": 7}, stop=["怎么"], s=S)
    assert scope.current().paths("tokens") == new.paths("tokens") and asked.value == n
    # One customer says something else: that text alone is embedded; a new model embeds all.
    other = log.withColumn("content", F.when(F.col("from_user") == "wm3", F.concat("content", F.lit(" 再说一句"))).otherwise(F.col("content")))
    hotspots.run_daily(store, other, DAY, embed, s=S)
    assert asked.value == n + 1
    hotspots.run_daily(store, other, DAY, embed, embed_config={"model": "b"}, s=S)
    assert asked.value == 2 * n + 1
    hotspots.run_daily(store, other, DAY, embed, embed_config={"model": "b"}, force=True, s=S)
    assert asked.value == 3 * n + 1


def test_intents_of_a_model_on_both_boards(spark, tmp_path):
    store, log = Store(spark, f"file://{tmp_path}"), chat(spark)

    def model(prompts):
        return [json.dumps({"intent": "问还款", "business_words": ["还款", "提前还款"]}) if "提前还款" in p.split("texts:")[1] else "busy" for p in prompts]

    hotspots.run_daily(store, log, DAY, provider=model, s=S)
    got = {r.customer_intent: r for r in hotspots.board(store, DAY).collect()}
    assert got["问还款"].intent_source == "model" and got["问还款"].business_words == ["提前还款"] and 1 <= len(got["问还款"].representative) <= 5
    (other,) = [r for r in got.values() if r.customer_intent != "问还款"]
    assert other.intent_source == "words" and other.customer_intent.startswith("客户关注")
    roster = spark.createDataFrame([("B", "m0"), ("B", "m1")], "department string, manager string")
    hotspots.run_departments(store, roster, DAY, s=S, provider=model)
    local = hotspots.board(store, DAY, "department", "B").collect()
    assert {r.intent_source for r in local} == {"global"} and {r.customer_intent for r in local} == set(got)


def test_departments_of_the_roster_are_replaced_others_stay(spark, tmp_path):
    store, log = Store(spark, f"file://{tmp_path}"), chat(spark)
    hotspots.run_daily(store, log, DAY, s=S)
    schema = "department string, manager string"
    both = spark.createDataFrame([("A", "m0"), ("A", "m1"), ("B", "m1"), ("B", "m2")], schema)
    assert {r.department for r in hotspots.run_departments(store, both, DAY, s=S).collect()} == {"A", "B"}
    cached = spark.range(3).cache()
    cached.count()
    assert {r.department for r in hotspots.run_departments(store, spark.createDataFrame([("A", "nobody"), ("C", "m0"), ("C", "m2")], schema), DAY, s=S).collect()} == {"C"}
    assert cached.is_cached  # plans leave the caller's cache alone
    cached.unpersist()
    assert [hotspots.board(store, DAY, "department", d).count() > 0 for d in "ABC"] == [False, True, True]
    assert hotspots.assigned(store, DAY, spark.createDataFrame([("m2",)], "staff string")).select("staff").distinct().collect()[0].staff == "m2"
    hotspots.run_daily(store, log.limit(0), DAY, s=S)
    assert hotspots.board(store, DAY).count() == 0 and store.read("vectors", DAY).count() == 0
    with pytest.raises(ValueError, match="no company run"):
        hotspots.run_departments(store, both, DAY, s=S)


def note(customer, day, status, topics=(), fp="f", error=None):
    return (f"m:{customer}:{day}", "m", customer, date(2026, 8, day), status, fp, "1", list(topics), [], [], [], [], error)


def signal(customer, day, no, code):
    return (f"m:{customer}:{day}", "m", customer, no, code, "open", "e", True, date(2026, 8, day))


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_notes_and_their_signals_are_one_commit(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    stats = spark.createDataFrame([], SCHEMAS["day_stats"])
    df = lambda rows, name: spark.createDataFrame(rows, SCHEMAS[name])
    notes = [note(f"c{i}", 1 + i % 3, "ok", ["t"]) for i in range(60)]
    store.save_notes(stats, df(notes, "notes"), df([signal(f"c{i}", 1 + i % 3, 0, "A") for i in range(60)], "signals"))
    assert store.read("notes").count() == 60 and store.read("signals").count() == 60
    old, mine = store.scope("contacts").current(), files(tmp_path / "contacts")
    # c0 fails, c1 has other signals, c2 has none any more, c99 is new and failed.
    again = [note("c0", 1, "failed", fp="g", error="no answer"), note("c1", 2, "ok", ["u"]), note("c2", 3, "no_business"), note("c99", 1, "failed", error="x")]
    found = [signal("c1", 2, 0, "B"), signal("c1", 2, 1, "C"), signal("c0", 1, 0, "Z")]
    for _ in range(2):  # a batch that comes again changes nothing
        store.save_notes(stats, df(again, "notes"), df(found, "signals"))
        got = {r.customer: r for r in store.read("notes").collect()}
        assert len(got) == 61 and (got["c0"].status, got["c0"].topics, got["c0"].source_fp, got["c0"].error) == ("failed", ["t"], "g", "no answer")
        assert got["c1"].topics == ["u"] and got["c2"].status == "no_business" and got["c99"].status == "failed"
        codes = sorted((r.customer, r.code) for r in store.read("signals").where("customer IN ('c0', 'c1', 'c2', 'c3')").collect())
        assert codes == [("c0", "A"), ("c1", "B"), ("c1", "C"), ("c3", "A")]
    new, now = store.scope("contacts").current(), files(tmp_path / "contacts")
    kept = set(old.paths("notes")) & set(new.paths("notes"))
    assert 0 < len(set(new.paths("notes")) - kept) <= 4 and len(kept) > 20
    same = [p for p in mine if any(p.startswith(k.removeprefix("file://")) for k in kept)]
    assert same and all(now[p] == mine[p] for p in same)
    assert new.rows("notes") == 61 and new.rows("signals") == store.read("signals").count()


def test_a_failed_summary_keeps_the_old_one(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    row = lambda c, status, text, error=None: ("m", c, date(2026, 8, 19), 1, date(2026, 8, 18), 1, 0, [("S", "open")], "fp", text, status, error)
    df = lambda rows: spark.createDataFrame(rows, SCHEMAS["summaries"])
    store.save_summaries(df([row("a", "success", "one"), row("b", "success", "two")]))
    store.save_summaries(df([row("a", "failed", None, "off"), row("c", "review", None)]))
    got = {r.customer: (r.status, r.summary, r.error) for r in store.read("summaries").collect()}
    assert got == {"a": ("failed", "one", "off"), "b": ("success", "two", None), "c": ("review", None, None)}


def test_open_signals_of_many_days_like_one_by_one(spark):
    rows = [("m", f"c{i % 4}", i, "AB"[i % 2], "open" if i * 7 % 5 else "closed", date(2026, 1 + i % 9, 1 + i * 5 % 28)) for i in range(300)]
    events = spark.createDataFrame(rows, "manager string, customer string, event_id long, code string, status string, event_date date").cache()
    days = [date(2026, 5, 3), date(2026, 2, 11), date(2026, 9, 30)]
    wanted = spark.createDataFrame([("m", f"c{k}", d) for k in range(5) for d in days] + [("x", "c0", days[0])], "manager string, customer string, stat_date date")
    out = contacts.open_on_days(wanted, events)
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
    got = sorted(map(tuple, out.select("stat_date", "customer", "code", "since").collect()))
    want = sorted((d, r.customer, r.code, r.since) for d in days for r in contacts.open_signals(events, F.lit(d)).collect())
    assert got == want and len(want) > 5
