import json
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from parley.operators import contacts
from parley.plans import queries
from parley.settings import Settings

MSG = "id long, manager string, customer string, from_customer boolean, content string, msg_time timestamp, stat_date date"
DAY = date(2026, 8, 18)


def msgs(spark, *rows):
    t = datetime(2026, 8, 18, 9)
    return spark.createDataFrame([(i, "m", "c", who, text, t + timedelta(minutes=i), DAY) for i, (who, text) in enumerate(rows)], MSG)


def test_transcript_merges_masks_and_clips(spark):
    chit = spark.createDataFrame([("好的",)], "word string")
    rows = msgs(spark, (True, "电话 13812345678"), (True, " 看看\n基金 "), (False, "好的"), (True, "谢谢"), (False, "x" * 400), (False, "  "))
    lines = [r.line for r in contacts.transcript_lines(rows, chit).orderBy("line_no").collect()]
    assert lines[0] == "09:00 客：电话 [手机号] / 看看 基金 / 谢谢"
    assert lines[1] == "09:04 经：" + "x" * 300 + "…" and len(lines) == 2


def test_transcript_of_chitchat_has_no_lines(spark):
    chit = spark.createDataFrame([("好的",)], "word string")
    assert contacts.transcript_lines(msgs(spark, (True, "好的")), chit).count() == 0


def test_long_transcripts_are_cut(spark):
    rows = msgs(spark, *[(i % 2 == 0, "字" * 40) for i in range(6)])
    lines = contacts.transcript_lines(rows)
    assert contacts.fit_transcripts(lines, 10_000).count() == 6
    cut = [r.line for r in contacts.fit_transcripts(lines, 100).orderBy("line_no").collect()]
    assert cut[-1] == "（当天记录过长，后续内容已截断）" and len(cut) == 3


def test_packing_of_days(spark):
    rows = spark.createDataFrame([("m", "c", d, t) for d, t in enumerate([30, 30, 50, 200, 10])], "manager string, customer string, stat_date int, tokens long")
    got = [r.batch for r in contacts.packed_days(rows, 100).orderBy("stat_date").collect()]
    assert got == [1, 1, 2, 3, 4]


def test_notes_are_validated(spark):
    codes = contacts.signal_table(spark)
    assert codes.count() == 34
    signals = [
        {"code": "inv_fund", "status": "Open", "evidence": "“看看，基金”"}, {"code": "INV_FUND", "status": "closed", "evidence": "x"}, {"code": "NOPE", "status": "open", "evidence": "x"},
        {"code": "MKT_RATE", "status": "maybe", "evidence": "x"}, {"code": "MKT_POLICY", "status": "closed", "evidence": "没有说过"}, {"code": "INV_BOND", "status": "open", "evidence": ""},
    ]
    days = [{"date": "2026-08-18", "topics": [" a  b ", "", "x" * 100, "d", "e"], "signals": signals}, {"date": "2026-08-18", "topics": ["second"]}, {"date": "bad"}, {"date": "2026-01-01", "topics": ["not asked"]}]
    answers = spark.createDataFrame([("m", "c", "```json\n" + json.dumps({"days": days}, ensure_ascii=False) + "\n```"), ("m", "d", "no json")], "manager string, customer string, answer string")
    asked = spark.createDataFrame([("m", "c", DAY, "09:00 客：看看 基金吗"), ("m", "d", DAY, "x")], "manager string, customer string, stat_date date, text string")
    notes, found = contacts.parsed_notes(answers, asked, codes)
    note = notes.collect()
    assert len(note) == 1 and note[0].topics == ["a b", "x" * 80, "d"] and note[0].facts == []
    got = {(r.code, r.status, r.verified) for r in found.collect()}
    assert got == {("INV_FUND", "open", True), ("MKT_POLICY", "closed", False), ("INV_BOND", "open", False)}


EVENTS = "manager string, customer string, event_id long, code string, status string, event_date date, evidence string"


def events(spark, *rows):
    return spark.createDataFrame([("m", "c", i, code, status, DAY + timedelta(days=d), f"e{i}") for i, (code, status, d) in enumerate(rows)], EVENTS)


def test_timeline(spark):
    rows = events(spark, ("NEED_YIELD", "open", 0), ("NEED_YIELD", "open", 0), ("NEED_YIELD", "open", 5), ("INV_FUND", "open", 1), ("INV_FUND", "closed", 3), ("OLD_CODE", "open", 1), ("NEED_CONTROL", "open", 2))
    got = {r.code: r for r in contacts.signal_timeline(rows, contacts.signal_table(spark)).withColumn("line", contacts.signal_line()).collect()}
    assert set(got) == {"NEED_YIELD", "INV_FUND", "NEED_CONTROL"}
    assert got["NEED_YIELD"].confirmed and got["NEED_YIELD"].open_days == 2 and not got["NEED_CONTROL"].confirmed
    fund = got["INV_FUND"]
    assert (fund.status, str(fund.closed_date), str(fund.first_open_date), fund.evidence, fund.confirmed) == ("closed", "2026-08-21", "2026-08-19", "e4", None)
    assert fund.line == "- 关注基金（投资理财）：已关闭；8月中旬出现 → 8月下旬关闭，依据：“e4”"
    assert got["NEED_CONTROL"].line == "- 控制权偏好：仅出现1天；8月中旬起，最近8月中旬；依据：“e6”"
    assert got["NEED_YIELD"].line == "- 收益导向型：多次出现（2天）；8月中旬起，最近8月下旬；依据：“e2”"


def test_open_signals(spark):
    rows = events(spark, ("A", "open", 0), ("A", "closed", 1), ("A", "open", 2), ("A", "open", 3), ("B", "open", 0), ("B", "closed", 0), ("C", "closed", 1))
    assert {(r.code, str(r.since)) for r in contacts.open_signals(rows).collect()} == {("A", "2026-08-20")}
    early = contacts.open_signals(rows, F.lit(DAY + timedelta(days=1)))
    assert {r.code for r in early.collect()} == {"A"}


def test_reuse(spark):
    keys = "manager string, customer string, stat_date date, "
    days = spark.createDataFrame([("m", c, DAY, "fp") for c in "abcd"], keys + "source_fp string")
    notes = spark.createDataFrame([("m", "a", DAY, "ok", "fp", "1"), ("m", "b", DAY, "failed", "fp", "1"), ("m", "c", DAY, "ok", "old", "1"), ("m", "d", DAY, "no_business", "fp", "0")], keys + "status string, source_fp string, prompt_version string")
    assert {r.customer: r.reused for r in contacts.reusable(days, notes, "1").collect()} == {"a": True, "b": False, "c": False, "d": False}


def note(day, topics, priority, extra=()):
    return ("m", "c", DAY + timedelta(days=day), topics, list(extra), [], [], priority)


def test_note_lines_shrink_then_go(spark):
    schema = "manager string, customer string, note_date date, topics array<string>, customer_points array<string>, manager_actions array<string>, facts array<string>, priority boolean"
    rows = spark.createDataFrame([note(0, ["a"], True, ["p" * 40]), note(1, ["b"], False, ["q" * 40]), note(2, ["c"], False, ["r" * 40]), note(3, ["d"], True, ["s" * 40])], schema)

    def lines(budget):
        return [r.line for r in contacts.fitted_notes(rows, budget).orderBy("note_date").collect()]

    assert lines(1000)[1] == "08-19｜话题：b｜客户：" + "q" * 40
    full, short = 22, 7  # tokens of a line that is whole and of one with its topics alone
    assert len(lines(4 * full - 1)) == 4 and lines(4 * full + 20)[1].endswith("q")
    assert [x[:5] for x in lines(2 * full + short + 5)] in (["08-18", "08-20", "08-21"], ["08-18", "08-19", "08-20", "08-21"])
    assert [x[:5] for x in lines(full + 3)] == ["08-21"] and [x[:5] for x in lines(1)] == ["08-21"]


def test_summary_rules(spark):
    base = "客户主要关注基金净值与稳健配置，对回撤较为敏感，多次询问替代方案与下行保护，建议后续以稳健配置为主并同步持仓表现。"
    cases = {
        base: [], "": ["empty"], "短": ["too short"], base + "沟通 3 次。": ["contact count"], base * 4: ["too long"], base + "收益3.5%。": ["unknown number"],
        base + "约20万。": [], base + "电话13812345678。": ["personal data"], base + "该标签。": ["internal term"], base + "INV_FUND": ["internal term"],
    }
    rows = spark.createDataFrame([(t, "资金 20 万", 1) for t in cases], "t string, s string, d int")
    got = {r.t: r.f for r in rows.select("t", contacts.summary_faults(F.col("t"), F.col("s"), F.col("d")).alias("f")).collect()}
    assert got == cases
    loose = rows.select("t", contacts.summary_faults(F.col("t"), F.col("s"), F.col("d"), False).alias("f")).collect()
    assert {r.t: r.f for r in loose}[base * 4] == []


def test_summary_rules_compute_the_texts_once(spark):
    """Each rule had its own copy of the normal form of the whole text, and each number one of the source."""
    n = F.col("id").cast("string")
    faults = contacts.summary_faults(F.concat(F.lit("the-text"), n), F.concat(F.lit("the-source"), n), F.col("id"))
    plan = spark.range(5).select(faults.alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("the-text"), plan.count("the-source")) == (1, 1)


def test_status_shares_and_eta(spark):
    rows = spark.createDataFrame([(0, 3), (1, 3), (3, 3)], "failed int, total int")
    assert [r.s for r in rows.select(contacts.run_status(F.col("failed"), F.col("total")).alias("s")).collect()] == ["success", "partial_success", "failed"]
    split = spark.createDataFrame([(11, 3, k) for k in range(3)], "n long, p long, k int").select(contacts.split_tokens(F.col("n"), F.col("p"), F.col("k")).alias("s"))
    assert [r.s for r in split.collect()] == [5, 3, 3]
    eta = spark.range(1).select(contacts.eta_seconds(F.lit(10), F.lit(0), F.lit(0)).alias("a"), contacts.eta_seconds(F.lit(10), F.lit(4), F.lit(3600)).alias("b")).first()
    assert (eta.a, eta.b) == (40, 20)


def test_table_of_signals_keeps_its_order(spark):
    rows = contacts.signal_table(spark).orderBy("ord").collect()
    assert rows[0].code == "INV_DEPOSIT" and rows[-1].code == "SVC_PURCHASE_INTENT"
    assert Settings().need_confirm_days == 2


def test_evidence_is_found_in_texts_of_every_language(spark, tmp_path):
    item = "The quick brown fox jumps"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, f"so: The quick, brown fox jumps! {i}", lang) for i, lang in enumerate(["en", "fr", "de", "es", None])]
    spark.createDataFrame([*rows, (9, "the quick fox", "fr")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["evidence_in_texts"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(i, 1) for i in range(5)]
