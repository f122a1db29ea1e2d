"""Queries of pair-day statistics, transcripts, signals, notes and summaries over whole tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions import text
from parley.operators import contacts, evidence, incremental, sessions, topics
from parley.plans import contacts as plan
from parley.plans.hotspot_queries import MASKED, MESSAGES
from parley.plans.registry import query
from parley.settings import Settings
from parley.sources.readers import event_messages, table

DAYS = f"""WITH {MESSAGES}, b AS (
    SELECT *, CAST(msg_time AS DATE) AS stat_date, lag(msg_time) OVER (PARTITION BY manager, customer ORDER BY msg_time, id) AS prev FROM m
), f AS (SELECT *, prev IS NULL OR msg_time - prev > INTERVAL 30 MINUTE AS begins FROM b
), st AS (
    SELECT manager, customer, stat_date, count(*) AS msg_count, count(*) FILTER (from_customer) AS customer_msg_count, count(*) FILTER (NOT from_customer) AS manager_msg_count,
    count(*) FILTER (begins) AS session_count, count(*) FILTER (begins AND from_customer) AS customer_initiated, min(msg_time) AS first_msg_time, max(msg_time) AS last_msg_time,
    sha256(string_agg(epoch_us(msg_time) || ':' || id || ':' || CAST(from_customer AS INTEGER) || ':' || md5(content), chr(10) ORDER BY msg_time, id)) AS source_fp FROM f GROUP BY 1, 2, 3
)"""
EVENTS = """md AS (SELECT median(value) AS mid FROM events), ev AS (
    SELECT event_id, user_id % 10 AS manager, user_id AS customer, event_type AS code, CASE WHEN value >= mid THEN 'open' ELSE 'closed' END AS status, CAST(ts AS DATE) AS event_date, props AS evidence, event_id % 5 <> 0 AS verified, user_id * 1000 + day(ts) AS note_id
    FROM events, md
)"""
NOTES = """nt AS (SELECT DISTINCT user_id * 1000 + day(ts) AS note_id, user_id % 10 AS manager, user_id AS customer, CAST(ts AS DATE) AS note_date,
    CASE (user_id + day(ts)) % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'no_business' ELSE 'ok' END AS status FROM events WHERE event_type <> 'signup')"""
CODES = """cd AS (SELECT * FROM (VALUES (0, 'view', 'View', 'topic', 'use'), (1, 'click', 'Click', 'topic', 'use'), (2, 'purchase', 'Purchase', 'need', 'buy')) t(ord, code, name, category, "group"))"""


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.day_stats(event_messages(spark, sf_dir))


def signal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as signals: open from the median value on, every fifth unverified; a note for each pair and day."""
    e = table(spark, sf_dir, "events")
    mid = e.agg(F.percentile("value", 0.5).alias("mid"))
    return e.crossJoin(F.broadcast(mid)).select(
        "event_id", (F.col("user_id") % 10).alias("manager"), F.col("user_id").alias("customer"), F.col("event_type").alias("code"), F.when(F.col("value") >= F.col("mid"), "open").otherwise("closed").alias("status"),
        F.to_date("ts").alias("event_date"), F.col("props").alias("evidence"), (F.col("event_id") % 5 != 0).alias("verified"), (F.col("user_id") * 1000 + F.dayofmonth("ts")).alias("note_id"),
    )


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type <> 'signup'")
    k = (F.col("user_id") + F.dayofmonth("ts")) % 4
    return e.select(
        (F.col("user_id") * 1000 + F.dayofmonth("ts")).alias("note_id"), (F.col("user_id") % 10).alias("manager"), F.col("user_id").alias("customer"), F.to_date("ts").alias("note_date"),
        F.when(k == 0, "failed").when(k == 1, "no_business").otherwise("ok").alias("status"),
    ).distinct()


def _codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "view", "View", "topic", "use"), (1, "click", "Click", "topic", "use"), (2, "purchase", "Purchase", "need", "buy")], "ord int, code string, name string, category string, `group` string")


@query(f"{DAYS} SELECT * FROM st")
def pair_day_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir)


@query(f"{DAYS} SELECT manager, customer, CAST(sum(session_count) AS BIGINT) AS session_count, CAST(sum(customer_initiated) AS BIGINT) AS customer_initiated, count(*) AS active_days, CAST(sum(msg_count) AS BIGINT) AS msg_count, CAST(max(last_msg_time) AS DATE) AS last_contact FROM st WHERE stat_date BETWEEN DATE '2024-01-25' - 29 AND DATE '2024-01-25' GROUP BY 1, 2")
def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.window_stats(_stats(spark, sf_dir), "2024-01-25")


@query(f"{DAYS} SELECT DISTINCT manager, customer FROM st WHERE stat_date BETWEEN DATE '2024-01-10' - 6 AND DATE '2024-01-10'")
def window_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.to_date(F.lit("2024-01-10"))
    return _stats(spark, sf_dir).where(F.col("stat_date").between(F.date_sub(end, 6), end)).select("manager", "customer").distinct()


@query("""WITH c AS (SELECT *, role = 'user' AS customer FROM conversations WHERE role <> 'system'), k AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS fresh FROM c),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM k)
SELECT conv_id, CAST(run AS BIGINT) AS run, role, string_agg(text, ' / ' ORDER BY turn) AS line FROM r GROUP BY 1, 2, 3""")
def speaker_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of one speaker in a row as one line."""
    rows = contacts.speaker_runs(table(spark, sf_dir, "conversations").where("role <> 'system'"), "role", ["conv_id"], ["turn"])
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return rows.groupBy("conv_id", "run", "role").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " / ").alias("line"))


_COST = "CAST(ceil(round(0.35 * length(text), 6)) AS BIGINT) + 1"


@query(f"WITH c AS (SELECT conv_id, turn, sum({_COST}) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM c WHERE used <= 120")
def transcript_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading turns of each conversation within a budget of tokens."""
    rows = table(spark, sf_dir, "conversations")
    return contacts.fitted_lines(rows, text.estimate_tokens(F.col("text")) + 1, 120, keys=["conv_id"], order="turn").select("conv_id", "turn", "used")


@query(f"""WITH RECURSIVE {DAYS[5:]}, n AS (SELECT manager, customer, stat_date, msg_count * 100 AS tokens, row_number() OVER (PARTITION BY manager, customer ORDER BY stat_date) AS k FROM st),
    g AS (SELECT manager, customer, stat_date, tokens, k, CAST(1 AS BIGINT) AS batch, tokens AS used FROM n WHERE k = 1
    UNION ALL SELECT n.manager, n.customer, n.stat_date, n.tokens, n.k, CASE WHEN g.used > 0 AND g.used + n.tokens > 500 THEN g.batch + 1 ELSE g.batch END, CASE WHEN g.used > 0 AND g.used + n.tokens > 500 THEN n.tokens ELSE g.used + n.tokens END
    FROM g JOIN n ON n.manager = g.manager AND n.customer = g.customer AND n.k = g.k + 1)
    SELECT manager, customer, stat_date, tokens, batch FROM g""")
def packed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a pair in batches within a budget, greedily in order."""
    return contacts.packed_days(_stats(spark, sf_dir).withColumn("tokens", F.col("msg_count") * 100), 500)


@query(f"""WITH {EVENTS}, {CODES}, x AS (SELECT ev.*, cd.* EXCLUDE (code), row_number() OVER (PARTITION BY manager, customer, code ORDER BY event_date DESC, event_id DESC) AS back FROM ev JOIN cd USING (code)),
    t AS (SELECT manager, customer, code, name, category, "group", ord, max(status) FILTER (back = 1) AS status, min(event_date) AS first_date, max(event_date) AS last_date, count(DISTINCT event_date) FILTER (status = 'open') AS open_days,
    min(event_date) FILTER (status = 'open') AS opened, max(evidence) FILTER (back = 1) AS evidence FROM x GROUP BY ALL)
    SELECT * EXCLUDE (opened), CASE WHEN status = 'closed' THEN opened END AS first_open_date, CASE WHEN category = 'need' THEN open_days >= 2 END AS confirmed, CASE WHEN status = 'closed' THEN last_date END AS closed_date FROM t""")
def signal_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.signal_timeline(signal_events(spark, sf_dir), _codes(spark))


@query(f"WITH {EVENTS}, cl AS (SELECT manager, customer, code, max(epoch(event_date) * 1000000 + event_id) AS closed_at FROM ev WHERE status = 'closed' GROUP BY 1, 2, 3) SELECT manager, customer, code, min(event_date) AS since FROM ev LEFT JOIN cl USING (manager, customer, code) WHERE status = 'open' AND (closed_at IS NULL OR epoch(event_date) * 1000000 + event_id > closed_at) GROUP BY 1, 2, 3")
def open_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.open_signals(signal_events(spark, sf_dir))


@query(f"WITH {EVENTS}, e AS (SELECT * FROM ev WHERE event_date >= DATE '2024-01-20' - 90 AND event_date < DATE '2024-01-20'), cl AS (SELECT manager, customer, code, max(epoch(event_date) * 1000000 + event_id)  AS closed_at FROM e WHERE status = 'closed' GROUP BY 1, 2, 3) SELECT manager, customer, code, min(event_date) AS since FROM e LEFT JOIN cl USING (manager, customer, code) WHERE status = 'open' AND (closed_at IS NULL OR epoch(event_date) * 1000000 + event_id > closed_at) GROUP BY 1, 2, 3")
def open_signals_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals still open ahead of a day, from the 90 days before it."""
    return contacts.open_signals(signal_events(spark, sf_dir), F.to_date(F.lit("2024-01-20")))


@query(f"WITH {EVENTS}, {NOTES} SELECT event_id, code, ev.status AS signal_status, event_date, note_id FROM ev JOIN nt USING (note_id) WHERE verified AND nt.status = 'ok'")
def signal_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.signal_list(signal_events(spark, sf_dir), _notes(spark, sf_dir)).select("event_id", "code", F.col("status").alias("signal_status"), "event_date", "note_id")


@query(f"{DAYS}, {EVENTS}, {NOTES} SELECT note_id, nt.manager, nt.customer, note_date, nt.status, msg_count, session_count, e.event_id, e.code FROM nt LEFT JOIN st ON st.manager = nt.manager AND st.customer = nt.customer AND st.stat_date = nt.note_date LEFT JOIN ev e USING (note_id)")
def note_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with statistics and nested signals, shown a signal a row."""
    rows = contacts.note_list(_stats(spark, sf_dir), _notes(spark, sf_dir), signal_events(spark, sf_dir))
    return rows.select("note_id", "manager", "customer", "note_date", "status", "msg_count", "session_count", F.explode_outer("signals").alias("x")).select("*", "x.event_id", "x.code").drop("x")


@query(f"{DAYS}, {NOTES} SELECT manager, customer, stat_date FROM st WHERE NOT EXISTS (SELECT 1 FROM nt WHERE nt.manager = st.manager AND nt.customer = st.customer AND nt.note_date = st.stat_date AND nt.status IN ('ok', 'no_business'))")
def missing_note_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.missing_days(_stats(spark, sf_dir), _notes(spark, sf_dir))


@query(f"{DAYS}, {NOTES}, d AS (SELECT DISTINCT stat_date FROM st), cv AS (SELECT DISTINCT note_date FROM nt WHERE status <> 'failed' AND manager < 5), sl AS (SELECT DISTINCT note_date FROM nt WHERE status = 'failed' AND manager = 3) SELECT stat_date FROM d WHERE stat_date NOT IN (SELECT note_date FROM cv) UNION SELECT note_date FROM sl")
def dates_to_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, notes = _stats(spark, sf_dir), _notes(spark, sf_dir).withColumnRenamed("note_date", "stat_date")
    return contacts.dates_to_run(stats.select("stat_date").distinct(), notes.where("status <> 'failed' AND manager < 5"), notes.where("status = 'failed' AND manager = 3"))


@query(f"{DAYS}, w AS (SELECT manager, customer, CAST(sum(session_count) AS BIGINT) AS session_count, CAST(max(last_msg_time) AS DATE) AS last_contact FROM st GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY session_count DESC, last_contact DESC, manager, customer) AS place FROM w) SELECT manager, customer, session_count, last_contact FROM r WHERE place BETWEEN 21 AND 40")
def summary_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 20 of the summary list (the page is the feature)."""
    rows = sessions.window_stats(_stats(spark, sf_dir), "2024-01-30").select("manager", "customer", "session_count", "last_contact")
    return contacts.paged(rows, [F.desc("session_count"), F.desc("last_contact"), F.col("manager"), F.col("customer")], 2, 20)


_KEY = r"""regexp_replace(text, '[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\[\]【】（）()“”"''‘’「」《》<>，。、；：！？,.;:!?…·~～-]', '', 'g')"""


@query(f"WITH k AS (SELECT item_id, {_KEY} AS key FROM benchmark), d AS (SELECT doc_id, {_KEY} AS key FROM documents) SELECT doc_id, item_id FROM d JOIN k ON k.key <> '' AND contains(d.key, k.key)")
def evidence_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that are evidenced by a text, of any language: spaces and marks left out, as evidence of notes is checked."""
    items = table(spark, sf_dir, "benchmark").select("item_id", text.evidence_key(F.col("text")).alias("item")).where("item <> ''")
    docs = table(spark, sf_dir, "documents").select("doc_id", text.evidence_key(F.col("text")).alias("key"))
    return evidence.contained(docs, items)


@query(f"WITH {EVENTS} SELECT a.event_id, b.user_id % 100 AS source, {_KEY.replace('text', 'evidence')} <> '' AND contains({_KEY.replace('text', 'b.props')}, {_KEY.replace('text', 'evidence')}) AS verified FROM ev a JOIN events b ON b.event_id = a.event_id + 1")
def verified_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an event's text is evidenced by that of the next one."""
    e, after = signal_events(spark, sf_dir), table(spark, sf_dir, "events").select((F.col("event_id") - 1).alias("event_id"), F.col("props").alias("source_text"), (F.col("user_id") % 100).alias("source"))
    return e.join(after, "event_id").select("event_id", "source", text.is_evidenced(F.col("evidence"), F.col("source_text")).alias("verified"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON wrapped in other text, found from the first brace to the last."""
    wrapped = F.concat(F.lit("answer: "), F.col("props"), F.lit(" end"))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(text.json_object(wrapped), "k long")["k"].alias("k"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 10500 MILLISECONDS PRECEDING AND CURRENT ROW) AS calls_in_window, CAST(sum(length(props)) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS BIGINT) AS weight_in_window FROM events")
def limiter_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sliding-window limiter counts at each event: calls in 10.5 s, weight in 60 s."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions.trailing_load(e, ["user_id"], "ts", F.length("props"), 10.5, 60).select("event_id", "calls_in_window", "weight_in_window")


@query(f"{DAYS} SELECT manager, customer, stat_date, msg_count, session_count, customer_initiated FROM st WHERE stat_date >= DATE '2024-01-16'")
def carried_day_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of the month alone, with sessions carried over from the stored statistics of the first."""
    rows, at = event_messages(spark, sf_dir), F.to_date("msg_time") >= F.to_date(F.lit("2024-01-16"))
    stored = sessions.day_stats(rows.where(~at)).select("manager", "customer", "last_msg_time")
    return sessions.day_stats(rows.where(at), before=stored).select("manager", "customer", "stat_date", "msg_count", "session_count", "customer_initiated")


@query("SELECT substr(md5(string_agg(word, chr(10) ORDER BY word)), 1, 16) AS fingerprint FROM (SELECT DISTINCT n_name AS word FROM nation)")
def lexicon_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.functions.hashing import word_list_fingerprint

    return table(spark, sf_dir, "nation").select("n_name").distinct().agg(word_list_fingerprint(F.col("n_name")).alias("fingerprint"))


@query("SELECT o_orderkey, month(o_orderdate) || '月' || CASE WHEN day(o_orderdate) <= 10 THEN '上旬' WHEN day(o_orderdate) <= 20 THEN '中旬' ELSE '下旬' END AS period, CAST(o_orderdate AS DATE) - 29 AS window_start FROM orders")
def period_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.period_label(day).alias("period"), F.date_sub(day, 29).alias("window_start"))


@query("WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_id, event_type, value FROM n WHERE k = 1")
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest event, by upserting the second half of the month over the first."""
    e = table(spark, sf_dir, "events")
    rows = e.select("user_id", "event_id", "event_type", "value", "ts")
    first = topics.dedupe_first(rows.where(F.dayofmonth("ts") <= 15), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return incremental.upserted(first, rows.where(F.dayofmonth("ts") > 15), ["user_id"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("SELECT doc_id, md5(text) AS source_fp FROM documents WHERE doc_id % 3 = 0 OR source = 'src2'")
def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose fingerprint differs from a stored one: here a third of them, and one source that was never stored."""
    now = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("source_fp"))
    stored = now.where("source <> 'src2'").withColumn("source_fp", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.col("source_fp")))
    return incremental.changed(now.drop("source"), stored.drop("source"), ["doc_id"])


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'user' AND role = 'assistant' THEN 1 ELSE 0 END AS answer FROM conversations)
SELECT conv_id, count(*) AS turns, CAST(sum(answer) AS BIGINT) AS answers FROM c GROUP BY 1""")
def answered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("answer", ((F.lag("role").over(w) == "user") & (F.col("role") == "assistant")).cast("int"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.coalesce("answer", F.lit(0))).alias("answers"))


_FORBIDDEN = " OR ".join(f"contains(t, '{word}')" for word in contacts.FORBIDDEN)
_COLLAPSED = r"""trim(regexp_replace(coalesce(text, ''), '[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))"""


@query(MASKED.replace("SELECT doc_id, text AS t FROM documents", f"SELECT doc_id, {_COLLAPSED} AS t FROM documents") + rf""", p AS (
    SELECT doc_id, a.t, x.t <> a.t AS personal, doc_id % 5 AS days, replace(regexp_replace(coalesce(text, ''), '[\s\x{{0b}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', '', 'g'), '5', '') AS source FROM a JOIN x USING (doc_id) JOIN documents USING (doc_id)
), l AS (SELECT *, CASE WHEN days <= 1 THEN 50 WHEN days <= 3 THEN 80 ELSE 100 END AS low, CASE WHEN days <= 1 THEN 180 WHEN days <= 3 THEN 260 ELSE 360 END AS high FROM p)
SELECT doc_id, t = '' AS empty, regexp_matches(t, '{contacts.CONTACT_COUNT}') AS contact_count, length(t) > high AS too_long, t <> '' AND length(t) < low AS too_short,
    len(list_filter(regexp_extract_all(t, '\d+(?:\.\d+)?[\t\n\f\r ]*(?:%|％|万|元|亿)'), lambda n: NOT contains(source, replace(n, ' ', '')))) > 0 AS unknown_number,
    personal, {_FORBIDDEN} OR regexp_matches(t, '(^|[^A-Za-z0-9])[A-Z]+_[A-Z_]+($|[^A-Za-z0-9])') AS internal FROM l""")
def summary_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that whole texts break as summaries, by name; as source each has itself without the digit 5."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 5).alias("days"))
    found = rows.select("doc_id", contacts.summary_faults(F.col("text"), F.replace(F.col("text"), F.lit("5"), F.lit("")), F.col("days")).alias("faults"))
    rules = {"empty": "empty", "contact_count": "contact count", "too_long": "too long", "too_short": "too short", "unknown_number": "unknown number", "personal": "personal data", "internal": "internal term"}
    return found.select("doc_id", *(F.array_contains("faults", rule).alias(name) for name, rule in rules.items()))


@query(f"{DAYS}, {NOTES} SELECT st.manager, st.customer, stat_date, nt.status AS note_status, coalesce(nt.status IN ('ok', 'no_business') AND nt.note_id % 3 > 0 AND nt.note_id % 5 > 0, false) AS reused FROM st LEFT JOIN nt ON nt.manager = st.manager AND nt.customer = st.customer AND nt.note_date = st.stat_date")
def existing_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pair-days with their note's state, null where there is none, and whether it may be used again: a third of the notes has an old fingerprint, a fifth an old prompt."""
    days = _stats(spark, sf_dir).select("manager", "customer", "stat_date", "source_fp")
    n = F.col("note_id")
    notes = _notes(spark, sf_dir).withColumnRenamed("note_date", "stat_date").withColumn("prompt_version", F.when(n % 5 > 0, "2").otherwise("1"))
    stored = notes.join(days, ["manager", "customer", "stat_date"], "left").withColumn("source_fp", F.when(n % 3 > 0, F.col("source_fp")).otherwise("old"))
    rows = contacts.reusable(contacts.with_notes(days, stored).drop("note_fp", "note_version").withColumnRenamed("note_status", "state"), stored, "2")
    return rows.select("manager", "customer", "stat_date", F.col("state").alias("note_status"), "reused")


@query(f"""{DAYS}, {EVENTS}, j AS (SELECT st.manager, st.customer, st.stat_date, e.code, e.status, e.event_date, epoch(e.event_date) * 1000000 + e.event_id AS moment FROM st JOIN ev e ON e.manager = st.manager AND e.customer = st.customer AND e.event_date >= st.stat_date - 7 AND e.event_date < st.stat_date),
    cl AS (SELECT manager, customer, stat_date, code, max(moment) AS closed_at FROM j WHERE status = 'closed' GROUP BY ALL)
    SELECT manager, customer, stat_date, code, min(event_date) AS since FROM j LEFT JOIN cl USING (manager, customer, stat_date, code) WHERE status = 'open' AND (closed_at IS NULL OR moment > closed_at) GROUP BY ALL""")
def open_signals_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every day of every pair the signals that are open ahead of it, from the seven days before."""
    return contacts.open_on_days(_stats(spark, sf_dir), signal_events(spark, sf_dir), s=Settings(signal_lookback_days=7))


@query(f"{DAYS} SELECT manager, customer, stat_date, msg_count FROM st WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = st.customer AND c_acctbal > 5000)")
def requested_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of requested customers: those whose account is high."""
    wanted = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("customer"))
    return contacts.requested(_stats(spark, sf_dir).select("manager", "customer", "stat_date", "msg_count"), wanted, ["customer"])


@query(f"""{DAYS}, w AS (SELECT manager, stat_date AS request, customer FROM st WHERE customer % 3 = 0 AND stat_date < DATE '2024-01-16'), j AS (SELECT manager, stat_date AS job, customer FROM st WHERE stat_date >= DATE '2024-01-16'),
    r AS (SELECT DISTINCT manager, request FROM w), d AS (SELECT DISTINCT manager, job FROM j)
    SELECT manager, request, min(job) AS job FROM r JOIN d USING (manager) WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.manager = r.manager AND w.request = r.request AND NOT EXISTS (SELECT 1 FROM j WHERE j.manager = d.manager AND j.job = d.job AND j.customer = w.customer)) GROUP BY 1, 2""")
def reusable_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every day of the month's first half and manager, the first day of the second half on which all of that day's customers (every third one) were there."""
    days = _stats(spark, sf_dir)
    late = F.col("stat_date") >= F.to_date(F.lit("2024-01-16"))
    jobs = days.where(late).groupBy("manager", F.col("stat_date").alias("job")).agg(F.collect_set("customer").alias("customers"))
    requests = days.where(~late & (F.col("customer") % 3 == 0)).groupBy("manager", F.col("stat_date").alias("request")).agg(F.collect_set("customer").alias("customers"))
    return contacts.covering_jobs(jobs, requests)


def _stub_answers(prompts: list[str]) -> list[str | None]:
    """Answers by the day of the month of a prompt's only day: no JSON, no days, an unnamed, an empty and a full one."""
    out: list[str | None] = []
    for prompt in prompts:
        date = prompt[1:11]
        n = int(date[-2:])
        full = {"date": date, "topics": [f"t{n}", " "], "signals": [{"code": "VIEW", "status": "open", "evidence": "{"}, {"code": "none", "status": "open"}]}
        days = {0: [{"date": date}], 1: [full], 2: [], 3: [{**full, "topics": None}]}[n % 4]
        out.append(None if n % 9 == 8 else "no json" if n % 5 == 4 else json.dumps({"has_business_content": bool(days), "days": days}))
    return out


@query(f"""{DAYS}, k AS (SELECT manager, customer, stat_date AS note_date, day(stat_date) AS n FROM st)
    SELECT manager, customer, note_date, CASE WHEN n % 7 = 3 THEN 'no_business' WHEN n % 9 = 8 OR n % 5 = 4 THEN 'failed' WHEN n % 4 IN (1, 3) THEN 'ok' ELSE 'no_business' END AS status,
    CASE WHEN n % 7 = 3 THEN NULL WHEN n % 9 = 8 THEN 'no answer' WHEN n % 5 = 4 THEN 'no array of days in the answer' END AS error,
    CASE WHEN n % 7 <> 3 AND n % 9 <> 8 AND n % 5 <> 4 AND n % 4 = 1 THEN 't' || n ELSE '' END AS topics FROM k""")
def note_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of all pair-days' notes, from a stand-in for the model; on some days nothing is left to ask."""
    rows = event_messages(spark, sf_dir).withColumn("content", F.when(F.dayofmonth("msg_time") % 7 == 3, " ").otherwise(F.col("content")))
    codes = _codes(spark).withColumn("code", F.upper("code"))
    _, notes, _ = plan.daily_notes(rows, codes, _stub_answers, s=Settings(batch_tokens=1))
    return notes.select("manager", "customer", "note_date", "status", "error", F.array_join("topics", ",").alias("topics"))


@query("SELECT user_id, CAST(floor(greatest(40 - user_id % 50, 0) * (CASE WHEN user_id % 3 = 0 THEN 1800.0 ELSE (user_id * 7) / greatest(user_id % 4, 1)::DOUBLE END) / (27000.0 / 60)) AS BIGINT) AS eta FROM (SELECT DISTINCT user_id FROM events WHERE user_id > 0)")
def run_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds that a run still takes, from made-up progress of users."""
    u = table(spark, sf_dir, "events").select("user_id").distinct().where("user_id > 0")
    tokens = F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id") * 7)
    return u.select("user_id", contacts.eta_seconds(40 - F.col("user_id") % 50, F.col("user_id") % 4, tokens).alias("eta"))


@query("""WITH o AS (SELECT user_id, max(event_id) AS event_id, count(*) AS n FROM events WHERE day(ts) <= 15 GROUP BY 1), w AS (SELECT user_id, max(event_id) AS event_id, count(*) AS n, user_id % 4 = 0 AS failed FROM events WHERE day(ts) > 15 GROUP BY 1)
SELECT coalesce(o.user_id, w.user_id) AS user_id, CASE WHEN w.user_id IS NULL OR (w.failed AND o.user_id IS NOT NULL) THEN o.event_id ELSE w.event_id END AS event_id, CASE WHEN w.user_id IS NULL THEN o.n ELSE w.n END AS n FROM o FULL JOIN w USING (user_id)""")
def patched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert in which a failed row changes its count alone."""
    e = table(spark, sf_dir, "events").withColumn("late", F.dayofmonth("ts") > 15)
    half = e.groupBy("user_id", "late").agg(F.max("event_id").alias("event_id"), F.count("*").alias("n"))
    return incremental.patched(half.where("NOT late").drop("late"), half.where("late").drop("late"), ["user_id"], F.col("user_id") % 4 == 0, ["n"])


@query(f"{DAYS} SELECT stat_date, count(*) AS pairs, CAST(sum(msg_count) AS BIGINT) AS messages, CASE WHEN count(*) FILTER (msg_count = 1) = 0 THEN 'success' WHEN count(*) FILTER (msg_count = 1) >= count(*) THEN 'failed' ELSE 'partial_success' END AS status, CAST(sum(msg_count * 100 // 3 + CASE WHEN customer % 3 = 0 THEN msg_count * 100 % 3 ELSE 0 END) AS BIGINT) AS tokens FROM st GROUP BY 1")
def run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, status and shared-out tokens of each day's run."""
    single = F.count_if(F.col("msg_count") == 1)
    share = contacts.split_tokens(F.col("msg_count") * 100, F.lit(3), F.col("customer") % 3)
    return _stats(spark, sf_dir).groupBy("stat_date").agg(F.count("*").alias("pairs"), F.sum("msg_count").alias("messages"), contacts.run_status(single, F.count("*")).alias("status"), F.sum(share).alias("tokens"))


@query()
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned and masked transcripts of pair-days, cut to a call's budget."""
    rows = event_messages(spark, sf_dir).withColumn("stat_date", F.to_date("msg_time"))
    lines = contacts.transcript_lines(rows, s=Settings())
    return contacts.fit_transcripts(lines, 60)


@query()
def note_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily notes as lines within a pair's budget, priority days last to go; their words and numbers of items vary by note."""
    n = _notes(spark, sf_dir).where("status = 'ok'")
    words = lambda salt, most: F.transform(F.sequence(F.lit(0), (F.pmod(F.xxhash64("note_id", F.lit(salt)), F.lit(most))).cast("int")), lambda k: F.concat(F.lit(salt), F.repeat(F.lit("x"), F.pmod(F.xxhash64("note_id", k), F.lit(9)).cast("int"))))
    none = F.array().cast("array<string>")
    some = F.when(F.col("note_id") % 3 == 0, none)
    rows = n.select("manager", "customer", "note_date", words("t", 3).alias("topics"), some.otherwise(words("p", 3)).alias("customer_points"), some.otherwise(none).alias("manager_actions"), words("f", 2).alias("facts"), (F.dayofmonth("note_date") % 5 == 0).alias("priority"))
    return contacts.fitted_notes(rows, 120)
