"""Contact records of manager-customer pairs: transcripts, notes, signals and window summaries."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.text import clip_line, collapse, estimate_tokens, evidence_key, json_object, let, mask_pii, numbers_in, period_label, without_space
from parley.functions.vectors import is_subset
from parley.settings import DEFAULTS, Settings

PAIR = ("manager", "customer")

# The signal codes in their order, as (category, group, [(code, name)]).
SIGNALS = (
    ("topic", "投资理财", [("INV_DEPOSIT", "关注存款"), ("INV_WEALTH", "关注理财"), ("INV_BOND", "关注债券"), ("INV_FUND", "关注基金"), ("INV_STOCK", "关注股票"), ("INV_PRIVATE", "关注私募"), ("INV_LIFE_INS", "关注寿险"), ("INV_CI_INS", "关注重疾险"), ("INV_ANNUITY", "关注年金险"), ("INV_FAMILY_TRUST", "关注家族信托"), ("INV_INS_TRUST", "关注保险金信托")]),
    ("topic", "资产配置", [("ALLOC_PRESERVE", "关注资产保全"), ("ALLOC_LIQUIDITY", "关注流动性"), ("ALLOC_DIVERSIFY", "关注分散投资")]),
    ("topic", "人生规划", [("LIFE_CHILD_EDU", "子女教育"), ("LIFE_STUDY_ABROAD", "出国留学"), ("LIFE_RETIREMENT", "养老规划"), ("LIFE_INHERITANCE", "财富传承")]),
    ("topic", "税务法律", [("LEGAL_TAX", "税务筹划"), ("LEGAL_MARRIAGE", "婚姻财产"), ("LEGAL_EQUITY", "企业股权")]),
    ("topic", "市场动态", [("MKT_STOCK", "关注股市"), ("MKT_RATE", "关注利率"), ("MKT_POLICY", "关注政策")]),
    ("need", "深层需求", [("NEED_RISK_AVERSE", "风险敏感型"), ("NEED_CHILD_CENTRIC", "子女中心型"), ("NEED_LEGACY_ANXIETY", "传承焦虑型"), ("NEED_CONTROL", "控制权偏好"), ("NEED_PRIVILEGE", "权益敏感型"), ("NEED_CONVENIENCE", "便捷优先型"), ("NEED_YIELD", "收益导向型")]),
    ("service", "经营信号", [("SVC_COMPETITOR", "他行比较"), ("SVC_COMPLAINT", "不满/投诉"), ("SVC_PURCHASE_INTENT", "明确购买意向")]),
)
# Words that a summary must not show, and the pattern of contact counts.
FORBIDDEN = ("系统", "笔记", "标签", "持续中", "仍在持续", "已确认", "证据", "客户特点", "业务内容")
CONTACT_COUNT = r"(?:沟通|联系|对话|发起)\s*[0-9零一二三四五六七八九十两百]+[余多]?\s*次|[0-9零一二三四五六七八九十两百]+[余多]?\s*次(?:沟通|联系|对话)"
SIGNAL_CODE = r"(?<![A-Za-z0-9])[A-Z]+_[A-Z_]+(?![A-Za-z0-9])"
# Fixed values: (days at most, least, most, aimed at) characters of a summary, by days with business.
LENGTHS = ((1, 50, 180, 150), (3, 80, 260, 220), (None, 100, 360, 300))


def signal_table(spark: SparkSession) -> DataFrame:
    """(ord, code, name, category, group)"""
    rows = [(code, name, category, group) for category, group, own in SIGNALS for code, name in own]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, code string, name string, category string, group string")


def transcript_lines(messages: DataFrame, chitchat: DataFrame | None = None, keys: Sequence[str] = (*PAIR, "stat_date"), s: Settings = DEFAULTS) -> DataFrame:
    """(keys…, line_no, line): each run of one speaker as a line "HH:MM 客：…", messages joined by slashes.

    White space is collapsed; empty lines and chitchat (word for word) go; the rest is masked and clipped.
    """
    rows = messages.withColumn("_body", collapse(F.col("content"))).where("_body != ''")
    if chitchat is not None:
        rows = rows.join(chitchat.select(F.col("word").alias("_word")).distinct(), F.col("_body") == F.col("_word"), "left_anti")
    rows = rows.withColumn("_body", clip_line(mask_pii(F.col("_body")), s.line_chars))
    runs = speaker_runs(rows, "from_customer", keys, ("msg_time", "id"))
    parts = F.array_sort(F.collect_list(F.struct("msg_time", "id", "_body")))
    lines = runs.groupBy(*keys, "run", "from_customer").agg(parts.alias("parts"))
    speaker = F.when(F.col("from_customer"), "客").otherwise("经")
    line = F.concat(F.date_format(F.col("parts")[0]["msg_time"], "HH:mm"), F.lit(" "), speaker, F.lit("："), F.array_join(F.transform("parts", lambda p: p["_body"]), " / "))
    return lines.select(*keys, F.col("run").alias("line_no"), line.alias("line"))


def speaker_runs(rows: DataFrame, speaker: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds run, from 1: it grows where the speaker changes."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.lag(speaker).over(w).eqNullSafe(F.col(speaker)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("_new", changed).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def fitted_lines(lines: DataFrame, cost: Column, budget: Column | int, used: Column | int = 0, keys: Sequence[str] = (*PAIR, "stat_date"), order: str = "line_no") -> DataFrame:
    """The leading lines of each key whose costs sum to the budget at most. As costs are positive, the first overflow ends it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    limit = F.lit(budget) if isinstance(budget, int) else budget
    start = F.lit(used) if isinstance(used, int) else used
    return lines.withColumn("_cost", cost).withColumn("used", start + F.sum("_cost").over(w)).where(F.col("used") <= limit).drop("_cost")


def fit_transcripts(lines: DataFrame, budget: int, keys: Sequence[str] = (*PAIR, "stat_date")) -> DataFrame:
    """Whole transcripts that fit; of others the leading lines and a mark that the rest was cut."""
    head = F.concat(F.lit("["), F.col("stat_date").cast("string"), F.lit("]"))
    texts = lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("_text"))
    whole = texts.where(estimate_tokens(F.concat(head, F.lit("\n"), F.col("_text"))) <= budget).select(*keys)
    cut = fitted_lines(lines.join(whole, list(keys), "left_anti"), estimate_tokens(F.col("line")) + 1, budget, estimate_tokens(head) + 20, keys).drop("used")
    late = lines.join(whole, list(keys), "left_anti").select(*keys).distinct().withColumn("line_no", F.lit((1 << 31) - 1).cast("long")).withColumn("line", F.lit("（当天记录过长，后续内容已截断）"))
    rows = lines.join(whole, list(keys)).unionByName(cut).unionByName(late.select(lines.columns))
    return rows


def packed_days(days: DataFrame, budget: int, keys: Sequence[str] = PAIR, order: str = "stat_date", cost: str = "tokens") -> DataFrame:
    """Adds batch: days of a pair in order share a batch until the budget is passed; a larger day has one of its own.

    A running sum that resets; folded over the pair's ordered days, of which a window has a few.
    """
    rows = F.array_sort(F.collect_list(F.struct(order, cost)))
    first = F.struct(F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        full = (a["used"] > 0) & (a["used"] + x[cost] > budget)
        batch = a["batch"] + F.when(full | (F.size(a["out"]) == 0), 1).otherwise(0)
        return F.struct(batch.alias("batch"), F.when(full, x[cost]).otherwise(a["used"] + x[cost]).alias("used"), F.array_append(a["out"], batch).alias("out"))

    folded = days.withColumn(cost, F.col(cost).cast("long")).groupBy(*keys).agg(rows.alias("rows"))
    folded = folded.select(*keys, "rows", F.aggregate("rows", first, step)["out"].alias("batches"))
    return folded.select(*keys, F.explode(F.arrays_zip("rows", "batches")).alias("x")).select(*keys, f"x.rows.{order}", f"x.rows.{cost}", F.col("x.batches").alias("batch"))


# Each part of an answer is read on its own, so that one that is not as it should be does not spoil the others.
ANSWER_SCHEMA = "days array<string>"
DAY_SCHEMA = "date string, topics array<string>, customer_points array<string>, manager_actions array<string>, facts array<string>, pending array<string>, signals array<string>"
SIGNAL_SCHEMA = "code string, status string, evidence string"
LIST_LIMITS = {"topics": 3, "customer_points": 3, "manager_actions": 2, "facts": 3, "pending": 3}  # fixed values


def answer_fault(answer: Column) -> Column:
    """Why an answer says nothing of its days; null where it has an array of days, an empty one too."""
    days = F.from_json(json_object(answer), ANSWER_SCHEMA)["days"]
    return F.when(answer.isNull(), "no answer").when(days.isNull(), "no array of days in the answer")


def parsed_notes(answers: DataFrame, transcripts: DataFrame, codes: DataFrame, s: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(notes, signals) of model answers (pair…, answer) against transcripts (pair…, stat_date, text).

    Only days that were asked for (in the same batch, if both have one), the first of each; items are collapsed, clipped
    and capped. Of a day's signals the known codes with status open or closed, the first of each code and so many at
    most; evidence is verified when its key is part of the transcript's key.
    """
    keys = list(PAIR)
    by = [*keys, "batch"] if "batch" in answers.columns and "batch" in transcripts.columns else keys
    days = answers.select(*by, F.posexplode(F.from_json(json_object(F.col("answer")), ANSWER_SCHEMA)["days"]).alias("no", "_raw"))
    days = days.withColumn("d", F.from_json("_raw", DAY_SCHEMA)).withColumn("_date", F.trim("d.date"))
    days = days.select(*by, "no", F.when(F.col("_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr("try_cast(_date as date)")).alias("stat_date"), "d")
    w = Window.partitionBy(*keys, "stat_date").orderBy("no")
    days = days.join(transcripts, [*by, "stat_date"]).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "no")

    def items(name: str) -> Column:
        clean = F.transform(F.coalesce(F.col(f"d.{name}"), F.array().cast("array<string>")), lambda v: F.substring(collapse(F.coalesce(v, F.lit(""))), 1, s.item_chars))
        return F.slice(F.filter(clean, lambda v: v != ""), 1, LIST_LIMITS[name]).alias(name)

    notes = days.select(*keys, "stat_date", *(items(c) for c in LIST_LIMITS))
    signals = days.select(*keys, "stat_date", "text", F.posexplode("d.signals").alias("no", "_raw")).withColumn("x", F.from_json("_raw", SIGNAL_SCHEMA))
    signals = signals.select(*keys, "stat_date", "text", "no", F.upper(F.trim("x.code")).alias("code"), F.lower(F.trim("x.status")).alias("status"), F.substring(F.regexp_replace(F.trim(F.coalesce("x.evidence", F.lit(""))), "^[“”\"'「」 ]+|[“”\"'「」 ]+$", ""), 1, s.evidence_chars).alias("evidence"))
    signals = signals.join(codes.select("code"), "code", "left_semi").where(F.col("status").isin("open", "closed"))
    first = Window.partitionBy(*keys, "stat_date", "code").orderBy("no")
    signals = signals.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    order = Window.partitionBy(*keys, "stat_date").orderBy("no")
    signals = signals.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= s.signals_per_day).drop("_n")
    key = evidence_key(F.col("evidence"))
    verified = (key != "") & F.contains(evidence_key(F.col("text")), key)
    return notes, signals.select(*keys, "stat_date", "no", "code", "status", "evidence", verified.alias("verified"))


def note_states(due: DataFrame, answers: DataFrame, notes: DataFrame, signals: DataFrame) -> DataFrame:
    """Adds status, error and the lists of a note to days that were due (pair…, stat_date, text, batch; text is null where nothing is left to ask).

    no_business: no line was left, or a valid answer has nothing on the day, named or not. failed: no valid answer.
    ok: an item or a known signal.
    """
    day = [*PAIR, "stat_date"]
    empty = F.array().cast("array<string>")
    said = answers.select(*PAIR, "batch", F.lit(True).alias("_said"), answer_fault(F.col("answer")).alias("_fault"))
    marked = signals.select(*day).distinct().withColumn("_signals", F.lit(True))
    rows = due.join(said, [*PAIR, "batch"], "left").join(notes, day, "left").join(marked, day, "left")
    fault = F.when(F.col("text").isNotNull(), F.when(F.col("_said").isNull(), "no answer").otherwise(F.col("_fault")))
    content = F.coalesce("_signals", F.lit(False))
    for c in LIST_LIMITS:
        content = content | (F.size(F.coalesce(c, empty)) > 0)
    status = F.when(fault.isNotNull(), "failed").when(content, "ok").otherwise("no_business")
    return rows.withColumns({"status": status, "error": fault, **{c: F.coalesce(c, empty) for c in LIST_LIMITS}}).drop("_said", "_fault", "_signals")


def signal_timeline(events: DataFrame, codes: DataFrame, keys: Sequence[str] = PAIR, s: Settings = DEFAULTS) -> DataFrame:
    """One row for each pair and known code: where it stands after its last event, since when, and on how many days it was open.

    ``events``: keys, event_id, code, status, event_date, evidence. A need counts as confirmed from two open days on.
    """
    rows = events.join(codes, "code")
    last = F.struct("event_date", "event_id")
    opened = F.when(F.col("status") == "open", F.col("event_date"))
    out = rows.groupBy(*keys, "code", "name", "category", "group", "ord").agg(
        F.max_by("status", last).alias("status"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"),
        F.countDistinct(opened).alias("open_days"), F.min(opened).alias("first_open_date"), F.max_by("evidence", last).alias("evidence"),
    )
    out = out.withColumn("confirmed", F.when(F.col("category") == "need", F.col("open_days") >= s.need_confirm_days))
    closed = F.col("status") == "closed"
    return out.withColumn("closed_date", F.when(closed, F.col("last_date"))).withColumn("first_open_date", F.when(closed, F.col("first_open_date")))


def open_signals(events: DataFrame, before: Column | None = None, keys: Sequence[str] = PAIR, s: Settings = DEFAULTS) -> DataFrame:
    """(keys…, code, since): codes opened after they were last closed, with the first such day.

    ``before``: only events of the look-back ahead of this day count.
    """
    if before is not None:
        events = events.where((F.col("event_date") >= F.date_sub(before, s.signal_lookback_days)) & (F.col("event_date") < before))
    at = F.struct("event_date", "event_id")
    closed = events.where("status = 'closed'").groupBy(*keys, "code").agg(F.max(at).alias("closed"))
    rows = events.where("status = 'open'").join(closed, [*keys, "code"], "left")
    return rows.where(F.col("closed").isNull() | (at > F.col("closed"))).groupBy(*keys, "code").agg(F.min("event_date").alias("since"))


def open_on_days(days: DataFrame, events: DataFrame, keys: Sequence[str] = PAIR, day: str = "stat_date", s: Settings = DEFAULTS) -> DataFrame:
    """(keys…, day, code, since): for each of many days the codes that are open ahead of it, from the look-back's events before it.

    A range join without a nested loop: time is cut into blocks as long as the look-back, and a day meets the events of
    the two blocks that its look-back reaches into. Events are summed up by day first, so a day of any size is a row.
    """
    size = s.signal_lookback_days
    of_day = lambda status: F.max(F.when(F.col("status") == status, F.col("event_id")))
    by_date = events.where(F.col("status").isin("open", "closed")).groupBy(*keys, "code", "event_date").agg(of_day("open").alias("_open"), of_day("closed").alias("_closed"))
    by_date = by_date.withColumn("_block", F.floor(F.unix_date("event_date") / size))
    reach = F.sequence(F.floor((F.unix_date(day) - size) / size), F.floor((F.unix_date(day) - 1) / size))
    wanted = days.select(*keys, day).distinct().withColumn("_block", F.explode(reach))
    met = wanted.join(by_date, [*keys, "_block"]).where((F.col("event_date") >= F.date_sub(day, size)) & (F.col("event_date") < F.col(day)))
    closed = F.max(F.when(F.col("_closed").isNotNull(), F.struct("event_date", F.col("_closed").alias("id"))))
    opened = F.collect_list(F.when(F.col("_open").isNotNull(), F.struct("event_date", F.col("_open").alias("id"))))  # a row a day of the look-back at most
    rows = met.groupBy(*keys, day, "code").agg(closed.alias("_last"), opened.alias("_opened"))
    late = F.filter("_opened", lambda x: F.col("_last").isNull() | (x > F.col("_last")))
    return rows.withColumn("since", F.array_min(F.transform(late, lambda x: x["event_date"]))).where("since IS NOT NULL").drop("_last", "_opened")


def with_notes(days: DataFrame, notes: DataFrame, keys: Sequence[str] = (*PAIR, "stat_date")) -> DataFrame:
    """All days (keys…), each with its note's status, fingerprint and prompt version as note_status, note_fp and note_version; null without one."""
    return days.join(notes.select(*keys, F.col("status").alias("note_status"), F.col("source_fp").alias("note_fp"), F.col("prompt_version").alias("note_version")), list(keys), "left")


def missing_days(stats: DataFrame, notes: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Days with messages that no finished note covers (status ok or no_business)."""
    done = notes.where(F.col("status").isin("ok", "no_business")).select(*keys, F.col("note_date").alias("stat_date"))
    return stats.select(*keys, "stat_date").distinct().join(done, [*keys, "stat_date"], "left_anti")


def requested(rows: DataFrame, wanted: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """The rows of the pairs that were asked for, each once however often it was."""
    return rows.join(wanted.select(*keys), list(keys), "left_semi")


def covering_jobs(jobs: DataFrame, requests: DataFrame, by: Sequence[str] = ("manager",)) -> DataFrame:
    """(by…, request, job): finished jobs whose customers include all that a request names; of several the first one.

    ``jobs``: by…, job, customers; ``requests``: by…, request, customers (arrays).
    """
    met = requests.withColumnRenamed("customers", "_wanted").join(jobs.withColumnRenamed("customers", "_done"), list(by))
    return met.where(is_subset(F.col("_wanted"), F.col("_done"))).groupBy(*by, "request").agg(F.min("job").alias("job"))


def dates_to_run(wanted: DataFrame, covered: DataFrame, stale: DataFrame) -> DataFrame:
    """(wanted - covered) and all that is stale; each of one date column."""
    return wanted.select("stat_date").exceptAll(covered.select("stat_date").distinct()).union(stale.select("stat_date")).distinct()


def reusable(days: DataFrame, notes: DataFrame, prompt_version: str, keys: Sequence[str] = (*PAIR, "stat_date")) -> DataFrame:
    """Adds reused: an equal fingerprint was finished under the same prompt version."""
    ok = F.col("note_status").isin("ok", "no_business") & (F.col("note_fp") == F.col("source_fp")) & (F.col("note_version") == prompt_version)
    return with_notes(days, notes, keys).withColumn("reused", F.coalesce(ok, F.lit(False))).drop("note_status", "note_fp", "note_version")


def note_list(stats: DataFrame, notes: DataFrame, events: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Notes with their day's statistics and their events in order of id as an array of structs."""
    each = events.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "code", "status", "evidence"))).alias("signals"))
    days = stats.select(*keys, F.col("stat_date").alias("note_date"), "msg_count", "session_count")
    return notes.join(days, [*keys, "note_date"], "left").join(each, "note_id", "left").withColumn("signals", F.coalesce("signals", F.array().cast("array<struct<event_id:bigint,code:string,status:string,evidence:string>>")))


def signal_list(events: DataFrame, notes: DataFrame) -> DataFrame:
    """Verified events of finished notes."""
    return events.where("verified").join(notes.where("status = 'ok'").select("note_id"), "note_id")


def paged(rows: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def note_line(compact: Column) -> Column:
    """A note as one line; compact: only its day and topics."""
    topics = F.when(F.size("topics") > 0, F.concat(F.lit("话题："), F.array_join("topics", "、")))
    more = [F.when((F.size(c) > 0) & ~compact, F.concat(F.lit(f"{label}："), F.array_join(c, "；"))) for label, c in (("客户", "customer_points"), ("经理", "manager_actions"), ("事实", "facts"))]
    return F.concat_ws("｜", F.date_format("note_date", "MM-dd"), topics, *more)


def fitted_notes(notes: DataFrame, budget: int = DEFAULTS.notes_budget, keys: Sequence[str] = PAIR) -> DataFrame:
    """(keys…, note_date, line) of notes with a priority mark, within the budget of tokens for each pair.

    Beyond it, days without priority shrink to their topics; then they go, oldest first, and after them the oldest
    days with priority, but never the last of these.
    """
    rows = notes.withColumn("_full", note_line(F.lit(False))).withColumn("_short", note_line(~F.col("priority")))
    cost = {c: estimate_tokens(F.col(c)) + 1 for c in ("_full", "_short")}
    pair = Window.partitionBy(*keys)
    rows = rows.withColumn("_fits", F.sum(cost["_full"]).over(pair) <= budget).withColumn("_cost", cost["_short"])
    last = F.row_number().over(Window.partitionBy(*keys, "priority").orderBy(F.desc("note_date"))) == 1
    rows = rows.withColumn("_stays", F.col("priority") & last)
    # What remains when all that goes before a note, in the order of going, has gone: it goes too if that is still too much.
    going = Window.partitionBy(*keys).orderBy("_stays", "priority", "note_date").rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("_left", F.sum("_cost").over(going))
    kept = rows.where(F.col("_fits") | F.col("_stays") | (F.col("_left") <= budget))
    return kept.select(*keys, "note_date", F.when(F.col("_fits"), F.col("_full")).otherwise(F.col("_short")).alias("line"))


def summary_faults(summary: Column, source: Column, business_days: Column, strict: bool = True) -> Column:
    """Names of the rules that a summary breaks, as an array; empty when it may be shown."""
    low, high = (F.when(business_days <= LENGTHS[0][0], LENGTHS[0][k]).when(business_days <= LENGTHS[1][0], LENGTHS[1][k]).otherwise(LENGTHS[2][k]) for k in (1, 2))
    high = high if strict else F.floor(high * 1.5)

    def unknown(found: Column) -> Column:
        missing = let(without_space(F.coalesce(source, F.lit(""))), lambda known: F.exists(found, lambda n: ~F.contains(known, n)))
        return F.when(F.size(found) > 0, missing).otherwise(F.lit(False))

    def broken(text: Column) -> Column:
        forbidden = F.lit(False)
        for word in FORBIDDEN:
            forbidden = forbidden | F.contains(text, F.lit(word))
        # a plain search for what every match has goes before the slower patterns
        rules = [
            ("empty", text == ""), ("contact count", F.contains(text, F.lit("次")) & text.rlike(CONTACT_COUNT)), ("too long", F.length(text) > high), ("too short", (text != "") & (F.length(text) < low)),
            ("unknown number", let(F.array_distinct(numbers_in(text)), unknown)), ("personal data", mask_pii(text) != text), ("internal term", forbidden | (F.contains(text, F.lit("_")) & text.rlike(SIGNAL_CODE))),
        ]
        return F.array_compact(F.array(*(F.when(found, F.lit(name)) for name, found in rules)))

    return let(collapse(F.coalesce(summary, F.lit(""))), broken)


def signal_line() -> Column:
    """A timeline row as the line that a summary is written from."""
    label = F.when(F.col("category") == "topic", F.concat("name", F.lit("（"), "group", F.lit("）"))).otherwise(F.col("name"))
    evidence = F.concat(F.lit("依据：“"), F.coalesce("evidence", F.lit("")), F.lit("”"))
    days = F.col("open_days").cast("string")
    since = F.when(F.col("first_open_date").isNotNull(), F.concat(period_label(F.col("first_open_date")), F.lit("出现 → "))).otherwise("")
    closed = F.concat(F.lit("已关闭；"), since, period_label(F.col("last_date")), F.lit("关闭，"), evidence)
    times = F.when(F.col("confirmed"), F.concat(F.lit("多次出现（"), days, F.lit("天）"))).otherwise(F.concat(F.lit("仅出现"), days, F.lit("天")))
    first, last = period_label(F.col("first_date")), period_label(F.col("last_date"))
    need = F.concat(times, F.lit("；"), first, F.lit("起，最近"), last, F.lit("；"), evidence)
    other = F.concat(first, F.lit("起，共"), days, F.lit("天，最近"), last, F.lit("；"), evidence)
    return F.concat(F.lit("- "), label, F.lit("："), F.when(F.col("status") == "closed", closed).when(F.col("category") == "need", need).otherwise(other))


def run_status(failed: Column, total: Column) -> Column:
    return F.when(failed == 0, "success").when(failed >= total, "failed").otherwise("partial_success")


def eta_seconds(remaining: Column, called: Column, tokens: Column, per_minute: float = 27_000, assumed: float = 1800) -> Column:
    """Remaining customers times the mean tokens of those that needed a call (or an assumed number), over the token rate."""
    mean = F.when(tokens > 0, tokens / F.greatest(called, F.lit(1))).otherwise(F.lit(assumed))
    return F.floor(F.greatest(remaining, F.lit(0)) * mean / (per_minute / 60)).cast("long")


def split_tokens(total: Column, parts: Column, number: Column) -> Column:
    """A call's tokens over the days it covered: equal shares, and what is over to the first (number 0)."""
    share = F.floor(total / parts).cast("long")
    return share + F.when(number == 0, total % parts).otherwise(F.lit(0))


CALL = "struct<status:string,attempts:bigint,tokens:bigint,error:string>"


def provider_answers(prompts: DataFrame, provider, columns: str = "answer string", calls: bool = False) -> DataFrame:
    """Adds the answers of a model: ``provider`` maps a list of prompts to a list of texts, a batch at a time on the executors.

    ``calls``: adds ``call``, what a provider with a log (providers.Asked) noted on the way to each answer; else null.
    """
    schema = T.StructType([*prompts.schema.fields, *T._parse_datatype_string(columns).fields, *([T.StructField("call", T._parse_datatype_string(CALL))] if calls else [])])
    name = columns.split()[0]

    def run(batches):
        for batch in batches:
            had = len(getattr(provider, "log", ()))
            batch = batch.assign(**{name: pd.Series(provider(batch["prompt"].tolist()), index=batch.index, dtype=object)})
            if calls:
                noted = [{k: r.get(k) for k in ("status", "attempts", "tokens", "error")} for r in getattr(provider, "log", ())[had:]] or [None] * len(batch)
                batch = batch.assign(call=pd.Series(noted, index=batch.index, dtype=object))
            yield batch

    return prompts.mapInPandas(run, schema)
