"""The contact plan: statistics, daily notes from a model, and window summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.text import estimate_tokens, period_label, window_label
from parley.operators import contacts, sessions
from parley.settings import DEFAULTS, Settings
from parley.sources import work

Provider = Callable[[list[str]], list[str]]


def daily_notes(
    messages: DataFrame, codes: DataFrame, provider: Provider, stored: DataFrame | None = None, prompt_version: str = "1", chitchat: DataFrame | None = None, before: DataFrame | None = None,
    write: Callable[[DataFrame], DataFrame] | None = None, events: DataFrame | None = None, calls: Callable[[DataFrame], None] | None = None, s: Settings = DEFAULTS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(statistics, notes, signals) of pair messages. Days whose fingerprint is stored are not asked again.

    A day without lines after cleaning is no_business. The rest is packed into prompts by a budget of tokens; a prompt
    begins with the pair's signals that are open ahead of its first day, from ``events`` (verified ones of finished
    notes: pair…, event_id, code, status, event_date). ``before``: stored statistics of earlier days, for sessions that
    cross midnight. ``write`` stores what was due and the model's answers and reads them again (Store.written; by default
    in the shared folder), so that a lost executor never makes the model answer anew and differently. ``calls`` gets one row for each prompt: pair, batch, days and what
    the provider noted of the call. Store.save_notes() keeps the results.
    """
    write = write or work.written
    keys = list(contacts.PAIR)
    day = [*keys, "stat_date"]
    stats = sessions.day_stats(messages, s=s, before=before)
    rows = messages.withColumn("stat_date", F.to_date("msg_time"))
    lines = contacts.fit_transcripts(contacts.transcript_lines(rows, chitchat, s=s), s.call_tokens)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    transcripts = lines.groupBy(*day).agg(text.alias("text"))
    if stored is None:
        wanted = stats.select(*day, "source_fp")
    else:
        wanted = contacts.reusable(stats, stored.withColumnRenamed("note_date", "stat_date"), prompt_version).where("NOT reused").select(*day, "source_fp")
    due = write(wanted.join(transcripts, day, "left"))
    asked = due.where("text IS NOT NULL").withColumn("tokens", estimate_tokens(F.concat(F.lit("[2000-01-01]\n"), F.col("text"))))
    batches = contacts.packed_days(asked, s.batch_tokens).drop("tokens")
    due = write(due.join(batches, day, "left"))
    asked = due.where("batch IS NOT NULL")
    one = F.concat(F.lit("["), F.col("stat_date").cast("string"), F.lit("]\n"), F.col("text"))
    days = F.array_sort(F.collect_list(F.struct("stat_date", one.alias("p"))))
    prompts = asked.groupBy(*keys, "batch").agg(F.min("stat_date").alias("stat_date"), F.count("*").alias("days"), F.array_join(F.transform(days, lambda x: x["p"]), "\n\n").alias("prompt"))
    if events is not None:
        line = F.concat(F.lit("- "), "code", F.lit(" ("), F.date_format("since", "MM-dd"), F.lit(")"))
        known = contacts.open_on_days(prompts, events, s=s).join(codes.select("code"), "code", "left_semi")
        known = known.groupBy(*day).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("since", "code", line.alias("l")))), lambda x: x["l"]), "\n").alias("_open"))
        prompts = prompts.join(known, day, "left").withColumn("prompt", F.concat(F.lit("open signals:\n"), F.coalesce("_open", F.lit("none")), F.lit("\n\n"), "prompt")).drop("_open")
    answers = write(contacts.provider_answers(prompts, provider, calls=calls is not None))
    if calls is not None:
        calls(answers.select(*keys, "batch", "days", F.length("prompt").alias("prompt_chars"), "call.*"))
    notes, signals = contacts.parsed_notes(answers, asked.select(*day, "batch", "text"), codes, s)
    found = contacts.note_states(due, answers, notes, signals)
    found = found.select(F.concat_ws(":", *day).alias("note_id"), *keys, F.col("stat_date").alias("note_date"), "status", "source_fp", F.lit(prompt_version).alias("prompt_version"), *contacts.LIST_LIMITS, "error")
    return stats, found, signals.withColumn("note_id", F.concat_ws(":", *day))


def contact_summaries(stats: DataFrame, notes: DataFrame, signals: DataFrame, codes: DataFrame, end: str, provider: Provider | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """One row for each pair in the window: sums, days without notes, timeline, prompt and its fingerprint, and the summary.

    Pairs without business get the fixed sentence; others what ``provider`` makes of the prompt, if it passes the
    rules (status success, else review).
    """
    keys = list(contacts.PAIR)
    last = F.to_date(F.lit(end))
    inside = lambda c: F.col(c).between(F.date_sub(last, s.window_days - 1), last)
    window = sessions.window_stats(stats, end, s=s)
    own = notes.where(inside("note_date"))
    ok = own.where("status = 'ok'")
    business = ok.groupBy(*keys).agg(F.count("*").alias("business_days"))
    missing = contacts.missing_days(stats.where(inside("stat_date")), own).groupBy(*keys).agg(F.count("*").alias("incomplete_days"))
    events = signals.where("verified").join(ok.select("note_id"), "note_id").where(inside("stat_date"))
    events = events.select(*keys, F.concat_ws(":", "note_id", F.lpad(F.col("no").cast("string"), 4, "0")).alias("event_id"), "code", "status", F.col("stat_date").alias("event_date"), "evidence")
    timeline = contacts.signal_timeline(events, codes, s=s).withColumn("line", contacts.signal_line())
    section = F.struct(F.when(F.col("category") == "topic", 1).when(F.col("category") == "need", 2).otherwise(3).alias("s"), "ord", "line")
    lines = timeline.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(section)), lambda x: x["line"]).alias("signal_lines"))
    pending = ok.select(*keys, "note_date", F.posexplode("pending").alias("k", "item"))
    pending = pending.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("note_date", "k", F.concat(F.lit("- "), period_label(F.col("note_date")), F.lit("："), "item").alias("p")))), lambda x: x["p"]).alias("pending_lines"))
    marked = ok.join(events.select(*keys, F.col("event_date").alias("note_date"), F.lit(True).alias("_e")).distinct(), [*keys, "note_date"], "left")
    marked = marked.withColumn("priority", F.coalesce("_e", F.lit(False)) | (F.size("facts") > 0) | (F.size("pending") > 0)).drop("_e")
    days = contacts.fitted_notes(marked, s.notes_budget)
    days = days.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("note_date", "line"))), lambda x: x["line"]).alias("note_lines"))
    out = window
    for part in (business, missing, lines, pending, days):
        out = out.join(part, keys, "left")
    out = out.fillna(0, ["business_days", "incomplete_days"])

    def block(title: str, c: str):
        return F.concat(F.lit(f"【{title}】\n"), F.coalesce(F.array_join(c, "\n"), F.lit("无")))

    start = F.date_sub(last, s.window_days - 1).cast("string")
    head = F.concat(F.lit("统计窗口："), start, F.lit(f" ～ {end}（{window_label(s.window_days)}）"))
    out = out.withColumn("prompt", F.concat_ws("\n\n", head, block("客户标签", "signal_lines"), block("待跟进", "pending_lines"), block("每日笔记", "note_lines")))
    out = out.withColumn("input_fp", F.sha2("prompt", 256))
    fixed = F.lit(f"{window_label(s.window_days)}与客户的沟通以日常问候为主，暂未涉及业务诉求。")
    none = F.col("business_days") == 0
    if provider is None:
        return out.withColumn("summary", F.when(none, fixed)).withColumn("status", F.when(none, "template").otherwise("pending"))
    answered = contacts.provider_answers(out.where(~none), provider, "summary string")
    faults = contacts.summary_faults(F.col("summary"), F.col("prompt"), F.col("business_days"))
    answered = answered.withColumn("status", F.when(F.size(faults) == 0, "success").otherwise("review"))
    return out.where(none).withColumn("summary", fixed).withColumn("status", F.lit("template")).unionByName(answered)


def summary_list(summaries: DataFrame, status: str | None = None, order: str = "last_contact", page: int = 1, size: int = 20, signal: str | None = None, signal_status: str | None = None) -> DataFrame:
    """A page of summaries: the latest first, or the most sessions, or (signal_change) those with a closed signal.

    ``signal`` keeps those that have the signal (in ``signals``: array of code and status), in ``signal_status`` if given.
    """
    rows = summaries if status is None else summaries.where(F.col("status") == status)
    if signal is not None:
        rows = rows.where(F.exists("signals", lambda x: (x["code"] == signal) & (F.lit(signal_status is None) | (x["status"] == (signal_status or "")))))
    by = {"session_count": [F.desc("session_count")], "signal_change": [F.desc(F.coalesce(F.exists("signals", lambda x: x["status"] == "closed"), F.lit(False)))]}.get(order, []) if order != "last_contact" else []
    return contacts.paged(rows, [*by, F.desc("last_contact"), F.col("manager"), F.col("customer")], page, size)


def summary_detail(summaries: DataFrame, manager: str, customer: str) -> DataFrame:
    """One pair's summary."""
    return summaries.where((F.col("manager") == manager) & (F.col("customer") == customer))
