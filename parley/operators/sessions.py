"""Sessions, pair-day statistics and windows over the message log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import mask_pii, strip
from parley.settings import DEFAULTS, Settings


def is_customer(user: Column, s: Settings = DEFAULTS) -> Column:
    """The id starts with one of the customer prefixes, case as it is."""
    out = F.lit(False)
    for prefix in s.customer_prefixes:
        out = out | user.startswith(prefix)
    return out


def pair_messages(log: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Messages of which exactly one side is a customer, as (id, manager, customer, from_customer, content, msg_time)."""
    sent, got = is_customer(F.col("from_user"), s), is_customer(F.col("to_user"), s)
    customer, manager = (F.when(sent, F.col(a)).otherwise(F.col(b)) for a, b in (("from_user", "to_user"), ("to_user", "from_user")))
    return log.where(sent != got).select("id", manager.alias("manager"), customer.alias("customer"), sent.alias("from_customer"), F.coalesce("content", F.lit("")).alias("content"), "msg_time")


def keep_messages(messages: DataFrame, chitchat: DataFrame | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """Text messages long enough after stripping that are not chitchat word for word (``chitchat``: column word, a bounded lexicon)."""
    kept = messages.where((F.col("msg_type") == "text") & (F.length(strip(F.col("content"))) >= s.min_text_len))
    if chitchat is None:
        return kept
    return kept.join(chitchat.select(F.col("word").alias("_word")).distinct(), strip(F.col("content")) == F.col("_word"), "left_anti")


def sessionize(messages: DataFrame, keys: Sequence[str], time: str = "msg_time", order: Sequence[str] = ("id",), s: Settings = DEFAULTS) -> DataFrame:
    """Adds session_seq, from 0 for each key: a message more than the gap after the one before begins a new session.

    One exchange on the keys; a key's messages are sorted and streamed, not held.
    """
    w = Window.partitionBy(*keys).orderBy(time, *order)
    gap = F.col(time) - F.lag(time).over(w) > F.expr(f"INTERVAL {s.session_gap_minutes} MINUTES")
    marked = messages.withColumn("_new", F.when(gap, 1).otherwise(0))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("session_seq", F.sum("_new").over(running)).drop("_new")


def aggregate_sessions(messages: DataFrame, keys: Sequence[str], time: str = "msg_time", order: Sequence[str] = ("id",), content: str | None = "content") -> DataFrame:
    """One row a session: its id (keys and number joined by colons), count, and masked text in message order with its MD5."""
    aggs = [F.count("*").alias("msg_count"), F.min(time).alias("started"), F.max(time).alias("ended")]
    if content:
        lines = F.array_sort(F.collect_list(F.struct(time, *order, content)))
        aggs.append(F.array_join(F.transform(lines, lambda x: x[content]), " ").alias("text"))
    out = messages.groupBy(*keys, "session_seq").agg(*aggs)
    out = out.withColumn("session_id", F.concat_ws(":", *(F.col(k).cast("string") for k in keys), F.col("session_seq").cast("string")))
    if content:
        out = out.withColumn("text", mask_pii(F.col("text"))).withColumn("text_hash", F.md5("text"))
    return out


def day_stats(messages: DataFrame, keys: Sequence[str] = ("manager", "customer"), s: Settings = DEFAULTS, before: DataFrame | None = None) -> DataFrame:
    """One row for each pair and day. A session that began the day before is not counted, nor who began it.

    Only the calendar day before carries a session over, as a gap of minutes implies. Where ``messages`` begin with a
    day, ``before`` (keys, last_msg_time: stored statistics of earlier days) says when each pair last spoke.
    source_fp: SHA-256 of the day's lines, each its time in microseconds, id, side and the MD5 of its content.
    """
    if before is not None:
        last = before.groupBy(*keys).agg(F.max("last_msg_time").alias("_before"))
        messages = messages.join(last, list(keys), "left")
    w = Window.partitionBy(*keys).orderBy("msg_time", "id")
    previous = F.lag("msg_time").over(w)
    if before is not None:
        previous = F.coalesce(previous, F.when(F.col("_before") <= F.col("msg_time"), F.col("_before")))
    begins = previous.isNull() | (F.col("msg_time") - previous > F.expr(f"INTERVAL {s.session_gap_minutes} MINUTES"))
    marked = messages.withColumn("_begins", begins).withColumn("stat_date", F.to_date("msg_time"))
    line = F.concat_ws(":", F.unix_micros(F.col("msg_time").cast("timestamp")).cast("string"), F.col("id").cast("string"), F.col("from_customer").cast("int").cast("string"), F.md5("content"))
    lines = F.array_sort(F.collect_list(F.struct("msg_time", "id", line.alias("line"))))
    return marked.groupBy(*keys, "stat_date").agg(
        F.count("*").alias("msg_count"),
        F.count_if("from_customer").alias("customer_msg_count"),
        F.count_if(~F.col("from_customer")).alias("manager_msg_count"),
        F.count_if("_begins").alias("session_count"),
        F.count_if(F.col("_begins") & F.col("from_customer")).alias("customer_initiated"),
        F.min("msg_time").alias("first_msg_time"),
        F.max("msg_time").alias("last_msg_time"),
        F.sha2(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), 256).alias("source_fp"),
    )


def window_stats(stats: DataFrame, end: str | Column, keys: Sequence[str] = ("manager", "customer"), s: Settings = DEFAULTS) -> DataFrame:
    """Sums of day statistics over the ``window_days`` that end with ``end``."""
    end = F.to_date(F.lit(end)) if isinstance(end, str) else end
    inside = stats.where(F.col("stat_date").between(F.date_sub(end, s.window_days - 1), end))
    return inside.groupBy(*keys).agg(
        F.sum("session_count").alias("session_count"),
        F.sum("customer_initiated").alias("customer_initiated"),
        F.count("*").alias("active_days"),
        F.sum("msg_count").alias("msg_count"),
        F.to_date(F.max("last_msg_time")).alias("last_contact"),
    )


def trailing_load(calls: DataFrame, keys: Sequence[str], time: str, weight: Column, call_seconds: float, weight_seconds: float) -> DataFrame:
    """Adds calls_in_window and weight_in_window: what a sliding-window limiter would have counted at each call."""
    micros = F.unix_micros(time)

    def over(seconds: float):
        return Window.partitionBy(*keys).orderBy("_at").rangeBetween(-int(seconds * 1_000_000), 0)

    return calls.withColumn("_at", micros).withColumn("calls_in_window", F.count("*").over(over(call_seconds))).withColumn("weight_in_window", F.sum(weight).over(over(weight_seconds))).drop("_at")
