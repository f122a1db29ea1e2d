"""Queries that replay a table as a stream; the rows must be those of the batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.plans.contact_queries import EVENTS, signal_events
from parley.plans.hotspot_queries import SESSIONS
from parley.plans.registry import query
from parley.sources.readers import event_messages
from parley.streaming import state


def _third(time: Column, number: Column) -> Column:
    """Which of three parts of the month a row comes with: up to half a day later than its time says, so the parts overlap."""
    comes = time.cast("timestamp") + F.make_dt_interval(mins=F.pmod(F.xxhash64(number), F.lit(720)).cast("int"))
    return F.when(comes < "2024-01-11", 0).when(comes < "2024-01-21", 1).otherwise(2)


@query(f"{SESSIONS} SELECT topic_id, customer, session_seq, msg_count, started, ended, topic_id || ':' || customer || ':' || session_seq AS session_id FROM ses")
def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions of gap_sessions, from three micro-batches with state kept between them."""
    keys = ["topic_id", "customer"]
    rows = event_messages(spark, sf_dir).where("from_customer").select(*keys, "msg_time", "id")
    changes = state.replayed(rows, _third(F.col("msg_time"), F.col("id")), 3, lambda stream: state.session_changes(stream, keys))
    return state.current_sessions(changes, keys, rows.schema["msg_time"].dataType.simpleString())


@query(f"WITH {EVENTS}, cl AS (SELECT manager, customer, code, max(epoch(event_date) * 1000000 + event_id) AS closed_at FROM ev WHERE status = 'closed' GROUP BY 1, 2, 3) SELECT manager, customer, code, min(event_date) AS since FROM ev LEFT JOIN cl USING (manager, customer, code) WHERE status = 'open' AND (closed_at IS NULL OR epoch(event_date) * 1000000 + event_id > closed_at) GROUP BY 1, 2, 3")
def streamed_open_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signals of open_signals, from three micro-batches with state kept between them."""
    keys = ["manager", "customer"]
    rows = signal_events(spark, sf_dir).select(*keys, "event_id", "code", "status", "event_date")
    changes = state.replayed(rows, _third(F.col("event_date"), F.col("event_id")), 3, lambda stream: state.signal_changes(stream, keys, "2 days"))
    return state.current_signals(changes, keys)
