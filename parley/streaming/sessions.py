"""Sessions over a stream of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.settings import DEFAULTS, Settings


def streaming_sessions(messages: DataFrame, keys: list[str], time: str = "msg_time", watermark: str = "1 hour", s: Settings = DEFAULTS) -> DataFrame:
    """(keys…, started, ended, msg_count) of sessions that the watermark has closed; append mode.

    A native session window merges messages in the state store. It ends a session at a gap of exactly the limit,
    which the batch operator continues, so the window is a microsecond longer.
    """
    gap = f"{s.session_gap_minutes * 60_000_000 + 1} microseconds"
    rows = messages.withWatermark(time, watermark)
    out = rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("msg_count"), F.min(time).alias("started"), F.max(time).alias("ended"))
    return out.select(*keys, "started", "ended", "msg_count")


def upsert_stream(stream: DataFrame, write, checkpoint: str):
    """Runs what is there through ``write(batch, id)``, which must replace by key as batches may come again."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
