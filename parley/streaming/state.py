"""Sessions and open signals of a stream, kept by key in the state store, equal to the batch operators' rows.

Each micro-batch changes what it touches: a key's state takes the new rows, in whatever order they come, and gives the
key's rows that may have changed. These changes are appended by batch to a table (a batch that comes again replaces
its own part), and current_sessions() and current_signals() read the rows that hold now from it. So nothing waits for
the watermark to be seen, and the last rows need no closing message.

Keys are kept in buckets by hash, an entry of the state each, and a call works on all keys of a bucket at once: a call
for each key costs Python ten milliseconds, and what a task's calls leave is held until some rows come out, which at
millions of keys filled the workers. A worker holds a bucket's part of a micro-batch and of the state; the first run
fixes the number of buckets for good.

The state is bounded by timers. Sessions that the watermark has passed by more than the gap are only counted from then
on; signals opened longer ago than the look-back are dropped; a key without anything of that age is forgotten. Rows
later than the watermark are left out, as Spark does it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parley.operators.incremental import read_if_there
from parley.settings import DEFAULTS, Settings
from parley.sources.work import new_folder

DAY = 86_400_000_000  # microseconds

BUCKETS = 512

_STATE = "named binary, parts binary"
_SESSION_ROWS = "generation long, base long, session_seq long, msg_count long, started long, ended long"
_SIGNAL_ROWS = "code string, since int"


def _bucketed(rows: DataFrame, keys: Sequence[str], buckets: int, *columns: str | Column) -> DataFrame:
    """(_bucket, keys… as strings, so that pandas keeps nulls and long numbers apart, columns…)"""
    return rows.select(F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket"), *(F.col(k).cast("string").alias(k) for k in keys), *columns)


def _by_bucket(rows: DataFrame, run: Callable, keys: Sequence[str], kinds: T.StructType, columns: str) -> DataFrame:
    """What ``run`` gives of each bucket, with the keys in the types of ``kinds``."""
    own = T._parse_datatype_string(columns).fields
    schema = T.StructType([*(T.StructField(k, T.StringType()) for k in keys), *own])
    out = rows.groupBy("_bucket").applyInPandasWithState(run, schema, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return out.select(*(F.col(k).cast(kinds[k].dataType).alias(k) for k in keys), *(f.name for f in own))


def _bytes(rows: pd.DataFrame, names: Sequence[str] = ()) -> bytes:
    """``rows`` as an Arrow stream; the columns ``names`` hold strings, the others whole numbers."""
    table = pa.table({c: pa.array(rows[c], pa.string() if c in names else pa.int64(), from_pandas=True) for c in rows.columns})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _frames(state: GroupState, named: Sequence[str], columns: Sequence[str], parts: Sequence[str]) -> tuple[pd.DataFrame, pd.DataFrame]:
    """What a bucket's state holds: a row for each owner (its names as objects, numbers) and the parts that belong to owners, by row number."""
    if state.exists:
        held, owned = (pa.ipc.open_stream(bytes(x)).read_all().to_pandas() for x in state.get)
        return held.astype(dict.fromkeys(named, object)), owned
    return pd.DataFrame({**{k: np.empty(0, object) for k in named}, **{c: np.empty(0, np.int64) for c in columns}}), pd.DataFrame({c: np.empty(0, np.int64) for c in parts})


def _numbered(held: pd.DataFrame, rows: pd.DataFrame, names: Sequence[str], **fresh: int) -> tuple[pd.DataFrame, np.ndarray]:
    """``held`` with the owners that only ``rows`` has after it, and the row number of each row's owner."""
    names = list(names)
    both = pd.concat([held[names], rows[names].astype(object)], ignore_index=True)
    ids = both.groupby(names, dropna=False, sort=False).ngroup().to_numpy(np.int64)  # in order of first sight: held ones keep their number
    more = both[len(held) :][~pd.Series(ids[len(held) :]).duplicated().to_numpy() & (ids[len(held) :] >= len(held))]
    return pd.concat([held, more.assign(**{c: np.full(len(more), v, np.int64) for c, v in fresh.items()})], ignore_index=True), ids[len(held) :]


def _kept(held: pd.DataFrame, parts: pd.DataFrame, keep: np.ndarray) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The owners to keep, and the parts (all of them theirs) under the new row numbers."""
    return held[keep], parts.assign(owner=(np.cumsum(keep) - 1)[parts["owner"].to_numpy()])


def _pieces(owner: np.ndarray, started: np.ndarray, ended: np.ndarray, counted: np.ndarray, gap: int) -> pd.DataFrame:
    """merged_sessions() of many owners at once, by owner and start."""
    order = np.lexsort((started, owner))
    owner, started, ended, counted = owner[order], started[order], ended[order], counted[order]
    reach = pd.Series(ended).groupby(owner, sort=False).cummax().to_numpy()
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (started[1:] - reach[:-1] > gap)])) if len(owner) else np.empty(0, np.int64)
    if not len(first):
        return pd.DataFrame({"owner": owner, "started": started, "ended": ended, "counted": counted})
    return pd.DataFrame({"owner": owner[first], "started": started[first], "ended": np.maximum.reduceat(ended, first), "counted": np.add.reduceat(counted, first)})


def merged_sessions(started: np.ndarray, ended: np.ndarray, counted: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sessions from pieces of sessions (single messages are pieces too): a piece more than the gap after all before it begins a new one."""
    out = _pieces(np.zeros(len(started), np.int64), started, ended, counted, gap)
    return out["started"].to_numpy(), out["ended"].to_numpy(), out["counted"].to_numpy()


def _later(state: GroupState, at: int) -> None:
    """Wakes the bucket when the watermark passes ``at`` (microseconds); timers must lie ahead of it."""
    state.setTimeoutTimestamp(max(-(-at // 1000) + 1, state.getCurrentWatermarkMs() + 1))


def _sessions_of(keys: list[str], gap: int, ttl: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs() * 1000
        held, parts = _frames(state, keys, ["generation", "closed", "last"], ["owner", "started", "ended", "counted"])
        changed = np.zeros(len(held), bool)
        for rows in [] if state.hasTimedOut else batches:
            if len(rows):
                at = rows["at"].to_numpy(np.int64)
                held, ids = _numbered(held, rows, keys, generation=mark, closed=0, last=0)
                last = held["last"].to_numpy(np.int64, copy=True)
                np.maximum.at(last, ids, at)
                held["last"] = last
                changed = np.concatenate([changed, np.zeros(len(held) - len(changed), bool)])
                changed[ids] = True
                more = (ids, at, at, np.ones(len(at), np.int64))
                parts = _pieces(*(np.concatenate([parts[c].to_numpy(), x]) for c, x in zip(parts.columns, more, strict=True)), gap)
        owner = parts["owner"].to_numpy()
        now = parts[changed[owner]]
        if len(now):
            whose = held.iloc[now["owner"].to_numpy()]
            base = whose["closed"].to_numpy()
            yield pd.DataFrame({**{k: whose[k].to_numpy() for k in keys}, "generation": whose["generation"].to_numpy(), "base": base, "session_seq": base + now.groupby("owner").cumcount().to_numpy(), "msg_count": now["counted"].to_numpy(), "started": now["started"].to_numpy(), "ended": now["ended"].to_numpy()})
        done = (parts["ended"] + gap < mark).to_numpy()  # a key's sessions lie in order of their ends
        held["closed"] += np.bincount(owner[done], minlength=len(held))
        parts = parts[~done]
        open_ = np.bincount(parts["owner"], minlength=len(held)) > 0
        keep = open_ | (held["last"] + ttl >= mark).to_numpy()
        if not keep.any():
            if state.exists:
                state.remove()
            return
        wake = min([*(parts["ended"].nsmallest(1) + gap), *(held["last"][keep & ~open_].nsmallest(1) + ttl)])
        held, parts = _kept(held, parts, keep)
        state.update((_bytes(held, keys), _bytes(parts)))
        _later(state, int(wake))

    return run


def session_changes(messages: DataFrame, keys: Sequence[str], time: str = "msg_time", watermark: str = "1 day", ttl_days: int = DEFAULTS.signal_lookback_days, s: Settings = DEFAULTS, buckets: int = BUCKETS) -> DataFrame:
    """(keys…, generation, base, session_seq, msg_count, started, ended): of each key of a micro-batch its sessions from number ``base`` on.

    Update mode. A key that was silent for ``ttl_days`` is forgotten; its sessions then count from 0 again, under a new
    ``generation``. Null keys are a key like any other; rows without a time are left out.
    """
    at = F.col(time).cast("timestamp")
    rows = messages.where(F.col(time).isNotNull()).withColumn("_time", at).withWatermark("_time", watermark)
    rows = _bucketed(rows, keys, buckets, "_time", F.unix_micros("_time").alias("at"))
    return _by_bucket(rows, _sessions_of(list(keys), s.session_gap_minutes * 60_000_000, ttl_days * DAY), keys, messages.schema, _SESSION_ROWS)


def current_sessions(changes: DataFrame, keys: Sequence[str], kind: str = "timestamp") -> DataFrame:
    """(keys…, session_seq, msg_count, started, ended, session_id): what the changes (with their batch) come to.

    A batch's sessions of a key replace all that the key had from their ``base`` on, which never falls.
    """
    by = [*keys, "generation"]
    turns = changes.select(*by, "batch", "base").distinct()
    turns = turns.withColumn("_next", F.lead("base").over(Window.partitionBy(*by).orderBy("batch"))).drop("base")
    same = F.lit(True)
    for k in [*by, "batch"]:
        same = same & F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}"))
    rows = changes.alias("c").join(turns.alias("t"), same).where("t._next IS NULL OR c.session_seq < t._next").select("c.*")
    name = F.concat_ws(":", *(F.col(k).cast("string") for k in keys), F.col("session_seq").cast("string"))
    return rows.select(*keys, "session_seq", "msg_count", *(F.timestamp_micros(c).cast(kind).alias(c) for c in ("started", "ended")), name.alias("session_id"))


def _signals_of(keys: list[str], lookback: int):
    names = [*keys, "code"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        horizon = state.getCurrentWatermarkMs() // 86_400_000 - lookback  # days before this one are forgotten
        held, opened = _frames(state, names, ["day", "id"], ["owner", "day", "id"])  # of an owner (keys and code) the last closing; its openings
        touched = np.zeros(len(held), bool)
        for rows in [] if state.hasTimedOut else batches:
            if len(rows):
                held, ids = _numbered(held, rows, names, day=-(1 << 40), id=0)
                touched = np.concatenate([touched, np.zeros(len(held) - len(touched), bool)])
                touched[ids] = True
                new = pd.DataFrame({"owner": ids, "day": rows["day"].to_numpy(np.int64), "id": rows["event_id"].to_numpy(np.int64)})
                shut = (rows["status"] == "closed").to_numpy()
                last = pd.concat([held[["day", "id"]].assign(owner=np.arange(len(held))), new[shut]]).sort_values(["owner", "day", "id"]).drop_duplicates("owner", keep="last")
                held["day"], held["id"] = last["day"].to_numpy(), last["id"].to_numpy()
                # of a day's openings the last one tells whether the day counts
                opened = pd.concat([opened, new[~shut]]).groupby(["owner", "day"], as_index=False)["id"].max()
        owner, day = opened["owner"].to_numpy(), opened["day"].to_numpy()
        at, number = (held[c].to_numpy()[owner] for c in ("day", "id"))
        stays = ((day > at) | ((day == at) & (opened["id"].to_numpy() > number))) & (day >= horizon)
        touched[owner[~stays]] = True
        opened = opened[stays]
        since = opened.groupby("owner")["day"].min().reindex(np.arange(len(held)))
        if touched.any():
            yield pd.DataFrame({**{k: held[k].to_numpy()[touched] for k in names}, "since": since[touched].astype("Int32").array})
        fresh = (held["day"] >= horizon).to_numpy()
        keep = fresh | since.notna().to_numpy()
        if not keep.any():
            if state.exists:
                state.remove()
            return
        oldest = min([*held["day"][fresh].nsmallest(1), *opened["day"].nsmallest(1)])
        held, opened = _kept(held, opened, keep)
        state.update((_bytes(held, names), _bytes(opened)))
        _later(state, (int(oldest) + lookback + 1) * DAY)

    return run


def signal_changes(events: DataFrame, keys: Sequence[str], watermark: str = "1 day", lookback_days: int = DEFAULTS.signal_lookback_days, buckets: int = BUCKETS) -> DataFrame:
    """(keys…, code, since): of each key and code that a micro-batch touches, the first day since which it is open, null where it is not.

    ``events``: keys, event_id, code, status (open or closed), event_date. Update mode. A code that was opened longer
    ago than the look-back, by the watermark's day, is no longer open.
    """
    rows = events.where(F.col("status").isin("open", "closed") & F.col("event_date").isNotNull() & F.col("code").isNotNull())
    rows = rows.withColumn("_time", F.col("event_date").cast("timestamp")).withWatermark("_time", watermark)
    rows = _bucketed(rows, keys, buckets, "_time", "code", "status", F.unix_date("event_date").alias("day"), F.col("event_id").cast("long").alias("event_id"))
    return _by_bucket(rows, _signals_of(list(keys), lookback_days), keys, events.schema, _SIGNAL_ROWS)


def current_signals(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, code, since) of the signals that are open after all the changes (with their batch)."""
    last = changes.groupBy(*keys, "code").agg(F.max_by("since", "batch").alias("since"))
    return last.where("since IS NOT NULL").withColumn("since", F.date_from_unix_date("since"))


def append_changes(stream: DataFrame, path: str, checkpoint: str, stop_after: Callable[[int], bool] | None = None, partitions: int | None = None) -> None:
    """Runs what is there; each micro-batch's rows go to ``path``/batch=N. A batch that runs again, after a failure, replaces its rows.

    ``stop_after``: is asked with each batch's number once its rows are written, before Spark commits it. ``partitions``:
    of the state, which the first run fixes for good; by default as many as the session shuffles to.
    """
    conf = stream.sparkSession.conf
    usual = conf.get("spark.sql.shuffle.partitions")

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if stop_after is not None and stop_after(number):
            raise InterruptedError(f"stopped after batch {number}")

    try:
        conf.set("spark.sql.shuffle.partitions", partitions or usual)  # a query takes the session's settings when it starts
        query = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set("spark.sql.shuffle.partitions", usual)
    query.awaitTermination()


def changes_at(stream: DataFrame, path: str) -> DataFrame:
    """The changes that were appended so far, with their batch; empty where none were."""
    return read_if_there(stream.sparkSession, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema) + ", batch long")


def replayed(rows: DataFrame, part: Column, parts: int, changes: Callable[[DataFrame], DataFrame], partitions: int = 8) -> DataFrame:
    """What ``changes`` of a stream appends when a table comes in as ``parts`` micro-batches: rows whose ``part`` is 0 first, then 1, and so on.

    Each micro-batch is a run of its own that goes on from the checkpoint. ``rows`` are computed once, for all parts.
    """
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, "replay")
    rows.withColumn("_part", part).write.partitionBy("_part").parquet(f"{folder}/parts")
    dealt = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType())])).parquet(f"{folder}/parts")
    for k in range(parts):
        dealt.where(F.col("_part") == k).drop("_part").write.mode("append").parquet(f"{folder}/in")
        stream = changes(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        append_changes(stream, f"{folder}/changes", f"{folder}/checkpoint", partitions=partitions)
    return changes_at(stream, f"{folder}/changes")
