"""Message logs, vectors, rosters and lexicons as DataFrames; and roles of the star schema's tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.hashing import crc_partition, shard_number
from parley.operators.sessions import is_customer
from parley.settings import DEFAULTS, Settings

LOG_SCHEMA = (
    "id long, msg_id string, content string, create_date string, create_time string, msg_time timestamp, from_user string, to_user string, "
    "room_id string, msg_type string, db_time timestamp, msg_time_long long, msg_body string, action_text string, scene int"
)


def read_log(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The message log over all its shards; filters on dates, types and users reach the scan."""
    return spark.read.schema(LOG_SCHEMA).parquet(*([paths] if isinstance(paths, str) else paths))


def read_log_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str], s: Settings = DEFAULTS, date: str | None = None) -> DataFrame:
    """The same over a database's shard tables, a partition each. ``table``: a name with {} for the shard's number.

    ``date``: only that day's rows, by creation date, which the database filters.
    """
    only = [f"create_date = '{date}'"] if date else None
    return union_of_shards([spark.read.jdbc(url, table.format(k), predicates=only, properties=properties) for k in range(1, s.shard_count + 1)])


def union_of_shards(shards: Sequence[DataFrame]) -> DataFrame:
    """All rows of all shards, columns matched by name."""
    out = shards[0]
    for df in shards[1:]:
        out = out.unionByName(df)
    return out


def customer_messages(log: DataFrame, date: str, s: Settings = DEFAULTS) -> DataFrame:
    """Text messages of customers on a day by its creation date: (id, staff, customer, msg_type, content, msg_time)."""
    day = log.where((F.col("create_date") == date) & (F.col("msg_type") == "text") & is_customer(F.col("from_user"), s))
    return day.select("id", F.col("to_user").alias("staff"), F.col("from_user").alias("customer"), "msg_type", F.coalesce("content", F.lit("")).alias("content"), "msg_time")


def day_messages(log: DataFrame, date: str) -> DataFrame:
    """All text messages of a day by message time."""
    lo = F.to_timestamp(F.lit(date))
    return log.where((F.col("msg_type") == "text") & (F.col("msg_time") >= lo) & (F.col("msg_time") < lo + F.expr("INTERVAL 1 DAY")))


def manager_messages(log: DataFrame, manager: str, start: str, end: str) -> DataFrame:
    """Text messages from or to one manager between two days, both included."""
    rows = log.where((F.col("msg_type") == "text") & ((F.col("from_user") == manager) | (F.col("to_user") == manager)))
    return rows.where((F.col("msg_time") >= F.to_timestamp(F.lit(start))) & (F.col("msg_time") < F.to_timestamp(F.lit(end)) + F.expr("INTERVAL 1 DAY")))


def with_shard(log: DataFrame, key: str = "from_user", s: Settings = DEFAULTS) -> DataFrame:
    return log.withColumn("shard", shard_number(F.col(key), s.shard_count))


def day_part(pairs: DataFrame, part: int, parts: int, manager: str = "manager") -> DataFrame:
    """One of ``parts`` batches of managers. Spark partitions by itself; this is for running a day in pieces."""
    return pairs.where(crc_partition(F.col(manager), parts) == part)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """A word list, a word a line: (word), stripped, once each ignoring case; in no order."""
    rows = spark.read.text(path).select(F.trim("value").alias("word")).where("word != ''")
    return rows.groupBy(F.lower("word").alias("_key")).agg(F.min("word").alias("word")).drop("_key")


def lexicon_added(lexicon: DataFrame, words: DataFrame, kind: str) -> DataFrame:
    """(kind, word, enabled) with words added or enabled again; words are one when they differ in case alone."""
    new = words.select(F.lit(kind).alias("kind"), F.trim("word").alias("word"), F.lit(True).alias("enabled")).where("word != ''")
    both = lexicon.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    return both.groupBy("kind", F.lower("word").alias("_key")).agg(F.min_by("word", F.struct("_new", "word")).alias("word"), F.bool_or("enabled").alias("enabled")).drop("_key")


def lexicon_removed(lexicon: DataFrame, word: str, kind: str) -> DataFrame:
    gone = (F.col("kind") == kind) & (F.lower("word") == word.lower())
    return lexicon.withColumn("enabled", F.col("enabled") & ~gone)


def paged_roster(spark: SparkSession, department: str, fetch: Callable[[str, int], dict], size: int = 100, attempts: int = 3) -> DataFrame:
    """(department, manager) from a paged service. Any page that keeps failing fails the department; ids stay once.

    ``fetch(department, page)`` gives {"items": [...], "total": n}. A roster is a bounded list of employees.
    """
    seen: dict[str, None] = {}
    page = 1
    while True:
        for attempt in range(attempts):
            try:
                got = fetch(department, page)
                break
            except OSError:
                if attempt == attempts - 1:
                    raise
        seen |= dict.fromkeys(got["items"])
        if not got["items"] or page * size >= got["total"]:
            break
        page += 1
    return spark.createDataFrame(pd.DataFrame({"department": [department] * len(seen), "manager": list(seen)}), "department string, manager string")


# --- the driver's tables in these roles ------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as messages: a user's manager is its number modulo 10, errors are the manager's, other types its own."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("manager"), F.col("user_id").alias("customer"), (F.col("event_type") != "error").alias("from_customer"),
        F.col("event_type").alias("topic_id"), F.col("ts").alias("msg_time"), F.col("props").alias("content"), "value",
    )


def topic_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as session vectors with their label as topic; staff and customer by number, three message counts in turn."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").cast("string").alias("session_id"), F.col("vec_id").alias("n"), F.col("label").cast("int").alias("topic_id"), F.col("embedding").alias("vector"),
        (F.col("vec_id") % 3 + 1).alias("msg_count"), (F.col("vec_id") % 7).alias("customer"), (F.col("vec_id") % 10).alias("staff"),
    )
