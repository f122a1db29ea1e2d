"""Jump consistent hashing of stable keys to shards (Lamping and Veach, 2014), and gapless slots within them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm import shared

ROWS_PER_BUCKET = 50_000
_MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key. With one more shard, a key stays where it is or moves to the new one."""
    key = keys.astype(np.uint64)
    at, ahead = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    going = np.arange(len(key))
    while len(going):
        at[going] = ahead[going]
        key[going] = key[going] * _MULTIPLIER + np.uint64(1)
        drawn = (key[going] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[going] = ((at[going] + 1) * (float(1 << 31) / drawn)).astype(np.int64)
        going = going[ahead[going] < shards]
    return at


def jump_shard(key: Column, shards: int) -> Column:
    """``key``: a long column. Takes eight bytes a row through Arrow, nothing else of the row."""

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return shard(key)


def shard_documents(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row for each row of ``docs``.

    The hash of the id's decimal text and the shard count alone decide the shard, whatever type the id has (null ids
    share one). Slots count from 0 in each shard without a gap. They come from counts of small hash buckets and
    numbers within each bucket, so no task sees a whole shard; rows that repeat spread over the buckets by a number of
    their own, and identical rows may swap slots. Null texts have size 1; other columns are not looked at.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"), F.xxhash64(F.col(doc_id).cast("string")).alias("key"), F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)).alias("salt"))
    rows = shared.written(rows.select("*", jump_shard(F.col("key"), shards).alias("shard"), jump_shard(F.col("key"), shards + 1).alias("grown_shard")), "shards")
    per_shard = max(1, -(-rows.count() // (shards * ROWS_PER_BUCKET)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "text_crc32", "salt"), F.lit(per_shard)))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    out = rows.withColumn("place", F.row_number().over(within) - 1).join(counts, ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"), "grown_shard")
