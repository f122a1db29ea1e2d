"""Day-over-day trend: today's ranked topics matched to yesterday's by their hot words."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.vectors import jaccard
from parley.settings import DEFAULTS, Settings


def similarities(today: DataFrame, before: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(scope…, rank, prev_topic, prev_rank, prev_heat, similarity) of topics that share a word, through the words.

    Both sides are boards, at most top_n topics of ten words a scope; topics without a common word have
    similarity 0, which matches nothing.
    """
    a = today.select(*scope, "rank", "words", F.explode(F.array_distinct("words")).alias("word"))
    b = before.select(*scope, F.col("topic_id").alias("prev_topic"), F.col("rank").alias("prev_rank"), F.col("heat").alias("prev_heat"), F.col("words").alias("prev_words"), F.explode(F.array_distinct("words")).alias("word"))
    pairs = a.join(b, [*scope, "word"]).dropDuplicates([*scope, "rank", "prev_rank"])
    return pairs.select(*scope, "rank", "prev_topic", "prev_rank", "prev_heat", jaccard(F.col("words"), F.col("prev_words")).alias("similarity"))


def _match(s: Settings):
    def run(pairs: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        pairs = pairs.sort_values(["rank", "similarity", "prev_rank"], ascending=[True, False, True])
        for rank, rows in pairs.groupby("rank", sort=True):
            # The best one left decides, also when its heat or similarity then rules it out.
            best = next((r for r in rows.itertuples() if r.prev_rank not in used and r.similarity > 0), None)
            if best is not None and best.similarity >= s.trend_similarity and best.prev_heat > 0:
                used.add(best.prev_rank)
                out.append((*(best._asdict()[c] for c in pairs.columns if c.startswith("scope")), rank, best.prev_topic, best.prev_heat))
        names = [*(c for c in pairs.columns if c.startswith("scope")), "rank", "prev_topic", "prev_heat"]
        return pd.DataFrame(out, columns=names)

    return run


def with_trend(today: DataFrame, before: DataFrame, scope: Sequence[str] = (), s: Settings = DEFAULTS) -> DataFrame:
    """Adds prev_topic, prev_heat, heat_change_pct, is_new and is_surge.

    Each of yesterday's topics is matched once, in order of today's ranks: a sequential choice, made by one small
    grouped pandas call for each scope. ``scope`` columns are named scope_….
    """
    pairs = similarities(today, before, scope)
    kind = before.schema["topic_id"].dataType
    schema = T.StructType([*(today.schema[c] for c in scope), T.StructField("rank", T.IntegerType()), T.StructField("prev_topic", kind), T.StructField("prev_heat", T.LongType())])
    matched = pairs.groupBy(*scope).applyInPandas(_match(s), schema)
    out = today.join(matched, [*scope, "rank"], "left")
    pct = F.round((F.col("heat") - F.col("prev_heat")) / F.col("prev_heat"), 4)
    out = out.withColumn("heat_change_pct", pct).withColumn("is_new", F.col("prev_heat").isNull())
    out = out.withColumn("is_surge", (F.col("heat") >= s.surge_min_heat) & (F.col("is_new") | (F.col("heat_change_pct") >= s.surge_pct)))
    return out.withColumn("prev_heat", F.coalesce("prev_heat", F.lit(0).cast("long")))
