"""What the customers of a topic want, in a model's words, from diverse texts of the topic and its hot words."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import json_object
from parley.operators import ml, topics
from parley.operators.contacts import provider_answers
from parley.settings import DEFAULTS, Settings

ANSWER = "intent string, business_words array<string>"


def fallback(words: Column) -> Column:
    """From the first three hot words."""
    some = F.array_join(F.slice(words, 1, 3), "、")
    return F.concat(F.lit("客户关注"), F.when(some != "", some).otherwise(F.lit("相关业务")))


def pool(sessions: DataFrame, s: Settings = DEFAULTS, by: Sequence[str] = ("topic_id",)) -> DataFrame:
    """(by…, sample_rank, text, vector): of each topic a sample of pool_size texts, shared out to the topics merged into it (member)."""
    by = list(by)
    sizes = sessions.groupBy(*by, "member").agg(F.count("*").alias("size"))
    drawn = topics.bottom_k(sessions.select(*by, "member", "session_id", "text", "vector"), F.col("session_id"), s.pool_size, [*by, "member"])
    own = drawn.join(topics.quotas(sizes, s.pool_size, by), [*by, "member"]).where(F.col("sample_rank") <= F.col("places"))
    return own.select(*by, (F.col("sample_rank") + F.col("member") * s.pool_size).alias("sample_rank"), "text", "vector")


def described(board: DataFrame, texts: DataFrame, provider: Callable[[list[str]], list[str]] | None, s: Settings = DEFAULTS, by: Sequence[str] = ("topic_id",)) -> DataFrame:
    """(by…, customer_intent, business_words, representative, intent_source): of each topic of ``board`` (by…, words).

    texts: pool(). The model gets the hot words and picked_docs diverse texts; of its business words those count that
    are hot words. An answer that is no JSON, or no model at all, gives the fallback and the first three hot words
    (intent_source words, else model).
    """
    by = list(by)
    picked = ml.representative_texts(texts, s.picked_docs, by)
    shown = picked.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pick", "text"))), lambda x: x["text"]).alias("docs"))
    rows = board.select(*by, F.coalesce("words", F.array().cast("array<string>")).alias("words")).join(shown, by, "left")
    rows = rows.withColumn("docs", F.coalesce("docs", F.array().cast("array<string>")))
    representative = F.slice("docs", 1, s.repr_docs).alias("representative")
    three = F.slice("words", 1, 3)
    if provider is None:
        return rows.select(*by, fallback(F.col("words")).alias("customer_intent"), three.alias("business_words"), representative, F.lit("words").alias("intent_source"))
    lines = F.array_join(F.transform("docs", lambda d: F.concat(F.lit("- "), d)), "\n")
    prompt = F.concat(F.lit("hot words: "), F.array_join("words", "、"), F.lit("\ntexts:\n"), lines, F.lit('\nanswer as {"intent": "...", "business_words": ["..."]}'))
    answers = provider_answers(rows.withColumn("prompt", prompt), provider)
    found = answers.withColumn("_a", F.from_json(json_object(F.col("answer")), ANSWER))
    intent = F.trim(F.col("_a.intent"))
    said = F.coalesce(intent, F.lit("")) != ""
    own = F.array_intersect(F.coalesce("_a.business_words", F.array().cast("array<string>")), F.col("words"))
    return found.select(
        *by, F.when(said, intent).otherwise(fallback(F.col("words"))).alias("customer_intent"),
        F.when(F.size(own) > 0, own).otherwise(three).alias("business_words"), representative, F.when(said, "model").otherwise("words").alias("intent_source"),
    )
