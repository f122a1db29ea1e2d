"""Reduction and clustering of session vectors with spark.ml, and diverse representative texts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators.moments import assigned
from parley.settings import DEFAULTS, Settings


def checked_vectors(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """The rows; null or non-finite components and lengths that differ raise an error when they are met."""
    v = F.col(vector)
    bad = v.isNull() | (F.size(v) == 0) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    width = F.size(F.first(v, ignorenulls=True))
    one = rows.select(v).limit(1).agg(width.alias("_width"))
    checked = F.when(bad | (F.size(v) != F.col("_width")), F.raise_error(F.lit("vectors must be finite and of one length")).cast(rows.schema[vector].dataType)).otherwise(v)
    return rows.crossJoin(F.broadcast(one)).withColumn(vector, checked).drop("_width")


def cluster_topics(rows: DataFrame, vector: str = "vector", s: Settings = DEFAULTS) -> DataFrame:
    """Adds topic_id and distance: PCA, then k-means of the reduced vectors; trained on all rows, each in its place.

    Where the settings have gates, rows too far from their centre or too close to a second one are noise (topic -1).
    Fewer rows than clusters give fewer clusters. Training passes re-read the input, so it is persisted once.
    """
    data = checked_vectors(rows, vector).withColumn("_v", array_to_vector(F.col(vector))).persist()
    try:
        n = data.count()
        if n == 0:
            return rows.withColumn("topic_id", F.lit(0)).withColumn("distance", F.lit(0.0))
        width = len(data.select(vector).first()[0])
        stages = [PCA(k=min(s.pca_components, width, n), inputCol="_v", outputCol="_x"), KMeans(k=min(s.clusters, n), seed=s.seed, featuresCol="_x", predictionCol="topic_id")]
        model = Pipeline(stages=stages).fit(data)
    finally:
        data.unpersist()
    pca, means = model.stages
    out = pca.transform(checked_vectors(rows, vector).withColumn("_v", array_to_vector(F.col(vector)))).withColumn("_x", vector_to_array("_x"))
    # Rows too far from their centre or too close to a second one are noise, where the settings have gates.
    return assigned(out.drop("_v"), np.array(means.clusterCenters()), "_x", s).drop("_x", "margin")


def mmr(vectors: np.ndarray, k: int, weight: float = 0.6) -> list[int]:
    """Rows picked by maximal marginal relevance: near the pool's centre, unlike those picked before; ties to the first."""
    x = vectors.astype(np.float64)
    x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
    centre = x.mean(axis=0)
    relevance = x @ (centre / (np.linalg.norm(centre) + 1e-9))
    like, free, picked = np.zeros(len(x)), np.ones(len(x), bool), []
    for _ in range(min(k, len(x))):
        score = np.where(free, np.round(weight * relevance - (1 - weight) * like, 12), -np.inf)
        best = int(score.argmax())
        picked.append(best)
        free[best] = False
        like = x @ x[best] if len(picked) == 1 else np.maximum(like, x @ x[best])
    return picked


def representative_texts(pool: DataFrame, k: int = DEFAULTS.picked_docs, topic: str | Sequence[str] = "topic_id", order: str = "sample_rank") -> DataFrame:
    """(topic…, pick, text) of pools that were sampled down to a bounded number of rows (order, text, vector) each."""
    by = [topic] if isinstance(topic, str) else list(topic)
    schema = T.StructType([*(pool.schema[c] for c in by), T.StructField("pick", T.IntegerType()), T.StructField("text", T.StringType())])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order).reset_index(drop=True)
        picked = mmr(np.stack(rows["vector"].to_list()), k)
        return pd.DataFrame({**{c: rows[c].iloc[picked].to_numpy() for c in by}, "pick": range(1, len(picked) + 1), "text": rows["text"].iloc[picked].str.slice(0, 200).to_numpy()})

    return pool.select(*by, order, "text", "vector").groupBy(*by).applyInPandas(run, schema)
