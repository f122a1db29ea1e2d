"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm import centroids, exact_dedup, factorisation, kneser_ney, language_id, packing, periodic_runs, secrets, sentencepiece_codec, sharding, simhash, toxicity, vector_join
from parley.llm.folds import is_held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", is_held_out("doc_id", 7, 2).alias("held_out"))
    return kneser_ney.score(docs, kneser_ney.fit(docs.where("not held_out")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_folds(docs, _table(spark, sf_dir, "labels"))
    rows = toxicity.score(docs.withColumn("held_out", is_held_out("doc_id", 5, 0)), model)
    return rows.select("doc_id", "held_out", "score", "predicted")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), 8)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_held_out(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encoding_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    at = g % F.greatest(n, F.lit(1))
    period = F.lit(1) + F.floor((n - at) / (F.lit(3) + g % 8))
    looped = F.array_join(periodic_runs.repeated_from(words, at.cast("int"), period.cast("int")), " ")
    docs = docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), looped).otherwise(F.col("text")).alias("text"))
    rows = periodic_runs.periodic_runs(docs).withColumn("best", periodic_runs.highest())
    milli = F.expr("1000 * best.length div best.period")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    digests = [F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")]
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"), *digests)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = factorisation.fit_folds(docs, _table(spark, sf_dir, "labels"), ("n_chars",))
    rows = factorisation.score(docs.withColumn("held_out", is_held_out("doc_id", 3, 1)), model)
    return rows.select("doc_id", "held_out", "score", "predicted")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, clusters = centroids.delta_lloyd(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 40, 5, "2:")
    total = F.sum("inertia").over(Window.partitionBy())  # of 40 rows
    clusters = clusters.select("cluster", F.col("inertia").alias("cluster_inertia"), total.alias("inertia"), F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))
    return rows.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES = {f.__name__: f for f in (op1_lm_score, op2_toxicity, op3_sharding, op4_secrets, op5_vector_join, op6_exact_dedup, op7_simhash, op8_language_id, op9_packing, op10_sentencepiece, op11_periodic_runs, op12_quality, op13_centroids)}


def _lloyd_sql(clusters: int, rounds: int) -> str:
    """Each round has two tables: who belongs where (a), and the centroids after it (c)."""
    parts = [
        """v AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        )""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS k, q FROM v QUALIFY k < {clusters})",
    ]
    for t in range(rounds + 1):
        parts.append(f"""a{t} AS MATERIALIZED (
            SELECT r, min({{'d': CAST(list_sum(list_transform(list_zip(v.q, c{t}.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), 'k': k}}) AS best FROM v, c{t} GROUP BY r
        )""")
        if t < rounds:
            parts.append(f"""c{t + 1} AS MATERIALIZED (
            SELECT k, coalesce(n.q, c{t}.q) AS q FROM c{t} LEFT JOIN (
                SELECT k, list(m ORDER BY i) AS q FROM (
                    SELECT k, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM (SELECT best.k AS k, unnest(q) AS x, unnest(range(64)) AS i FROM a{t} JOIN v USING (r)) GROUP BY k, i
                ) GROUP BY k
            ) AS n USING (k)
        )""")
    return f"""
        WITH {", ".join(parts)}
        SELECT vec_id, CAST(best.k AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256
        FROM a{rounds} JOIN v USING (r) JOIN c{rounds} ON c{rounds}.k = best.k
    """


ORACLE_SQL = {
    "op5_vector_join": r"""
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
        ), reached AS (
            SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT vec_id, y FROM reached JOIN links ON x = r
        )
        SELECT e.vec_id, (SELECT count(*) FROM links WHERE x = e.vec_id) AS n_links, min(r) AS component_id, min(r) = e.vec_id AS kept
        FROM embeddings AS e JOIN reached USING (vec_id) GROUP BY e.vec_id
    """,
    "op6_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
        ), g AS (
            SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d
        )
        SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, sha256(t) AS text_sha256 FROM g
    """,
    "op13_centroids": _lloyd_sql(40, 5),
}
