"""Documents to packed training sequences: toxicity, exact and near copies, secrets, packing.

Each stage is one operator of parley.llm over all rows that its predecessor kept. All but the last return the
columns of ``documents``; run() writes each stage's rows as Parquet to the shared folder and reads them again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import exact_dedup, near_copies, packing, secrets, shared, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go. Learned from the labelled rows among the documents.

    Null texts count as empty. Rows that repeat an id or a text are each decided by their text. An empty table stays
    empty; without labels nothing goes. Very long texts are read whole, in a block of their own.
    """
    model = toxicity.fit_folds(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the longest stays, then the one with the smallest id, a null id last.

    Null, empty and blank texts are equal. Of rows that repeat id and text one stays. An empty table stays empty.
    """
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (5-word shingles of Jaccard 0.8 and more, linked directly or by others) the one with the smallest id stays.

    A null id comes last; of rows that repeat the smallest id the first one stays. Null and blank texts are no copies of
    anything. An empty table stays empty; very long texts are compared whole.
    """
    return near_copies.deduplicated(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced within the texts, whose n_chars follow; no document goes.

    Null texts stay null, with a null n_chars. Repeated rows are treated alike, very long texts whole.
    """
    rows = secrets.redact(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents, in sequences of at most 2048 tokens.

    A null or empty text is its end alone. Rows that repeat an id, and null ids, are documents like any other; a long
    document is cut into pieces. An empty table has no pieces.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_exact_copies), ("simhash near-dedup", drop_near_copies), ("secrets", redact_secrets), ("packing", pack)]

#: Toxicity, fingerprints and tokens are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared.new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
