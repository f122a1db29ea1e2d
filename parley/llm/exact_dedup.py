"""Exact deduplication in DataFrame operations only.

Rows are grouped by a 128-bit hash of the normalised text together with the text itself, so equal hashes of
unlike texts fall apart by comparison of their bytes. Copies fold before the exchange (partial aggregation),
hence a group of any size moves one text per task. The verdicts then join the rows, without their texts, by
hash and SHA-256; adaptive execution splits a key that many rows have. A pair of unlike texts that agreed in
both hashes (384 bits) would make the join ambiguous; the job stops then rather than return a wrong group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: str | Column) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(col, F.lit("")), WHITE_SPACE, "")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", normalise=normalised) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of ``docs``.

    Texts are equal when ``normalise`` makes them identical; by default it deletes white space and takes null for
    empty. Of equal texts the row with the most code points in its original text stays, then the smallest id.
    Rows that repeat an id count each; if the id that stays is repeated with that text, all its rows are kept.
    A null id sorts behind every other; a group of null ids only keeps null, and kept then is true.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"), normalise(text).alias("t"))
    keys = [F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(0x5EED), "t").alias("h2")]
    sha = F.sha2("t", 256)
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("last"), F.col("doc_id"))).alias("best")
    groups = rows.select("doc_id", "n", "t", *keys).groupBy("h1", "h2", "t").agg(best, F.count("*").alias("size")).where("size > 1")
    groups = groups.select("h1", "h2", sha.alias("sha"), F.col("best.doc_id").alias("keep_id"), "size")
    one = F.when(F.count("*") == 1, F.min("keep_id")).otherwise(F.raise_error(F.lit("two texts agree in 384 bits of hashes")).cast(docs.schema[doc_id].dataType))
    groups = groups.groupBy("h1", "h2", "sha").agg(one.alias("keep_id"), F.min("size").alias("size"))
    out = rows.select("doc_id", *keys, sha.alias("sha")).join(groups, ["h1", "h2", "sha"], "left")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", normalise=normalised) -> DataFrame:
    """The rows of ``docs``, whole, that stay: one for each normalised text, also where a row repeats.

    The choice is that of exact_duplicates; of rows with the same id and length one stays, by their texts' hash.
    """
    t, n = normalise(text), F.length(F.coalesce(F.col(text), F.lit("")))
    order = F.struct(-n, F.col(doc_id).isNull(), F.col(doc_id), F.xxhash64(F.col(text)))
    rows = docs.select(t.alias("t"), order.alias("o"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    keys = [F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(0x5EED), "t").alias("h2")]
    return rows.select("o", "row", "t", *keys).groupBy("h1", "h2", "t").agg(F.min_by("row", "o").alias("row")).select("row.*")
