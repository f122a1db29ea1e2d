"""Writing that replaces what it covers: partitions, scopes and keys; and reuse of what has not changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``, empty where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def overwrite_partitions(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replaces the partitions that ``rows`` has; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def delete_partition(spark: SparkSession, path: str, **values: str) -> None:
    """Removes one partition, through Hadoop's file system, so that any store will do."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path("/".join([path, *(f"{k}={v}" for k, v in values.items())]))
    where.getFileSystem(conf).delete(where, True)


def replace_scope(rows: DataFrame, path: str, **scope: str) -> None:
    """Replaces a scope's rows, also by none: dynamic overwrite alone would leave the old ones then."""
    spark = rows.sparkSession
    rows = rows.persist()
    try:
        if rows.isEmpty():
            delete_partition(spark, path, **scope)
        else:
            overwrite_partitions(rows.select("*", *(F.lit(v).alias(k) for k, v in scope.items() if k not in rows.columns)), path, list(scope))
    finally:
        rows.unpersist()


def expire_partitions(spark: SparkSession, path: str, column: str, before: str) -> list[str]:
    """Drops the partitions whose value of ``column`` lies before; returns what went. Partition values only, no rows, are read."""
    try:
        old = [str(r[0]) for r in spark.read.parquet(path).select(column).distinct().where(F.col(column).cast("string") < before).collect()]
    except AnalysisException:
        return []
    for value in old:
        delete_partition(spark, path, **{column: value})
    return sorted(old)


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = ()) -> DataFrame:
    """``old`` with ``new``'s rows in place of those with the same keys; of repeated new keys the first by ``order`` stays."""
    both = old.withColumn("_at", F.lit(0)).unionByName(new.withColumn("_at", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("_at"), *order)
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_at", "_n")


def patched(old: DataFrame, new: DataFrame, keys: Sequence[str], failed: Column, on_failure: Sequence[str]) -> DataFrame:
    """Upsert in which a failed new row only sets the ``on_failure`` columns and leaves the rest as it was."""
    a = old.select(*keys, F.struct(*(c for c in old.columns if c not in keys)).alias("_old"))
    b = new.withColumn("_failed", failed).select(*keys, "_failed", F.struct(*(c for c in old.columns if c not in keys)).alias("_new"))
    rows = a.join(b, list(keys), "full")
    columns = []
    for c in old.columns:
        if c in keys:
            columns.append(F.col(c))
            continue
        keep = F.col("_new").isNull() | (F.col("_failed") & F.col("_old").isNotNull() & F.lit(c not in on_failure))
        columns.append(F.when(keep, F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}")).alias(c))
    return rows.select(*columns)


def misses(rows: DataFrame, cache: DataFrame, key: str = "text_hash") -> DataFrame:
    """One row for each key that the cache lacks: what an expensive step has to see."""
    return rows.dropDuplicates([key]).join(cache.select(key), key, "left_anti")


def changed(now: DataFrame, before: DataFrame, keys: Sequence[str], fingerprint: str = "source_fp") -> DataFrame:
    """Rows whose fingerprint is new or differs from the one stored, which is also how late rows are found."""
    return now.join(before.select(*keys, fingerprint), [*keys, fingerprint], "left_anti")
