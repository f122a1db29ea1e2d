"""Folders for what a run keeps on the way: under the one that the cluster shares, spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names. A local session (tests) without one gets a temporary folder; on a cluster that is an error."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="parley-work-")
        atexit.register(shutil.rmtree, urlparse(root).path, True)
        sc.setCheckpointDir(root)
    return root if urlparse(root).scheme else f"file://{root}"


def remove(spark: SparkSession, path: str) -> None:
    """Through Hadoop's file system, so that any store will do."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a fresh folder; whoever makes it may remove() it when nothing reads it any more. What is left goes with the driver."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if urlparse(path).scheme == "file":
        atexit.register(shutil.rmtree, urlparse(path).path, True)
    return path


def written(rows: DataFrame, name: str = "rows") -> DataFrame:
    """rows as files in the shared folder, cut off from the plan that made them."""
    path = new_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
