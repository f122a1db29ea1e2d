"""The folder that driver and executors share, and files in it.

``spark.checkpoint.dir`` names it. Where the session leaves it unset and runs on one machine (tests), a temporary
folder is made once per session and set as Spark's checkpoint directory; on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import re
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="parley-shared-")
        atexit.register(shutil.rmtree, urlparse(root).path, True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root if urlparse(root).scheme else f"file://{os.path.abspath(root)}"


BATCH_ROWS = 2000


_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What a reused worker keeps from task to task for one operator. It goes when a task of another one begins."""
    for other in [k for k in _kept if k != owner]:
        del _kept[other]
    return _kept.setdefault(owner, {})


def _given_back() -> None:
    """Freed memory goes back to the system, as the next task may run in another worker."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_texts(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow for rows with texts: ``run`` gets batches of BATCH_ROWS at most, whatever the session's setting is."""

    def sliced(batches):
        kept(run.__module__)
        try:
            yield from run(batch.slice(at, BATCH_ROWS) for batch in batches for at in range(0, max(1, batch.num_rows), BATCH_ROWS))
        finally:
            _given_back()

    return df.mapInArrow(sliced, schema)


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut off from its lineage, in files that outlive an executor."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one. It goes when the driver ends: results that read it are lazy."""
    path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    make(path)
    atexit.register(remove, path)
    return path


def local(path: str) -> str | None:
    """The path as the operating system knows it, None where only a client library reaches it."""
    parts = urlparse(path)
    return parts.path if parts.scheme in ("", "file") else None


def _remote(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def make(path: str) -> None:
    if (here := local(path)) is not None:
        os.makedirs(here, exist_ok=True)
    else:
        store, inner = _remote(path)
        store.create_dir(inner)


def remove(path: str) -> None:
    if (here := local(path)) is not None:
        shutil.rmtree(here, ignore_errors=True)
    else:
        store, inner = _remote(path)
        with contextlib.suppress(OSError):
            store.delete_dir(inner)


def put(path: str, data: bytes) -> None:
    """Writes a whole file under a name of its own and renames it, so that a retried task replaces it with the same bytes."""
    side = f"{path}.{uuid.uuid4().hex}"
    if (here := local(path)) is not None:
        with open(local(side), "wb") as f:
            f.write(data)
        os.replace(local(side), here)
    else:
        store, inner = _remote(path)
        with store.open_output_stream(inner + side[len(path) :]) as f:
            f.write(data)
        store.move(inner + side[len(path) :], inner)


def mapped(path: str) -> memoryview:
    """The file as a read-only memory map. From a store that is not mounted it is first copied to an unlinked local file."""
    import mmap

    if (here := local(path)) is not None:
        with open(here, "rb") as f:
            return memoryview(mmap.mmap(f.fileno(), 0, prot=mmap.PROT_READ)) if os.fstat(f.fileno()).st_size else memoryview(b"")
    store, inner = _remote(path)
    with tempfile.TemporaryFile() as spool:  # unlinked: the space is free as soon as the map is dropped
        with store.open_input_stream(inner) as f:
            while chunk := f.read(1 << 22):
                spool.write(chunk)
        spool.flush()
        return memoryview(mmap.mmap(spool.fileno(), 0, prot=mmap.PROT_READ)) if spool.tell() else memoryview(b"")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, cut off from its lineage."""
    path = f"{new_folder(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: monotonically_increasing_id has the partition in the bits above these.
_PART = 33


def stored_rows(ids: DataFrame, rows: DataFrame) -> str:
    """Folder with the numbers in ``ids`` (row long), a sorted file for each partition that the numbers of ``rows`` have."""
    spark = ids.sparkSession
    last = rows.agg(F.max(F.shiftright("row", _PART))).first()[0]
    folder = new_folder(spark, "rows")
    parts = ids.select(F.shiftright("row", _PART).alias("part"), "row").union(spark.range(0 if last is None else last + 1).select("id", F.lit(None).cast("long")))

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            part, row = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            known = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            for p in np.unique(part).tolist():
                held.setdefault(int(p), []).append(row[(part == p) & known].astype(np.int64))
        for p, found in held.items():
            put(f"{folder}/{p}", np.unique(np.concatenate(found)).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64())], names=["n"])

    parts.repartition("part").mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return folder


def rows_in(rows: DataFrame, folder: str, inside: bool = True) -> DataFrame:
    """The rows whose number ``row`` is among those of stored_rows(), or those whose number is not. Nothing is shuffled."""

    def run(batches):
        part, known = None, None
        for batch in batches:
            row = batch.column("row").to_numpy()
            keep = np.zeros(len(row), bool)
            for p in np.unique(row >> _PART).tolist():
                if p != part:
                    part, known = p, np.frombuffer(mapped(f"{folder}/{p}"), np.int64)
                mine = row >> _PART == p
                at = np.searchsorted(known, row[mine])
                keep[mine] = (known[np.minimum(at, len(known) - 1)] == row[mine]) if len(known) else False
            yield batch.filter(pa.array(keep == inside))

    return map_texts(rows, run, rows.schema)
