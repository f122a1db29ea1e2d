"""Centroid clustering of integer vectors: Lloyd's rounds that look only at what changed (delta Lloyd).

Assignments are persisted: a table in the shared folder has each vector with its owner and its squared distance from
it. The sums and numbers of the vectors of each centroid are kept from round to round too. A round reads the table
and compares a vector with the changed centroids alone, as the others were no better before and have not moved; only if
its owner moved away from it, it is compared with all of them. The vectors that got a new owner are then summed by
task into signed transfers (out of the old one, into the new one), which are added to the kept sums. New centroids
follow from these. All numbers are integers, so the results don't depend on order or partitions.

A round writes a table anew and the one before it is removed once it is whole, so at most two exist. The driver holds
what the centroids themselves take: their components, sums and numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import shared

ROWS = 4096  # vectors that a task compares at a time
_EXACT = 1 << 53  # integers up to here are exact in double precision


def largest(size: int) -> int:
    """Components up to this one have squared distances that fit a long."""
    return math.isqrt((1 << 62) // size) // 2


def integers(embedding: str, size: int, scale: float) -> Column:
    """floor(scale * x) of each component; null for vectors of another size or with a null, non-finite or too large component."""
    v = F.col(embedding).cast("array<double>")
    fits = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(largest(size) / scale)))
    return F.when((F.size(v) == size) & F.coalesce(fits, F.lit(False)), F.transform(v, lambda x: F.floor(x * scale).cast("int")))


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of vectors from centroids, exact."""
    most = int(max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)))
    if 4 * x.shape[1] * most * most < _EXACT:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def reassigned(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (of equally near ones the first) and squared distance of vectors that had this owner (-1: none) before ``changed`` ones moved."""
    owner, distance = owner.copy(), distance.copy()
    moved = np.flatnonzero((owner >= 0) & np.isin(owner, changed))
    now = np.empty(len(moved), np.int64)
    for c in np.unique(owner[moved]).tolist():
        mine = owner[moved] == c
        now[mine] = _distances(x[moved[mine]], centroids[c : c + 1])[:, 0]
    lost = owner < 0
    lost[moved[now > distance[moved]]] = True
    distance[moved] = now
    rows = np.flatnonzero(lost)
    if len(rows):
        d = _distances(x[rows], centroids)
        owner[rows] = d.argmin(axis=1)
        distance[rows] = d[np.arange(len(rows)), owner[rows]]
    rows = np.flatnonzero(~lost)
    if len(rows) and len(changed):
        d = _distances(x[rows], centroids[changed])
        at = d.argmin(axis=1)
        best, new = d[np.arange(len(rows)), at], changed[at]
        better = (best < distance[rows]) | ((best == distance[rows]) & (new < owner[rows]))
        owner[rows[better]], distance[rows[better]] = new[better], best[better]
    return owner, distance


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _round(centroids: np.ndarray, changed: np.ndarray, names: list[str]):
    """Rows (id, vector, before, owner, distance) from rows (id, vector, owner, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                owner, distance = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
                new, d = reassigned(_matrix(batch.column(1), centroids.shape[1]), owner, distance, centroids, changed)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(a, t) for a, t in ((owner, pa.int32()), (new, pa.int32()), (d, pa.int64())))], names=names)

    return run


def _transfers(size: int):
    """(owner, place, total): what a task's vectors take out of and into each centroid, by component; place -1 has their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = np.column_stack([_matrix(batch.column(0), size), np.ones(batch.num_rows, np.int64)])
                for sign, column in ((-1, 1), (1, 2)):
                    owner = batch.column(column).to_numpy()
                    for c in np.unique(owner[owner >= 0]).tolist():
                        held[c] = held.get(c, 0) + sign * x[owner == c].sum(axis=0)
        if held:
            owners = np.repeat(list(held), size + 1)
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int32()), pa.array(np.tile([*range(size), -1], len(held)), pa.int32()), pa.array(np.concatenate(list(held.values())))], names=["owner", "place", "total"])

    return run


def delta_lloyd(vectors: DataFrame, clusters: int, rounds: int, salt: str = "", size: int = 64, scale: float = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Assignments (vec_id, cluster, distance) of all fit vectors, and clusters (cluster, centroid, members, inertia).

    A vector is fit if it has ``size`` components, none of them null or non-finite; each counts as floor(scale * x). One
    with a component beyond largest(size) has no distance that fits a long and is left out like a non-finite one. The
    first centroids are the vectors with the smallest SHA-256 of ``salt`` and their id, in this order; of rows that
    repeat an id the smaller vector comes first, null ids last. There are fewer, if there are fewer fit vectors. After
    each of ``rounds`` rounds every centroid with members becomes the floor of their mean; then vectors are assigned
    once more. Squared distances, ties go to the smaller number. Repeated rows count each. An empty table gives two
    empty ones. Other columns are not looked at. Runs Spark jobs.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), integers(embedding, size, scale).alias("vector")).where("vector is not null")
    first = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    seeds = rows.select("vector", first.alias("first")).orderBy(F.asc_nulls_last("first"), "vector").limit(clusters).collect()
    clusters = len(seeds)
    kinds = "cluster int, centroid array<bigint>, members long, inertia long"
    if not clusters:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), spark.createDataFrame([], kinds)
    centroids = np.array([r.vector for r in seeds], np.int64)
    sums, members = np.zeros_like(centroids), np.zeros(clusters, np.int64)
    changed = np.arange(clusters)
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string("before int, owner int, distance long").fields])
    state, folder = rows.select("*", F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("distance")), None
    for k in range(rounds + 1):
        past, folder = folder, shared.new_folder(spark, "lloyd")
        state.select("vec_id", "vector", "owner", "distance").mapInArrow(_round(centroids, changed, schema.names), schema).write.parquet(f"{folder}/rows")
        state = spark.read.schema(schema).parquet(f"{folder}/rows")
        if past:
            shared.remove(past)
        if k == rounds:
            break
        moves = state.where("before != owner").select("vector", "before", "owner").mapInArrow(_transfers(size), "owner int, place int, total long")
        for r in moves.groupBy("owner", "place").agg(F.sum("total").alias("total")).collect():  # clusters x (size + 1) rows at most
            if r.place < 0:
                members[r.owner] += r.total
            else:
                sums[r.owner, r.place] += r.total
        new = np.where(members[:, None] > 0, sums // np.maximum(members, 1)[:, None], centroids)
        changed = np.flatnonzero((new != centroids).any(axis=1))
        centroids = new
        if not len(changed):
            break
    found = {r.owner: r for r in state.groupBy("owner").agg(F.count("*").alias("members"), F.sum("distance").alias("inertia")).collect()}
    table = [(c, centroids[c].tolist(), found[c].members if c in found else 0, found[c].inertia if c in found else 0) for c in range(clusters)]
    return state.select("vec_id", F.col("owner").alias("cluster"), "distance"), spark.createDataFrame(table, kinds)
