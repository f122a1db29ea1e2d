"""Near-duplicate vectors by an exact metric range join.

Vectors are scaled to length 1, where cosine >= c means Euclidean distance <= r = sqrt(2 - 2c). Pivots drawn from
the data cut each label into cells: a vector's home is its nearest pivot. It is copied to every other cell q that
can hold one of its neighbours: by the triangle inequality d(v, q) <= d(v, home) + 2r, and v lies within r of the
plane that bounds q's cell towards home. Each cell then finds, alone, all links of the vectors at home in it.

Equal vectors are one from the start, with a multiplicity. A cell with many vectors is cut into chunks of those at
home, each of which meets all of the cell's vectors as they stream by; so neither a common vector nor a crowded
cell makes a large task. Only a forest of each chunk's links leaves it, but all links are counted.

How often a vector is copied depends on the data: in many dimensions without clusters the cells' borders are close to
everything. So the pivots are the most, of a few numbers tried, with which the vectors of a bounded sample are copied
``MOST_COPIES`` times on average at most. Fewer pivots cost comparisons within the cells, never links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.graph import components, forest
from parley.llm.shared import checkpointed

COSINE = 0.98
ROWS_PER_PIVOT = 64
LEAST_PIVOTS = 4  # of a label, if it has more vectors
MOST_PIVOTS = 16_384  # of all labels together: with 64 dimensions, 8 MB that every task gets
MOST_LABELS = 2048  # that have pivots; each other one is smaller than these, and one cell
CHUNK = 4096  # vectors at home that a task holds
STREAM = 2048
MOST_COPIES = 3
PROBES = 24  # vectors of a label whose copies are counted, and as many more as it has pivots
CELL_NUMBERS = 1 << 20  # distances that a task holds at a time
_SLACK = 1e-9  # rounding in distances; links themselves are decided on cosines in double precision


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_size(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batch by the number of components of its vectors."""
    sizes = pc.list_value_length(batch.column(name)).to_numpy()
    for n in np.unique(sizes):
        yield int(n), batch.filter(pa.array(sizes == n))


def _distance(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosines, 0))


def _near(x: np.ndarray, p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector, cell, whether it is at home there) of unit vectors x and pivots p."""
    d = _distance(x @ p.T)
    nearest = d.argmin(axis=1)
    least = d[np.arange(len(x)), nearest][:, None]
    near = d <= least + 2 * radius + _SLACK
    near &= d * d - least * least <= 2 * radius * _distance(p[nearest] @ p.T) + _SLACK
    near[np.arange(len(x)), nearest] = True
    row, cell = np.nonzero(near)
    return row, cell, cell == nearest[row]


def chosen_pivots(pivots: dict[tuple, np.ndarray], probes: dict[tuple, np.ndarray], radius: float) -> dict[tuple, np.ndarray]:
    """The pivots of each label, as many of them (all, half, ...) as copy its probes MOST_COPIES times at most, but two."""
    out = {}
    for key, p in pivots.items():
        x = probes.get(key, p[:0])
        while len(p) > 2 and len(x) and len(_near(x, p, radius)[0]) > MOST_COPIES * len(x):
            p = p[: max(2, len(p) // 2)]
        if len(p) > 1:
            out[key] = p
    return out


def _drawn(classes: DataFrame) -> tuple[dict[tuple, np.ndarray], dict[tuple, np.ndarray]]:
    """Unit vectors drawn by their hash, by label and size: a pivot for every ROWS_PER_PIVOT of a label's vectors, at least LEAST_PIVOTS; and others as probes.

    Of more labels than MOST_LABELS the largest have pivots; if there would be more than MOST_PIVOTS, all get fewer.
    """
    labels = classes.groupBy("label", F.size("vector").alias("size")).agg(F.count("*").alias("n")).where(F.col("n") > LEAST_PIVOTS)
    labels = {(r.label, r["size"]): r.n for r in labels.orderBy(F.desc("n"), "label", "size").limit(MOST_LABELS).collect()}
    rows = max(ROWS_PER_PIVOT, -(-sum(labels.values()) // MOST_PIVOTS))
    wanted = {key: max(LEAST_PIVOTS, n // rows) for key, n in labels.items()}
    if not wanted:
        return {}, {}
    # About twice as many as wanted and a few more, so that there are enough, with probes among them.
    shares = [(*key, min(1.0, (2 * k + PROBES) / labels[key])) for key, k in wanted.items()]
    shares = classes.sparkSession.createDataFrame(shares, "own_label string, own_size int, share double")  # MOST_LABELS rows at most
    own = F.xxhash64("hash").bitwiseAND((1 << 53) - 1)
    some = classes.join(F.broadcast(shares), (F.col("label") == F.col("own_label")) & (F.size("vector") == F.col("own_size"))).where(own < F.col("share") * float(1 << 53))
    found: dict[tuple, list] = {}
    for r in some.select("label", "own_size", own.alias("own"), "class", "vector").toLocalIterator():
        v = np.array(r.vector, np.float64)
        v = v / np.abs(v).max()
        found.setdefault((r.label, r.own_size), []).append((r.own, r["class"], v / np.linalg.norm(v)))
    drawn = {key: np.array([v for *_, v in sorted(own, key=lambda x: x[:2])]) for key, own in found.items()}
    return {key: v[: wanted[key]] for key, v in drawn.items()}, {key: v[wanted[key] :] for key, v in drawn.items()}


def _cells(pivots: dict[tuple, np.ndarray], radius: float):
    """Rows (class, cell, home): where each vector is at home and where it is copied to."""
    slice_rows = max(16, min([STREAM, *(CELL_NUMBERS // len(p) for p in pivots.values())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                for n, part in _by_size(batch.slice(at, slice_rows), "vector"):
                    labels = np.array(part.column("label").to_pylist(), object)
                    for label in set(labels.tolist()):
                        rows = np.flatnonzero(labels == label)
                        own = part.take(pa.array(rows))
                        p = pivots.get((label, n))
                        if p is None:
                            row, cell, home = np.arange(len(rows)), np.zeros(len(rows), np.int64), np.ones(len(rows), bool)
                        else:
                            row, cell, home = _near(_unit(own.column("vector")), p, radius)
                        taken = own.take(pa.array(row))
                        yield pa.RecordBatch.from_arrays([taken.column("label"), pa.array(np.full(len(row), n, np.int32)), pa.array(cell.astype(np.int64)), pa.array(home), taken.column("class"), taken.column("copies"), taken.column("vector")], names=["label", "size", "cell", "home", "class", "copies", "vector"])

    return run


def _runs(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[int]:
    """Where rows begin that differ from the row before in one of these columns, and the end."""
    fresh = np.zeros(batch.num_rows - 1, bool)
    for name in names:
        column = batch.column(name)
        fresh |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(fresh) + 1).tolist(), batch.num_rows]


def _links(cosine: float):
    """Of each chunk of a cell: (class, weight of its links, null), and its links' forest as (class, null, other class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, x, classes, count, a, b = None, [], None, None, None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            if classes is not None:
                yield pa.RecordBatch.from_arrays([pa.array(classes), pa.array(count), pa.nulls(len(classes), pa.int64())], names=["class", "n", "other"])
                if a:
                    u, v = forest(np.concatenate(a), np.concatenate(b))
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.nulls(len(u), pa.int64()), pa.array(v)], names=["class", "n", "other"])

        for batch in batches:  # sorted by chunk; those at home come first
            if not batch.num_rows:
                continue
            cuts = _runs(batch, ("label", "size", "cell", "chunk", "role"))
            for start, stop in ((at, min(at + STREAM, last)) for first, last in zip(cuts[:-1], cuts[1:], strict=True) for at in range(first, last, STREAM)):
                *own, role = (batch.column(c)[start].as_py() for c in ("label", "size", "cell", "chunk", "role"))
                part = batch.slice(start, stop - start)
                if own != key:
                    yield from out()
                    key, held, x, classes, count, a, b = own, [], None, None, None, [], []
                if role == 0:
                    held.append((part.column("class").to_numpy(), _unit(part.column("vector"))))
                elif held or x is not None:
                    if x is None:
                        classes, x = (np.concatenate(c) for c in zip(*held, strict=True))
                        held, count = [], np.zeros(len(classes), np.int64)
                    other, copies = part.column("class").to_numpy(), part.column("copies").to_numpy()
                    near = (x @ _unit(part.column("vector")).T >= cosine) & (classes[:, None] != other)
                    count += near @ copies
                    i, j = np.nonzero(near)
                    if len(i):
                        u, v = forest(classes[i], other[j])
                        a.append(u)
                        b.append(v)
                        if len(a) > 64:
                            u, v = forest(np.concatenate(a), np.concatenate(b))
                            a, b = [u], [v]
        yield from out()

    return run


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors``.

    Vectors link when their labels are equal and not null and their cosine, in double precision, is ``cosine`` or
    more. A vector that is null, empty or zero or has a null or non-finite component links with nothing, nor do
    vectors of unlike length. Rows that repeat an id count each as a vector of its own; a row with a null id has
    links like any other and keeps null as component_id if it names none.
    """
    v = F.col(embedding)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    fit = F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(odd, F.lit(False)) & F.exists(v, lambda x: x != 0)
    typed = v.cast("array<double>") if isinstance(vectors.schema[embedding].dataType.elementType, T.DoubleType) else v.cast("array<float>")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.when(F.coalesce(fit, F.lit(False)), typed).alias("vector"), F.col(label).cast("string").alias("label"))
    rows = rows.withColumn("hash", F.xxhash64("label", "vector"))
    valid = rows.where("vector is not null")
    classes = valid.groupBy("hash", "label", "vector").agg(F.min("vec_id").alias("lowest"), F.count("*").alias("copies"))
    classes = checkpointed(classes.withColumn("class", F.monotonically_increasing_id()))

    radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + _SLACK
    pivots = chosen_pivots(*_drawn(classes), radius)
    kind = classes.schema["vector"].dataType
    schema = T.StructType([*T._parse_datatype_string("label string, size int, cell long, home boolean, class long, copies long").fields, T.StructField("vector", kind)])
    members = classes.select("label", "class", "copies", "vector").mapInArrow(_cells(pivots, radius), schema)
    crowds = members.where("home").groupBy("label", "size", "cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    members = members.join(crowds, ["label", "size", "cell"])  # cells without anyone at home have no work
    chunk = F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int")
    at_home = F.when(F.col("home"), F.array(F.struct(chunk.alias("chunk"), F.lit(0).alias("role")))).otherwise(F.array().cast("array<struct<chunk:int,role:int>>"))
    streamed = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(c.cast("int").alias("chunk"), F.lit(1).alias("role")))
    dealt = members.select("*", F.explode(F.concat(at_home, streamed)).alias("x")).select("label", "size", "cell", "x.chunk", "x.role", "class", "copies", "vector")
    order = ["label", "size", "cell", "chunk"]
    found = dealt.repartition(*order).sortWithinPartitions(*order, "role").mapInArrow(_links(cosine), "class long, n long, other long")
    found = checkpointed(found)

    roots = components(found.where("other is not null").select("class", "other"))
    counts = found.where("n is not null").select("class", "n")
    named = classes.select("class", "hash", "label", "vector", "lowest", "copies").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    lowest = named.groupBy("root").agg(F.min("lowest").alias("component_id"))
    verdict = named.join(lowest, "root").join(counts, "class").select("hash", "label", "vector", "component_id", (F.col("n") + F.col("copies") - 1).alias("n_links"))
    out = rows.join(verdict, [rows.hash == verdict.hash, rows.label == verdict.label, rows.vector == verdict.vector], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
