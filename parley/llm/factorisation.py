"""A factorisation machine for the quality of texts (Rendle, 2010).

Features of a text are its distinct words, hashed into ``BUCKETS`` (weighted by the logarithm of their number, all of
them scaled to length 1), statistics of its structure, and numeric metadata columns. Statistics and metadata are cut
into bins at quantiles of the learned rows; each bin is a feature, a missing number is one too. The score is

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

through the logistic function, with ``FACTORS`` numbers v of each feature. The sum over pairs is half of
sum_f (sum_i v_if x_i)**2 - sum_if (v_if x_i)**2, so that a text costs time linear in its words.

It is learned in rounds over a bounded sample of labelled rows, whose features lie in files: each task sums the
gradient of its rows, the driver adds the tasks' sums (BUCKETS numbers each, whatever the rows) and takes a step of Adam.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import blocks as B
from parley.llm.folds import fold
from parley.llm.shared import checkpointed, map_texts

BUCKETS = 1 << 14
FACTORS = 8
#: Bound on the labelled rows that are learned from, of each class; copies of a row count as one with a weight.
MAX_LABELLED = 20_000
ROUNDS = 60
STEP = 0.1
DECAY = 1e-4  # of squared weights, as a share of the loss
TASKS = 8  # that the sample's features are dealt out to
BIN = 0.35  # x of the feature that a bin is
_PROBS = [0.005, 0.01, 0.02, 0.04, *np.linspace(0.08, 0.92, 15).tolist(), 0.96, 0.98, 0.99, 0.995]
STATISTICS = ("bytes", "words", "word_bytes", "upper", "digits", "marks", "wide", "capitals", "marked", "single", "distinct", "commonest", "stutter", "lines", "line_bytes", "repeated_lines")

_UPPER, _DIGIT, _LETTER, _MARK, _WIDE, _OTHER = range(6)


def _classes() -> np.ndarray:
    table = np.full(256, _OTHER, np.uint8)
    table[0x21:0x7F] = _MARK
    for first, last, kind in ((0x30, 0x39, _DIGIT), (0x41, 0x5A, _UPPER), (0x61, 0x7A, _LETTER), (0x80, 0xFF, _WIDE)):
        table[first : last + 1] = kind
    return table


_CLASS = _classes()
_DOC_BITS = 53  # a block has at most 2000 texts: 11 bits above these


def _lines(block: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the number of its lines that have bytes, and of those that repeat an earlier line of it."""
    data, offsets = block.data, block.offsets
    line = data != 10
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(line & (np.concatenate([[True], ~line[:-1]]) | edge[:-1])) if len(data) else np.empty(0, np.int64)
    ends = np.flatnonzero(line & (np.concatenate([~line[1:], [True]]) | edge[1:])) + 1 if len(data) else starts
    doc = np.searchsorted(offsets, starts, side="right") - 1
    keys = np.unique(_keyed(doc, B.span_hashes(data, starts, ends)))
    n = np.bincount(doc, minlength=block.n_docs)
    return n, n - np.bincount((keys >> np.uint64(_DOC_BITS)).astype(np.int64), minlength=block.n_docs)


def _keyed(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return (doc.astype(np.uint64) << np.uint64(_DOC_BITS)) | (hashes >> np.uint64(64 - _DOC_BITS))


def features(block: B.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(statistics, a row for each text; then text, bucket and x of each of their distinct words, by text)."""
    n, data = block.n_docs, block.data
    starts, ends, doc = B.words(block)
    hashes = B.span_hashes(data, starts, ends)
    keys, count = np.unique(_keyed(doc, hashes), return_counts=True)
    of = (keys >> np.uint64(_DOC_BITS)).astype(np.int64)
    bucket = ((keys >> np.uint64(_DOC_BITS - 14)) & np.uint64(BUCKETS - 1)).astype(np.int32)
    x = np.log1p(count)
    x /= np.sqrt(np.bincount(of, x * x, n))[of]

    size = np.diff(block.offsets)
    kinds = np.bincount(np.repeat(np.arange(n), size) * 6 + _CLASS[data], minlength=6 * n).reshape(n, 6)
    words, distinct = np.bincount(doc, minlength=n), np.bincount(of, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, of, count)
    stutter = np.flatnonzero((hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1]))
    capital = np.concatenate([[0], np.cumsum(_CLASS[data] == _UPPER)])
    letter = np.concatenate([[0], np.cumsum(_CLASS[data] == _LETTER)])
    shouted = (capital[ends] - capital[starts] >= 2) & (letter[ends] == letter[starts])
    marked = _CLASS[data[ends - 1]] == _MARK
    lines, again = _lines(block)
    share = lambda a, b: a / np.maximum(b, 1)
    by_word = lambda mask: share(np.bincount(doc[mask], minlength=n), words)
    visible = size - kinds[:, _OTHER]
    columns = [size, words, share(np.bincount(doc, ends - starts, n), words), *(share(kinds[:, k], visible) for k in (_UPPER, _DIGIT, _MARK, _WIDE)), by_word(shouted), by_word(marked), by_word(ends - starts == 1)]
    columns += [share(distinct, words), share(most, words), share(np.bincount(doc[stutter], minlength=n), words), lines, share(size, lines), share(again, lines)]
    return np.column_stack(columns).astype(np.float64), of, bucket, x.astype(np.float32)


@dataclass
class Machine:
    """Edges of the bins of each statistic and metadata column, and w (first) and v of each feature. Small: it travels with the tasks."""

    edges: list[np.ndarray]
    metadata: tuple[str, ...]
    bias: float
    weights: np.ndarray  # (features, 1 + FACTORS), the buckets first

    @staticmethod
    def places(edges: list[np.ndarray]) -> np.ndarray:
        """The first feature of each statistic, and how many features there are. A statistic has a bin more than edges, and one for missing numbers."""
        return BUCKETS + np.cumsum([0, *(len(e) + 2 for e in edges)])

    @staticmethod
    def binned(edges: list[np.ndarray], numbers: np.ndarray) -> np.ndarray:
        """The feature of each text (row) and statistic (column)."""
        places = Machine.places(edges)
        out = np.empty(numbers.shape, np.int64)
        for k, e in enumerate(edges):
            out[:, k] = places[k] + np.where(np.isnan(numbers[:, k]), len(e) + 1, np.searchsorted(e, numbers[:, k], side="right"))
        return out

    def logits(self, numbers: np.ndarray, of: np.ndarray, bucket: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.bias + _linear(self.weights, *_joined(Machine.binned(self.edges, numbers), of, bucket, x), len(numbers))[0]


def _joined(bins: np.ndarray, of: np.ndarray, bucket: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, x) of bins and words together."""
    n, d = bins.shape
    return np.concatenate([of, np.repeat(np.arange(n), d)]), np.concatenate([bucket, bins.ravel()]), np.concatenate([x, np.full(n * d, BIN, np.float32)])


def _linear(weights: np.ndarray, of: np.ndarray, feature: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(w x + the sum over pairs, by the sum-of-squares identity; the sums of v x by factor) of each text."""
    out, sums = np.bincount(of, weights[feature, 0] * x, n), np.empty((n, FACTORS))
    for f in range(FACTORS):
        vx = weights[feature, 1 + f] * x
        sums[:, f] = np.bincount(of, vx, n)
        out += 0.5 * (sums[:, f] ** 2 - np.bincount(of, vx * vx, n))
    return out, sums


def gradient(weights: np.ndarray, bias: float, y: np.ndarray, weight: np.ndarray, of: np.ndarray, feature: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(loss, gradient of the bias) and the gradient of all weights, summed over these texts."""
    s, sums = _linear(weights, of, feature, x, len(y))
    s += bias
    g = weight * (1 / (1 + np.exp(-np.clip(s, -40, 40))) - y)
    loss = float((weight * (np.logaddexp(0, s) - y * s)).sum())
    out, gx = np.empty_like(weights, np.float64), g[of] * x
    out[:, 0] = np.bincount(feature, gx, len(weights))
    for f in range(FACTORS):
        out[:, 1 + f] = np.bincount(feature, gx * (sums[of, f] - weights[feature, 1 + f] * x), len(weights))
    return np.array([loss, g.sum()]), out


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (y, weight, numbers, buckets, x) of the texts of sample()."""
    for batch in batches:
        more = batch.column("more").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 0))
        for block in B.blocks(batch.column("text")):
            numbers, of, bucket, x = features(block)
            numbers = np.column_stack([numbers, more[block.first : block.first + block.n_docs]])
            own = batch.slice(block.first, block.n_docs)
            cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=block.n_docs))]), pa.int32())
            wide = pa.array(np.arange(block.n_docs + 1) * numbers.shape[1], pa.int32())
            columns = [own.column("y"), own.column("weight"), pa.ListArray.from_arrays(wide, pa.array(numbers.ravel())), *(pa.ListArray.from_arrays(cuts, pa.array(v)) for v in (bucket, x))]
            yield pa.RecordBatch.from_arrays(columns, names=["y", "weight", "numbers", "buckets", "x"])


def _numbers(batch: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    """Metadata columns as doubles, nan for null."""
    return np.column_stack([np.empty((batch.num_rows, 0)), *(batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names)])


def _summed(weights: np.ndarray, bias: float, edges: list[np.ndarray]):
    """One row for each task: its gradient."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, total = np.zeros(2), np.zeros(weights.shape)
        for batch in batches:
            y, weight = (batch.column(c).to_numpy().astype(np.float64) for c in ("y", "weight"))
            numbers, buckets = batch.column("numbers"), batch.column("buckets")
            bins = Machine.binned(edges, numbers.flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1))
            of = np.repeat(np.arange(len(y)), buckets.value_lengths().to_numpy())
            a, b = gradient(weights, bias, y, weight, *_joined(bins, of, buckets.flatten().to_numpy(), batch.column("x").flatten().to_numpy()))
            head, total = head + a, total + b
        yield pa.RecordBatch.from_arrays([pa.array([head.tobytes()]), pa.array([total.astype(np.float32).tobytes()])], names=["head", "gradient"])

    return run


def sample(docs: DataFrame, labels: DataFrame, learn: Callable[[Column], Column], label: str, most: int, doc_id: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = ()) -> DataFrame:
    """(y, weight, text, more: the metadata as doubles): of each class about ``most`` different rows at most that ``labels`` marks and ``learn`` admits by their ids.

    Where there are more, first ids and then rows are thinned by a hash. weight is the number of copies of a row. Ids with
    several labels are 1 if any is 1; null labels and ids are left out.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).alias("y")).where(learn(F.col("id")))

    def thinned(rows: DataFrame, counts: DataFrame, salt: str, *by: str) -> DataFrame:
        share = F.lit(1.0)
        for r in counts.groupBy("y").agg(F.count("*").alias("n")).collect():  # two rows
            share = F.when(F.col("y") == r.y, min(1.0, most / r.n)).otherwise(share)
        return rows.where((F.xxhash64(*by, F.lit(salt)).bitwiseAND((1 << 53) - 1) / float(1 << 53)) < share)

    known = F.broadcast(thinned(known, known, "ids", "id"))  # about 2 * most ids
    ids = docs.select(F.col(doc_id).alias("id"))
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.array(*(F.col(c).cast("double") for c in metadata)).cast("array<double>").alias("more"))
    rows = thinned(rows.join(known, "id"), ids.join(known, "id"), "rows", "id", "text", "more")
    rows = rows.groupBy("id", "y", "text", "more").agg(F.count("*").cast("double").alias("weight"))
    return rows.select("y", "weight", "text", "more")


def fit(docs: DataFrame, labels: DataFrame, learn: Callable[[Column], Column], label: str = "quality", doc_id: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = (), most: int = MAX_LABELLED, rounds: int = ROUNDS) -> Machine:
    """Learns from the rows of sample(). Runs a small Spark job a round. Without labelled rows every score is 0.5; with one class alone, near it."""
    rows = map_texts(sample(docs, labels, learn, label, most, doc_id, text, metadata), _prepared, "y int, weight double, numbers array<double>, buckets array<int>, x array<float>")
    rows = checkpointed(rows.repartition(TASKS))
    names = [*STATISTICS, *metadata]
    flat = rows.select(*(F.when(~F.isnan(F.col("numbers")[k]), F.col("numbers")[k]).alias(f"n{k}") for k in range(len(names))))
    edges = [np.unique(q) for q in flat.approxQuantile(flat.columns, _PROBS, 0.001)]
    total = rows.agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("y")).alias("ones")).first()
    size = int(Machine.places(edges)[-1])
    weights = np.zeros((size, 1 + FACTORS))
    weights[:, 1:] = np.random.default_rng(0).normal(0, 0.05, (size, FACTORS))
    bias = 0.0
    if not total.n:
        weights[:] = 0
        return Machine(edges, metadata, bias, weights.astype(np.float32))
    bias = float(np.log((total.ones + 1) / (total.n - total.ones + 1)))
    mean, square, bias_mean, bias_square = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0
    for k in range(1, rounds + 1):
        parts = rows.mapInArrow(_summed(weights.astype(np.float32), bias, edges), "head binary, gradient binary").collect()  # TASKS rows of the machine's size
        heads = sum(np.frombuffer(p.head) for p in parts) / total.n
        g = sum(np.frombuffer(p.gradient, np.float32).astype(np.float64) for p in parts).reshape(weights.shape) / total.n + DECAY * weights
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        step = STEP * min(1.0, 2 - 2 * k / (rounds + 1))  # the second half slows down to 0
        weights = weights - step * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-6)
        bias_mean, bias_square = 0.9 * bias_mean + 0.1 * heads[1], 0.99 * bias_square + 0.01 * heads[1] ** 2
        bias -= step * (bias_mean / (1 - 0.9**k)) / (np.sqrt(bias_square / (1 - 0.99**k)) + 1e-6)
    return Machine(edges, metadata, float(bias), weights.astype(np.float32))


def score(docs: DataFrame, model: Machine, text: str = "text") -> DataFrame:
    """Adds score (0 to 1, higher where label 1 is likelier) and predicted (1 from 0.5 on) to the rows of ``docs``, without the text.

    Null texts count as empty, null metadata as missing. Older columns of these names are replaced; the others pass
    through. Each row depends on its text and metadata alone, so repeated rows and null ids need no rule. A very long text
    is read whole, in a block of its own. An empty table stays empty.
    """
    keep = [c for c in docs.columns if c not in (text, "score", "predicted")]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = _numbers(batch, model.metadata)
            for block in B.blocks(batch.column(text)):
                own = batch.slice(block.first, block.n_docs)
                numbers, *words = features(block)
                s = model.logits(np.column_stack([numbers, more[block.first : block.first + block.n_docs]]), *words)
                p = 1 / (1 + np.exp(-np.clip(s, -40, 40)))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in keep), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=schema.names)

    return map_texts(docs, run, schema)


def fit_folds(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = ()) -> Machine:
    """Learned without the rows whose id's fold of 3 is 1."""
    return fit(docs, labels, lambda c: fold(c, 3) != 1, metadata=metadata)
