"""Toxicity by two class-conditional Kneser-Ney models over one shared backoff.

A whole word is backed off to its stem (its first ``STEM`` code points), a stem to what both classes share. Each class
has its own counts of words and of stems, discounted as modified Kneser-Ney does. What the discounts free goes to the
next level: from the words to the class's stems, times how the words of a stem divide in both classes together; from
the stems to the number of different words that a stem has in either class. Both classes give the lower level the same
share (the larger of theirs), so an expression that neither has seen speaks for neither.

Toxic words are few in a long text, so log-likelihoods are compared passage by passage: the difference of the two over
``PASSAGE`` tokens in a row, divided by their number; the passage with the largest difference decides for the text. A
logistic curve, fitted on labelled rows held back from the counts, turns it into a score.

Of each word and stem only its log ratio is kept, in sorted hash arrays that the workers map. A word that training
lacks has its stem's ratio, one whose stem it lacks too has 0.
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
from parley.llm import kneser_ney as K
from parley.llm import shared
from parley.llm.folds import fold
from parley.llm.shared import checkpointed, map_texts

STEM = 4
PASSAGE = 2
#: Bound on the labelled rows that are learned from: of each class, about this many for the counts and a quarter of it for the curve.
MAX_LABELLED = 20_000
SHARD_BYTES = 16_000_000
FOLD_TOKENS = 1_000_000


def tokens_of(block: B.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hash, stem hash and document of the block's tokens, each document closed by END."""
    starts, ends, doc = B.words(block)
    lead = (block.data & 0xC0) != 0x80  # first bytes of code points
    where = np.append(np.flatnonzero(lead), [len(block.data)] * STEM)
    cuts = np.minimum(where[np.cumsum(lead)[starts] - 1 + STEM], ends) if len(starts) else ends
    place = np.arange(len(starts)) + doc
    sizes = np.bincount(doc, minlength=block.n_docs) + 1
    out = np.full((2, len(starts) + block.n_docs), B.END, np.uint64)
    out[0, place] = B.span_hashes(block.data, starts, ends)
    out[1, place] = B.span_hashes(block.data, starts, cuts)
    return out[0], out[1], np.repeat(np.arange(block.n_docs), sizes)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, stem, toxic, ordinary): counts of a task, folded whenever the buffer is full."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = 0

    def out() -> pa.RecordBatch:
        word, stem, y = (np.concatenate(x) for x in zip(*held, strict=True))
        kinds, first, of = np.unique(word, return_index=True, return_inverse=True)
        toxic = np.bincount(of, y, len(kinds)).astype(np.int64)
        columns = [kinds.view(np.int64), stem[first].view(np.int64), toxic, np.bincount(of, minlength=len(kinds)) - toxic]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["word", "stem", "toxic", "ordinary"])

    for batch in batches:
        labels = batch.column("y").to_numpy(zero_copy_only=False)
        for block in B.blocks(batch.column("text")):
            word, stem, doc = tokens_of(block)
            held.append((word, stem, labels[block.first + doc]))
            n += len(word)
            if n >= FOLD_TOKENS:
                yield out()
                held, n = [], 0
    if held:
        yield out()


CLASSES = ("toxic", "ordinary")


def _sums(rows: DataFrame) -> dict[str, float]:
    """For each class: all tokens, and the numbers of rows with 1, 2, 3, 4 and 3 or more of them."""
    parts = [F.sum(c).alias(f"{c}_n") for c in CLASSES]
    parts += [F.sum((F.col(c) == k).cast("long")).alias(f"{c}_{k}") for c in CLASSES for k in range(1, 5)]
    parts += [F.sum((F.col(c) >= 3).cast("long")).alias(f"{c}_many") for c in CLASSES]
    return {k: v or 0 for k, v in rows.agg(*parts, F.count("*").alias("rows")).first().asDict().items()}


def _discounted(sums: dict[str, float]) -> tuple[list[Column], float]:
    """Both classes' discounted shares, scaled so that they leave the same mass to the level below; and that mass."""
    own, left = [], []
    for c in CLASSES:
        d = K.discounts([int(sums[f"{c}_{k}"]) for k in range(1, 5)])
        n = max(sums[f"{c}_n"], 1)
        left.append(min(max((d[0] * sums[f"{c}_1"] + d[1] * sums[f"{c}_2"] + d[2] * sums[f"{c}_many"]) / n, 1e-9), 1.0) if sums[f"{c}_n"] else 1.0)
        less = F.when(F.col(c) == 0, 0.0).when(F.col(c) == 1, d[0]).when(F.col(c) == 2, d[1]).otherwise(d[2])
        own.append((F.col(c) - less) / F.lit(float(n)))
    most = max(left)
    return [x * F.lit((1 - most) / (1 - one) if one < 1 else 0.0) for x, one in zip(own, left, strict=True)], most


def ratios(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hash, ratio) of all words and of all stems: log P(it | toxic) - log P(it | ordinary) in nats. counts: word, stem, toxic, ordinary."""
    words = counts.groupBy("word").agg(F.min("stem").alias("stem"), *(F.sum(c).alias(c) for c in CLASSES))
    words = checkpointed(words)
    stems = checkpointed(words.groupBy("stem").agg(*(F.sum(c).alias(c) for c in CLASSES), F.count("*").alias("kinds")))
    sums = _sums(stems)
    own, left = _discounted(sums)
    below = (F.col("kinds") + 1) / F.lit(float(_kinds(stems) + sums["rows"] + 1))
    stems = stems.select("stem", "kinds", (F.col("toxic") + F.col("ordinary")).alias("pooled"), *(x + left * below for x in own))
    stems = stems.toDF("stem", "kinds", "pooled", "p_toxic", "p_ordinary")
    own, left = _discounted(_sums(words))
    share = (F.col("toxic") + F.col("ordinary") + 1) / (F.col("pooled") + F.col("kinds"))
    joined = words.join(stems, "stem")
    toxic, ordinary = (x + left * F.col(f"p_{c}") * share for x, c in zip(own, CLASSES, strict=True))
    return joined.select(F.col("word").alias("hash"), F.log(toxic / ordinary).alias("ratio")), stems.select(F.col("stem").alias("hash"), F.log(F.col("p_toxic") / F.col("p_ordinary")).alias("ratio"))


def _kinds(stems: DataFrame) -> int:
    return stems.agg(F.sum("kinds").alias("n")).first().n or 0


def _stored(folder: str, kind: str, shards: int):
    """Writes each shard's hashes, sorted, and their ratios."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            shard, hashes, ratio = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for s in np.unique(shard).tolist():
                mine = (shard == s) & ~np.isnan(ratio)  # the row without a ratio stands for the shard
                held.setdefault(s, []).append((hashes[mine].view(np.uint64), ratio[mine]))
        for s, parts in held.items():
            keys, values = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(keys)
            shared.put(f"{folder}/{kind}-{s:08d}", K._pack(keys[order], values[order]))
        yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64())], names=["n"])

    return run


@dataclass
class Toxicity:
    """Where the arrays lie, and the curve. Small: it travels with the scoring tasks."""

    folder: str
    shards: int
    slope: float = 1.0
    offset: float = 0.0

    def _looked_up(self, kind: str, keys: np.ndarray) -> np.ndarray:
        """The ratios of sorted hashes, nan for those that training lacks."""
        out = np.full(len(keys), np.nan)
        shard = K.shard_of(keys, self.shards)
        first = K._runs(shard)
        for a, b in zip(first, np.append(first, len(keys))[1:], strict=True):
            known, ratio = K._mapped(f"{self.folder}/{kind}-{int(shard[a]):08d}", (np.uint64, np.float64))
            hit, at = K.KneserNey._found(known, keys[a:b])
            out[a:b][hit] = ratio[at]
        return out

    def ratios(self, word: np.ndarray, stem: np.ndarray) -> np.ndarray:
        """Of each token, log P(token | toxic) - log P(token | ordinary) in nats."""
        kinds, of = np.unique(word, return_inverse=True)
        own = self._looked_up("words", kinds)[of]
        lacking = np.flatnonzero(np.isnan(own))
        kinds, of = np.unique(stem[lacking], return_inverse=True)
        own[lacking] = np.nan_to_num(self._looked_up("stems", kinds)[of], nan=0.0)
        return own

    def highest(self, block: B.Block) -> np.ndarray:
        """Each text's largest mean over PASSAGE tokens in a row, its end among them; over all of them where it has fewer."""
        word, stem, doc = tokens_of(block)
        sums = np.concatenate([[0.0], np.cumsum(self.ratios(word, stem))])
        sizes = np.bincount(doc, minlength=block.n_docs)
        ends = np.cumsum(sizes)
        first = np.arange(len(word))
        last = np.minimum(first + PASSAGE, ends[doc])
        whole = (last - first == PASSAGE) | (first == (ends - sizes)[doc])
        means = np.where(whole, (sums[last] - sums[first]) / (last - first), -np.inf)
        return np.maximum.reduceat(means, ends - sizes) if len(means) else means

    def chance(self, highest: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * highest + self.offset, -40, 40)))


def curve_of(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that crosses 0.5 where the fewest of these rows are on the wrong side.

    Of equally good places the widest gap is taken. The slope puts the median of the rows of class 1 beyond it at
    0.95. One class alone leaves a flat curve on that class's side.
    """
    if not len(x) or y.min() == y.max():
        return 0.0, (4.0 if len(y) and y[0] else -4.0)
    order = np.argsort(x)
    x, y = x[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum(1 - y[::-1])[::-1], [0]])  # with the cut before row i
    gap = np.concatenate([[1e-12], np.diff(x), [1e-12]])
    at = max(np.flatnonzero((wrong == wrong[gap > 0].min()) & (gap > 0)), key=lambda i: gap[i])
    cut = x[0] - 1e-3 if at == 0 else x[-1] + 1e-3 if at == len(x) else (x[at - 1] + x[at]) / 2
    above = x[(y == 1) & (x > cut)]
    slope = 3.0 / max(float(np.median(above)) - cut, 1e-3) if len(above) else 100.0
    return float(slope), float(-slope * cut)


def _scored(docs: DataFrame, model: Toxicity, text: str) -> DataFrame:
    keep = [c for c in docs.columns if c not in (text, "highest", "score", "predicted")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("highest", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in B.blocks(batch.column(text), K.SCORE_BYTES):
                own = batch.slice(block.first, block.n_docs)
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in keep), pa.array(model.highest(block))], names=schema.names)

    return map_texts(docs, run, schema)


def fit(docs: DataFrame, labels: DataFrame, learn: Callable[[Column], Column], curve: Callable[[Column], Column], doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_LABELLED) -> Toxicity:
    """Learns from the rows of ``docs`` that ``labels`` marks 0 or 1: by their ids, ``learn`` tells those for the counts, ``curve`` those for the curve.

    Of each class at most about ``most`` rows are counted, and a quarter of that make the curve; where there are more
    they are thinned by the ids' hash. Rows that are for neither count nowhere, nor do their labels. Ids with
    several labels count as 1 if any is 1; null labels and ids are left out. Rows that repeat an id count each, null
    texts are empty. Runs Spark jobs; the arrays stay until the driver ends.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).alias("y"))
    known = known.select("id", "y", learn(F.col("id")).alias("learn"), curve(F.col("id")).alias("curve")).where("learn or curve")
    share = F.lit(1.0)
    for r in known.groupBy("y", "learn").agg(F.count("*").alias("n")).collect():  # four rows
        share = F.when((F.col("y") == r.y) & (F.col("learn") == r.learn), min(1.0, (most if r.learn else most / 4) / r.n)).otherwise(share)
    thin = (F.xxhash64("id", F.lit("toxicity")).bitwiseAND((1 << 53) - 1) / float(1 << 53)) < share
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # The thinned ids are bounded, so they are broadcast; their texts are read from all documents once.
    rows = checkpointed(texts.join(F.broadcast(known.where(thin)), "id"))
    learned = rows.where("learn").select("y", "text")
    size = learned.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    shards, folder = max(1, -(-size // SHARD_BYTES)), shared.new_folder(spark, "toxicity")
    counts = map_texts(learned, _counted, "word long, stem long, toxic long, ordinary long")
    for kind, table in zip(("words", "stems"), ratios(counts), strict=True):
        high = F.shiftrightunsigned("hash", 32)
        table = table.select(F.shiftright(high * shards, 32).cast("int").alias("shard"), "hash", "ratio")
        each = spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(0).cast("long").alias("hash"), F.lit(float("nan")).alias("ratio"))
        table.union(each).repartitionById(shards, F.col("shard")).mapInArrow(_stored(folder, kind, shards), "n long").agg(F.sum("n")).collect()
    found = Toxicity(folder, shards)
    held = _scored(rows.where("curve and not learn").select("y", "text"), found, "text").toPandas()  # two numbers each of a bounded sample
    found.slope, found.offset = curve_of(held["highest"].to_numpy(), held["y"].to_numpy(float))
    return found


def score(docs: DataFrame, model: Toxicity, text: str = "text") -> DataFrame:
    """Adds score and predicted to the rows of ``docs``; null texts count as empty, which is one token, the end.

    The other columns but the text, ``highest`` and older ones of these names pass through. score is 0 to 1, higher where
    a toxic label is likelier; predicted is 1 from 0.5 on. Only the text is looked at, so repeated rows and null ids
    score as their texts do; a very long text is read whole, in a block of its own.
    """
    rows = _scored(docs, model, text)
    chance = 1 / (1 + F.exp(-F.least(F.greatest(F.col("highest") * model.slope + model.offset, F.lit(-40.0)), F.lit(40.0))))
    return rows.withColumn("score", chance).drop("highest").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, model: Toxicity, text: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, whose text is not predicted toxic: the same rows as score() gives predicted 0, repeats too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in B.blocks(batch.column(text), K.SCORE_BYTES):
                yield batch.slice(block.first, block.n_docs).filter(pa.array(model.chance(model.highest(block)) < 0.5))

    return map_texts(docs, run, docs.schema)


def fit_folds(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Toxicity:
    """Learned without the rows whose id's fold of 5 is 0: folds 1 to 3 are counted, fold 4 sets the curve."""
    return fit(docs, labels, lambda c: fold(c, 5).between(1, 3), lambda c: fold(c, 5) == 4, doc_id, text)
