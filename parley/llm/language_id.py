"""Language identification by n-gram filters: a bit-sliced Bloom filter whose every slot is a bit mask of languages.

An n-gram is four UTF-8 bytes of a lower-cased text, its words set off by single spaces. A language contains those
n-grams whose rate among its training n-grams is at least ``SHARE`` of their highest rate in any language: every n-gram
has a language, however rare it is, and the strays of texts that mix languages have none. All sets lie in one filter:
slot i holds, for every language, bit i of that language's Bloom filter, so one n-gram's slots, ANDed, give the mask of
all languages that contain it. For a text the bits of its n-grams are counted by language, and each count is
corrected for the filter's own false positive rate in that language. The largest corrected share decides.

The filter is sized by the largest set. What is learned from is a bounded sample, ``MAX_LABELLED`` rows a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import blocks as B
from parley.llm.folds import is_held_out
from parley.llm.shared import checkpointed, map_texts

N = 4
SHARE = 0.1
#: Bound on the rows that a language is learned from; where it has more, they are thinned to about that many by hash.
MAX_LABELLED = 20_000
SLOTS_PER_GRAM = 6
LEAST_SLOTS, MOST_SLOTS = 1 << 14, 1 << 23  # 64 MB for each 64 languages; beyond it false positives rise, and are corrected for
HASHES = 3
UNKNOWN = "und"
FOLD_GRAMS = 1 << 22


def _separated(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts with every byte that is no letter turned into a space, and a space on either side of a text."""
    lower = pc.binary_join_element_wise(pc.utf8_lower(pc.fill_null(column, "")), "", " ")
    lower = pc.binary_join_element_wise("", lower, " ")
    data, offsets = B.flat(lower)
    return _LETTERS[data], offsets


_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[:128] = 32
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the texts as unsigned integers, without those that have two spaces in a row; and the text of each."""
    data, offsets = _separated(column)
    if len(data) < N:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    x = data.astype(np.uint32)
    gram = x[:-3] | (x[1:-2] << np.uint32(8)) | (x[2:-1] << np.uint32(16)) | (x[3:] << np.uint32(24))
    space = data == 32
    pair = space[:-1] & space[1:]
    good = ~(pair[:-2] | pair[1:-1] | pair[2:])
    at = np.flatnonzero(good)
    return gram[at], np.searchsorted(offsets, at, side="right") - 1  # an n-gram over two texts would have two spaces


def slots_of(gram: np.ndarray, slots: int) -> list[np.ndarray]:
    """slots: a power of two."""
    h = B.mix(gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    step = (h >> np.uint64(40)) | np.uint64(1)
    return [((h + np.uint64(k) * step) & np.uint64(slots - 1)).astype(np.int64) for k in range(HASHES)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (language, n-gram) of a task, folded whenever the buffer is full."""
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def out() -> pa.RecordBatch:
        parts = []
        for lang, xs in held.items():
            g, n = np.unique(np.concatenate(xs), return_counts=True)
            parts.append((pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*parts, strict=True)], names=["lang", "gram", "n"])

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for block in B.blocks(batch.column("text")):
            g, doc = grams(batch.column("text").slice(block.first, block.n_docs))
            own = np.array([langs[block.first + i] for i in range(block.n_docs)], object)
            names, of = np.unique(own.astype(str), return_inverse=True)
            for k, lang in enumerate(names):
                held.setdefault(str(lang), []).append(g[of[doc] == k])
            size += len(g)
            if size >= FOLD_GRAMS:
                yield out()
                held, size = {}, 0
    if held:
        yield out()


@dataclass
class Filter:
    """languages, the one with the most rows, and the slots: uint64 masks, one column for each 64 languages."""

    languages: list[str]
    commonest: int
    slots: np.ndarray

    def __post_init__(self) -> None:
        self.false_rate = np.array([self._bits(self.slots, k).mean() ** HASHES if len(self.slots) else 0.0 for k in range(len(self.languages))])

    @staticmethod
    def _bits(masks: np.ndarray, language: int) -> np.ndarray:
        return (masks[:, language // 64] >> np.uint64(language % 64)) & np.uint64(1)

    def masks(self, gram: np.ndarray) -> np.ndarray:
        """Of each n-gram, the mask of all languages whose filter has it."""
        first, *rest = slots_of(gram, len(self.slots))
        out = self.slots[first]
        for s in rest:
            out &= self.slots[s]
        return out

    def shares(self, column: pa.Array) -> np.ndarray:
        """Share of each text's n-grams that each language contains, corrected for false positives; (texts, languages)."""
        gram, doc = grams(column)
        sizes = np.maximum(np.bincount(doc, minlength=len(column)), 1)
        kinds, of = np.unique(gram, return_inverse=True)
        masks = self.masks(kinds)
        out = np.zeros((len(column), len(self.languages)))
        for k in range(len(self.languages)):
            hits = np.bincount(doc, self._bits(masks, k)[of].astype(np.float64), len(column)) / sizes
            out[:, k] = np.clip((hits - self.false_rate[k]) / max(1 - self.false_rate[k], 1e-9), 0, 1)
        return out


def containing(counts: DataFrame, totals: DataFrame, share: float = SHARE) -> DataFrame:
    """(gram, lang) of all languages that contain an n-gram. counts: lang, gram, n; totals: lang, total."""
    rates = counts.join(totals, "lang").select("gram", "lang", (F.col("n") / F.col("total")).alias("rate"))
    return rates.join(rates.groupBy("gram").agg(F.max("rate").alias("most")), "gram").where(F.col("rate") >= share * F.col("most")).select("gram", "lang")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = MAX_LABELLED) -> Filter:
    """The filter of the rows of ``docs`` with a language, of each at most about ``most``. Counts are folded in the tasks and summed in Spark.

    Rows are thinned by their text's hash, so rows that repeat are kept or left together. To the driver come the languages
    and the bounded sample's distinct n-grams, as numbers.
    """
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("rows")).persist()
    drawn = F.xxhash64("text", F.lit("language")).bitwiseAND((1 << 53) - 1) / float(1 << 53)
    rows = rows.join(sizes, "lang").where(drawn * F.col("rows") < most).select("lang", "text")
    counts = checkpointed(map_texts(rows, _counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    common = {r.lang: r.rows for r in sizes.collect()}
    sizes.unpersist()
    languages = sorted(common)
    found = containing(counts, counts.groupBy("lang").agg(F.sum("n").alias("total")))
    found = found.groupBy("lang").agg(F.collect_list("gram").alias("grams")).toArrow()
    members = {name: np.array(grams, np.int64) for name, grams in zip(found["lang"].to_pylist(), found["grams"].to_numpy(), strict=True)}
    need = SLOTS_PER_GRAM * max((len(g) for g in members.values()), default=0)
    slots = np.zeros((min(max(LEAST_SLOTS, 1 << max(need - 1, 0).bit_length()), MOST_SLOTS), max(1, -(-len(languages) // 64))), np.uint64)
    for k, name in enumerate(languages):
        for s in slots_of(members.get(name, np.empty(0, np.int64)), len(slots)):
            slots[s, k // 64] |= np.uint64(1 << (k % 64))
    return Filter(languages, max(range(len(languages)), key=lambda k: (common[languages[k]], -k), default=0), slots)


def identify(docs: DataFrame, found: Filter, doc_id: str = "doc_id", text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """(doc_id, *keep, lang_pred, score), one row for each row of ``docs``; only the text is looked at.

    ``und`` with score 0 where the text is null or has no letter, and where no language was learned. Else the score
    is the winner's corrected share among all languages' shares, 0 to 1; ties go to the first name in order, and a
    text without any learned n-gram to the language with the most rows, with score 0. Each row is decided by its text
    alone: repeats are alike, null ids pass through, a very long text is read whole, other columns are not looked at.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), *(keep or []), F.col(text).alias("text"))
    names = rows.columns[:-1]
    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(found)  # 8 bytes a slot for each 64 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        languages = np.array([*own.languages, UNKNOWN], object)
        for batch in batches:
            for block in B.blocks(batch.column("text")):
                part = batch.slice(block.first, block.n_docs)
                column = pc.fill_null(part.column("text"), "")
                letters = pc.match_substring_regex(column, r"\p{L}").to_numpy(zero_copy_only=False)
                best, score = np.full(len(column), len(own.languages)), np.zeros(len(column))
                if own.languages:
                    shares = own.shares(column)
                    total = shares.sum(axis=1)
                    best = np.where(letters, np.where(total > 0, shares.argmax(axis=1), own.commonest), best)
                    score = np.where(letters & (total > 0), shares.max(axis=1) / np.maximum(total, 1e-12), 0.0)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(languages[best], pa.string()), pa.array(score)], names=schema.names)

    return map_texts(rows, run, schema)


def identify_held_out(docs: DataFrame, folds: int = 4, held: int = 2, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows whose fold is not ``held``, predicted for all."""
    mask = is_held_out(doc_id, folds, held)
    return identify(docs, fit(docs.where(~mask), text, lang), doc_id, text, [mask.alias("held_out")])
