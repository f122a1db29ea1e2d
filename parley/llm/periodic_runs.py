"""Periodic runs of words, by divide and conquer over word ids (Main and Lorentz, 1984).

A run is a stretch of words with smallest period q whose length is at least ``LEAST_PERIODS`` times q and
``LEAST_WORDS``, and that no neighbouring word extends with period q. Words are interned, so a text is a sequence of
numbers. It is halved again and again; a run crosses the midpoint of some half. There at least two of its periods lie
on one side, so the run shows in how far the words from the midpoint m on equal those from m + p on (the Z-function of
the text from m), and how far the words before m equal those before m + p (the Z-function of the text read backwards);
likewise for m - p. Each pair of Z-values gives a whole stretch of period p, extended as far as it goes. The same
stretch can be found with several periods and at several midpoints: the smallest period is kept, once.

All halves of one depth of all texts of a block are taken together as arrays. A shift has a Z-value of 0 unless the
two words around the midpoint come again there, so only these are worked out. They are, in doubling steps, by names:
two places have the same name at level k if the 2**k words from there on are equal (Karp, Miller and Rosenberg, 1972).
Names are exact, no hashes, and only places whose words come again within their text have one, so that the levels end
soon in ordinary texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import blocks as B
from parley.llm.shared import map_texts

LEAST_PERIODS = 4
LEAST_WORDS = 6
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _numbered(keys: np.ndarray) -> np.ndarray:
    """A number from 0 on for each distinct key."""
    return pa.array(keys).dictionary_encode().indices.to_numpy().astype(np.int64)


def _names(ids: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """By level k, the name of the 2**k words from each place on; -1 where they don't come again within the text."""
    n = len(ids)

    def named(at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        names = _numbered(keys)
        again = np.bincount(names)[names] > 1
        out = np.full(n, -1, np.int64)
        out[at[again]] = names[again]
        return out

    levels = [named(np.arange(n), ids + doc * (ids.max() + 1))]
    while True:
        last, width = levels[-1], 1 << len(levels) - 1
        at = np.flatnonzero((last[: n - width] >= 0) & (last[width:] >= 0) & (doc[: n - width] == doc[width:])) if n > width else np.empty(0, np.int64)
        level = named(at, last[at] * (last.max() + 1) + last[at + width]) if len(at) else np.full(0, -1)
        if not len(level) or level.max() < 0:
            return levels
        levels.append(level)


def _forward(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from the places ``a`` on equal those from the later places ``b`` on, in the same text."""
    out, n = np.zeros(len(a), np.int64), len(levels[0])
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + out, np.minimum(b + out, n - 1)
        same = (b + out < n) & (levels[k][np.minimum(x, n - 1)] >= 0) & (levels[k][np.minimum(x, n - 1)] == levels[k][y])
        out[same] += 1 << k
    return out


def _backward(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words just before the places ``a`` equal those just before the later places ``b``, in the same text."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a - out - (1 << k), b - out - (1 << k)
        same = (x >= 0) & (levels[k][np.maximum(x, 0)] >= 0) & (levels[k][np.maximum(x, 0)] == levels[k][np.maximum(y, 0)])
        out[same] += 1 << k
    return out


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the interval, place) for every place of the intervals from ``first`` to before ``last``."""
    sizes = np.maximum(last - first, 0)
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of] + first[of]


def _least(start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each stretch once, with its smallest period, by start and then period."""
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, period = start[fresh], stop[fresh], period[fresh]
    order = np.lexsort((period, start))
    return start[order], stop[order], period[order]


def find_runs(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, period) of all runs in texts of word ids that lie one after the other, text i from offsets[i] to offsets[i + 1]."""
    none = np.empty(0, np.int64)
    sizes = np.diff(offsets)
    if not len(ids) or sizes.max() < LEAST_WORDS:
        return none, none, none
    levels = _names(ids.astype(np.int64), np.repeat(np.arange(len(sizes)), sizes))
    if len(levels) < 2:
        return none, none, none
    two = levels[1]
    found = [(none, none, none)]
    low, high = offsets[:-1], offsets[1:]
    while True:
        wide = high - low >= LEAST_WORDS
        low, high = low[wide], high[wide]
        if not len(low):
            break
        mid = (low + high) // 2
        live = two[mid - 1] >= 0  # the two words around the midpoint come again somewhere
        m = mid[live]
        of, at = _spread(m - 1 - (m - low[live]) // 2, m + (high[live] - m) // 2)
        hit = (two[at] == two[m - 1][of]) & (at != m[of] - 1)
        a, b = m[of[hit]], at[hit] + 1
        a, b = np.minimum(a, b), np.maximum(a, b)
        start, period = a - _backward(levels, a, b), b - a
        stop = b + _forward(levels, a, b)
        enough = stop - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        found.append(_least(start[enough], stop[enough], period[enough]))
        low, high = np.concatenate([low, mid]), np.concatenate([mid, high])
    return _least(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _collapsed(words: list[bytes], drop: np.ndarray) -> str:
    return b" ".join([words[i] for i in np.flatnonzero(~drop).tolist()] if drop.any() else words).decode(errors="replace")


def _of_block(block: B.Block) -> tuple[pa.Array, list[str]]:
    """The runs of each text, and the text without the repeated words."""
    starts, ends, doc = B.words(block)
    closed = np.cumsum(ends - starts)
    ids, _ = B.distinct(B.without_space(block.data), closed - (ends - starts), closed)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=block.n_docs))]).astype(np.int64)
    start, stop, period = find_runs(ids, offsets)
    of = np.searchsorted(offsets, start, side="right") - 1
    steps = np.zeros(len(ids) + 1, np.int64)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, stop, -1)
    drop = np.cumsum(steps[:-1]) > 0
    texts = []
    for i in range(block.n_docs):
        words = block.data[block.offsets[i] : block.offsets[i + 1]].tobytes().split()
        texts.append(_collapsed(words, drop[offsets[i] : offsets[i + 1]]))
    cuts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=block.n_docs))])
    rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - offsets[of], stop - start, period)], names=["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rows), texts


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed), one row for each row of ``docs``.

    Words are what lies between white space (0x20, 0x09 to 0x0D), compared byte by byte and numbered from 0. ``runs``
    has start, length and smallest period of each run, by start and then period. ``collapsed`` is the text's words
    joined by one space, but for those that some run contains after its first period. A null, empty or blank text has
    no runs and an empty ``collapsed``. Each row depends on its text alone, so repeated rows and null ids need no rule;
    nothing is shuffled and other columns are not looked at. A very long text is read whole, in a block of its own:
    memory and time grow with its words, times the logarithm of their number.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("runs", T._parse_datatype_string(RUNS)), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in B.blocks(batch.column(1)):
                runs, texts = _of_block(block)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n_docs), runs, pa.array(texts, pa.string())], names=schema.names)

    return map_texts(docs, run, schema)


def highest(runs: str = "runs") -> Column:
    """The run with the greatest length in periods; of equal ones the first start, then the smallest period. Null without runs."""
    kind = RUNS.removeprefix("array<").removesuffix(">")
    better = lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)
    return F.aggregate(runs, F.lit(None).cast(kind), better)


def repeated_from(words: Column, at: Column, period: Column) -> Column:
    """An array of as many words: those from place ``at`` on are the ``period`` ones there, again and again. Nothing changes at period 0."""
    n = F.size(words)
    times = F.ceil((n - at) / F.greatest(period, F.lit(1))).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(words, at + 1, period), times)), F.lit(1), n - at)
    return F.concat(F.slice(words, F.lit(1), at), again)
