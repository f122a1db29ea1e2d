"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, memory-mapped to score.

Counting is one pass over the texts. Each task hashes its words, folds equal bigrams together in bounded
buffers and sends packed arrays (not rows) to hash ranges ("shards"). A shard's task merges the arrays into
one sorted array of bigram hashes with their counts, writes it to the shared folder, and passes on what the
lower order needs: followers of each context by their counts, and the number of contexts of each word. A
second exchange merges these by word. Folding before every exchange makes the volume of a frequent word or
bigram one entry per task, so no key is hot, and the shard count follows the size of the texts.

Scoring maps the arrays read-only into the worker and looks sorted queries up in them. Pages of a file map
belong to the page cache, not to the worker, so the model may be larger than a worker's memory.

XXH64 stands for a word, and a 64-bit hash of two of those for a bigram; of n random words two collide with probability
n**2 / 2**65. Every hash range has its files, also an empty one: a file that a worker lacks stops the job.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import blocks as B
from parley.llm import shared

FOLD_TOKENS = 2_500_000  # tokens that a counting task holds before it folds equal ones and sends them on
SHARD_BYTES = 16_000_000  # UTF-8 bytes of text for each shard of the model
SCORE_BYTES = 1 << 20
_SENT = pa.schema([("shard", pa.int32()), ("kind", pa.string()), ("payload", pa.binary())])
_SENT_SQL = "shard int, kind string, payload binary"
_STATS = ["n_words", "n_tokens", "n_ends", "contexts", *(f"u{k}" for k in range(1, 5)), *(f"b{k}" for k in range(1, 5)), *(f"c{k}" for k in range(1, 5))]  # u, b, c: words by contexts, bigrams and words by count

Spans = Callable[[B.Block], tuple[np.ndarray, np.ndarray, np.ndarray]]


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards are equal ranges of the hash in ascending order."""
    return (((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(data, np.int64, len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(data, kind, n, at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)


def sequence(block: B.Block, spans: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of the block's documents in order, each closed by END, the token before each, and its document."""
    starts, ends, doc = spans(block)
    tokens = np.full(len(starts) + block.n_docs, B.END, np.uint64)
    tokens[np.arange(len(starts)) + doc] = B.span_hashes(block.data, starts, ends)
    sizes = np.bincount(doc, minlength=block.n_docs) + 1
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = B.BEGIN
    return tokens, before, np.repeat(np.arange(block.n_docs), sizes)


def _rows(parts: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*parts, strict=True), _SENT.types, strict=True)], schema=_SENT)


def _sliced(kind: str, shards: int, keys: np.ndarray, *values: np.ndarray) -> list[tuple[int, str, bytes]]:
    """Packed slices of arrays that are sorted by keys."""
    cut = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
    return [(s, kind, _pack(keys[a:b], *(v[a:b] for v in values))) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]


def _folded(tokens: np.ndarray, before: np.ndarray, shards: int) -> list[tuple[int, str, bytes]]:
    word, n = np.unique(tokens, return_counts=True)
    out = _sliced("word", shards, word, n.astype(np.uint32))
    h = B.pair_hash(before, tokens)
    order = np.argsort(h)
    first = _runs(h := h[order])
    count = np.diff(np.append(first, len(h))).astype(np.uint32)
    pick = order[first]
    before, tokens, shard = before[pick], tokens[pick], shard_of(h[first], shards)
    del h, order, pick
    cut = np.searchsorted(shard, np.arange(shards + 1))
    for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        if b > a:  # followers listed by context, so that a context is sent once
            order = np.argsort(before[a:b])
            context = before[a:b][order]
            first = _runs(context)
            sizes = np.diff(np.append(first, b - a)).astype(np.uint32)
            out.append((s, "pair", _pack(context[first], sizes, tokens[a:b][order], count[a:b][order])))
    return out


def _count(spans: Spans, shards: int, fold_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for block in B.blocks(batch.column("text")):
                tokens, before, _ = sequence(block, spans)
                held.append((tokens, before))
                n += len(tokens)
                if n >= fold_tokens:
                    yield _rows(_folded(*map(np.concatenate, zip(*held, strict=True)), shards))
                    held, n = [], 0
        if held:
            yield _rows(_folded(*map(np.concatenate, zip(*held, strict=True)), shards))

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> dict[int, dict[str, list[bytes]]]:
    out: dict[int, dict[str, list[bytes]]] = {}
    for batch in batches:
        for shard, kind, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out.setdefault(shard, {}).setdefault(kind, []).append(payload)
    return out


def _columns(payloads: list[bytes], *kinds: type) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*(_unpack(p, *kinds) for p in payloads), strict=True)] if payloads else [np.empty(0, k) for k in kinds]


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    first = _runs(keys := keys[order])
    return keys[first], np.add.reduceat(values[order].astype(np.uint64), first) if len(first) else np.empty(0, np.uint64)


def _merge_pairs(folder: str, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, kinds in _gathered(batches).items():
            out = _sliced("word", shards, *_summed(*_columns(kinds.get("word", []), np.uint64, np.uint32)))
            parts = [_unpack(p, np.uint64, np.uint32, np.uint64, np.uint32) for p in kinds.pop("pair", [])]
            if not parts:
                shared.put(f"{folder}/pairs-{shard:08d}", _pack(*(np.empty(0, k) for k in (np.uint64, np.uint8, np.uint64, np.uint64))))
            else:
                before = np.concatenate([np.repeat(c, n) for c, n, _, _ in parts])
                tokens, counts = (np.concatenate([p[k] for p in parts]) for k in (2, 3))
                del parts
                h = B.pair_hash(before, tokens)
                order = np.argsort(h)
                first = _runs(h := h[order])
                h, count = h[first], np.add.reduceat(counts[order].astype(np.uint64), first)
                before, tokens = before[order[first]], tokens[order[first]]
                del order
                high = count >= 255
                shared.put(f"{folder}/pairs-{shard:08d}", _pack(h, np.minimum(count, 255).astype(np.uint8), h[high], count[high]))
                context, of = np.unique(before, return_inverse=True)
                of_kind = [np.bincount(of[m], minlength=len(context)).astype(np.uint32) for m in (count == 1, count == 2, count >= 3)]
                out += _sliced("followers", shards, context, *of_kind)
                word, n = np.unique(tokens, return_counts=True)
                out += _sliced("contexts", shards, word, n.astype(np.uint32))
                out.append((shard, "pairs of count", _pack(np.array([(count == k).sum() for k in range(1, 5)], np.int64))))
            yield _rows([*out, (shard, "none", b"")])

    return run


def _merge_words(folder: str, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, kinds in _gathered(batches).items():
            word, count = _summed(*_columns(kinds.get("word", []), np.uint64, np.uint64))
            context, *of_kind = _columns(kinds.get("followers", []), np.uint64, np.uint32, np.uint32, np.uint32)
            after, n = _summed(*_columns(kinds.get("contexts", []), np.uint64, np.uint32))
            keys = np.union1d(word, np.union1d(context, after))
            table = np.zeros((5, len(keys)), np.uint64)
            table[0, np.searchsorted(keys, word)] = count
            at = np.searchsorted(keys, context)
            for k in range(3):
                np.add.at(table[1 + k], at, of_kind[k].astype(np.uint64))
            table[4, np.searchsorted(keys, after)] = n
            shared.put(f"{folder}/words-{shard:08d}", _pack(keys, table[0], *(t.astype(np.uint32) for t in table[1:])))
            pairs = sum((_unpack(p, np.int64)[0] for p in kinds.get("pairs of count", [])), np.zeros(4, np.int64))
            row = [(table[0] > 0).sum(), table[0].sum(), table[0][keys == B.END].sum(), table[4].sum(), *((table[4] == k).sum() for k in range(1, 5)), *pairs, *((table[0] == k).sum() for k in range(1, 5))]
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in row], names=_STATS)

    return run


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's discounts of counts 1, 2 and 3 or more, from the numbers of n-grams with count 1 to 4.

    Where a number is 0 (small or odd data) the formula has no value; 0.5, 1 and 1.5 stand in.
    """
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) if n[k - 1] and n[k] else 0.5 * k for k in (1, 2, 3))


_maps: OrderedDict[str, list[np.ndarray]] = OrderedDict()
_MAPS = 4096


def _mapped(path: str, kinds: tuple[type, ...]) -> list[np.ndarray]:
    """Arrays of a model file, mapped once in a worker."""
    if path not in _maps:
        _maps[path] = _unpack(shared.mapped(path), *kinds)  # every hash range has a file, so a missing one is a fault
        if len(_maps) > _MAPS:
            _maps.popitem(last=False)
    _maps.move_to_end(path)
    return _maps[path]


@dataclass
class KneserNey:
    """Where the arrays lie, and the totals of the model. Small: it travels with the scoring tasks."""

    folder: str
    shards: int
    stats: dict[str, int]
    spans: Spans = field(default=B.words)

    def __post_init__(self) -> None:
        self.pair_discounts = discounts([self.stats[f"b{k}"] for k in range(1, 5)])
        self.word_discounts = discounts([self.stats[f"u{k}"] for k in range(1, 5)])

    def _cut(self, keys: np.ndarray) -> Iterator[tuple[int, slice]]:
        shard = shard_of(keys, self.shards)
        first = _runs(shard)
        for a, b in zip(first, np.append(first[1:], len(keys)), strict=True):
            yield int(shard[a]), slice(int(a), int(b))

    @staticmethod
    def _found(keys: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the sorted queries are keys, and at which place."""
        at = np.searchsorted(keys, queries)
        at[at == len(keys)] = 0
        hit = keys[at] == queries if len(keys) else np.zeros(len(queries), bool)
        return hit, at[hit]

    def pair_counts(self, h: np.ndarray) -> np.ndarray:
        """Counts of the bigrams with these sorted hashes."""
        out = np.zeros(len(h), np.uint64)
        for shard, part in self._cut(h):
            keys, codes, high, counts = _mapped(f"{self.folder}/pairs-{shard:08d}", (np.uint64, np.uint8, np.uint64, np.uint64))
            hit, at = self._found(keys, h[part])
            out[part][hit] = codes[at]
            if len(high):
                hit, at = self._found(high, h[part])
                out[part][hit] = counts[at]
        return out

    def word_table(self, h: np.ndarray) -> np.ndarray:
        """Count, followers seen once, twice and oftener, and number of contexts of the words with these sorted hashes."""
        out = np.zeros((5, len(h)), np.uint64)
        for shard, part in self._cut(h):
            keys, *columns = _mapped(f"{self.folder}/words-{shard:08d}", (np.uint64, np.uint64, *[np.uint32] * 4))
            hit, at = self._found(keys, h[part])
            for k, column in enumerate(columns):
                out[k, part][hit] = column[at]
        return out

    def lower(self, contexts: np.ndarray) -> tuple[np.ndarray, float]:
        """What the unigram level gives words with that many contexts, and the mass that it leaves to what lies below."""
        s, d = self.stats, np.array([0.0, *self.word_discounts])
        if not s["contexts"]:
            return np.zeros(len(contexts)), 1.0
        n3 = s["seen"] - s["u1"] - s["u2"]
        left = (d[1] * s["u1"] + d[2] * s["u2"] + d[3] * n3) / s["contexts"]
        return (contexts - d[np.minimum(contexts, 3).astype(np.int64)]) / s["contexts"], left

    def higher(self, tokens: np.ndarray, before: np.ndarray, table: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for the bigram level, token by token. table, context: word_table's columns of each token's context."""
        h, of = np.unique(B.pair_hash(before, tokens), return_inverse=True)
        count = self.pair_counts(h)[of].astype(np.float64)
        d = np.array([0.0, *self.pair_discounts])
        total = table[0, context].astype(np.float64)
        total[before == B.BEGIN] = self.stats["n_ends"]
        followers = table[1:4, context].astype(np.float64)
        seen = np.maximum(total, 1.0)
        return (count - d[np.minimum(count, 3).astype(np.int64)]) / seen, np.where(total > 0, d[1:] @ followers / seen, 1.0)

    def parts(self, tokens: np.ndarray, before: np.ndarray):
        """(count of each token, its contexts, bigram level, mass it leaves)."""
        keys, of = np.unique(np.concatenate([tokens, before]), return_inverse=True)
        table, own = self.word_table(keys), of[: len(tokens)]
        seen, left = self.higher(tokens, before, table, of[len(tokens) :])
        return table[0, own], table[4, own].astype(np.float64), seen, left

    def log10_probabilities(self, tokens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token after the one before it; and the tokens' counts."""
        count, contexts, seen, left = self.parts(tokens, before)
        own, rest = self.lower(contexts)
        return np.log10(seen + left * (own + rest / (self.stats["n_words"] + 1))), count


def fit(texts: DataFrame, spans: Spans = B.words, text: str = "text", shard_bytes: int = SHARD_BYTES, fold_tokens: int = FOLD_TOKENS) -> KneserNey:
    """Counts the model over all rows of ``texts`` (null text: empty). Runs Spark jobs; the arrays stay until the driver ends.

    Memory: a task holds fold_tokens tokens, or the packed arrays of one shard (about 3 tokens per 16 bytes of
    text). No row, table or statistic of the corpus goes to the driver but sixteen sums.
    """
    spark = texts.sparkSession
    texts = texts.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    shards = max(1, -(-size // shard_bytes))
    folder = shared.new_folder(spark, "kneser-ney")
    each = spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit("none").alias("kind"), F.lit(b"").alias("payload"))  # so that every shard is written
    sent = shared.map_texts(texts, _count(spans, shards, fold_tokens), _SENT_SQL).union(each).repartitionById(shards, F.col("shard"))
    sent = sent.mapInArrow(_merge_pairs(folder, shards), _SENT_SQL).repartitionById(shards, F.col("shard"))
    rows = sent.mapInArrow(_merge_words(folder, shards), ", ".join(f"{c} long" for c in _STATS))
    found = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _STATS)).first().asDict()
    found["seen"] = found["n_words"]  # every token stands in a bigram, so each word has a context
    return KneserNey(folder, shards, found, spans)


def score(docs: DataFrame, model: KneserNey, text: str = "text") -> DataFrame:
    """Adds to the rows of ``docs`` (columns other than the text and of other names pass through) what the model and the add-one unigram base say.

    n_tokens (with the end), n_known (tokens that training has), train_tokens, base_score and score, both log10
    probabilities of the whole text. An empty or null text has one token, its end. Repeated rows score as their texts do.
    """
    added = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    keep = [c for c in docs.columns if c != text and c not in dict(added)]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, t) for n, t in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_words, n_all = model.stats["n_words"], model.stats["n_tokens"]
        for batch in batches:
            for block in B.blocks(batch.column(text), SCORE_BYTES):
                tokens, before, doc = sequence(block, model.spans)
                logs, count = model.log10_probabilities(tokens, before)
                base = np.log10((count.astype(np.float64) + 1) / (n_all + n_words + 1))
                size = block.n_docs
                columns = [np.bincount(doc, minlength=size), np.bincount(doc[count > 0], minlength=size), np.full(size, n_all), np.bincount(doc, base, size), np.bincount(doc, logs, size)]
                own = batch.slice(block.first, size)
                yield pa.RecordBatch.from_arrays([own.column(c) for c in keep] + [pa.array(x) for x in columns], names=schema.names)

    return shared.map_texts(docs, run, schema)
