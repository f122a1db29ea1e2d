"""Bounded-space online packing of tokenised documents into fixed windows.

Each partition keeps a fixed number of open windows. A piece goes where it leaves the least room (best fit);
when it fits nowhere, the fullest window is emitted and a new one opened. What each partition still has open
at its end is merged: the leftover windows are themselves packed, best fit, in rounds over fewer and fewer
tasks, each window moving as a whole. A document over the window is cut: whole windows first, then the rest.

Words between white space are tokenised apart (no token of the vocabulary crosses white space): each distinct word
of a block of texts once, and the texts' ids are then taken from those. Nothing is kept from block to block.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import blocks as B
from parley.llm.merges import MergeTable
from parley.llm.shared import checkpointed, kept, map_texts

WINDOW = 2048
OPEN_WINDOWS = 64
TOKEN_BYTES = 8 << 20  # of text whose words are tokenised together
WORDS_AT_ONCE = 1 << 16
END_ID = 1
LEFTOVERS_PER_TASK = 20_000
_PLAIN = "^[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+$"


_LETTER, _DIGIT, _OTHER = range(3)
_KINDS = np.full(256, _OTHER, np.uint8)  # of the bytes of lower-cased plain words; those past ASCII belong to letters
_KINDS[97:123] = _KINDS[128:] = _LETTER
_KINDS[48:58] = _DIGIT


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class WordTokenizer:
    """Token ids of whole texts by a byte-level BPE tokenizer that works within white-space words.

    Plain words (ASCII and precomposed Latin letters, on which normalising means lower-casing each character) are
    merged here, many at a time; every other word is given to the library as it is.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.split = regex.compile(model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        model, vocab = model["model"], model["model"]["vocab"]
        end = model["end_of_word_suffix"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.table = MergeTable([(vocab[a], vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)])
        chars = _byte_chars()
        self.inner = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[chars[b] + end] for b in range(256)], np.int64)

    def _merged(self, lower: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-cased plain words, and how many each has."""
        raw, offsets = B.flat(lower)
        kind = _KINDS[raw]
        cut = np.ones(len(raw), bool)  # a part of a word begins here
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        cut[offsets[:-1]] = True
        for k in np.flatnonzero(pc.match_substring(lower, "'").to_numpy(zero_copy_only=False)):  # 's and the like are parts of their own
            at, word = offsets[k], raw[offsets[k] : offsets[k + 1]].tobytes().decode()
            cut[at : offsets[k + 1]] = False
            cut[at + np.cumsum([0, *(len(p.encode()) for p in self.split.findall(word)[:-1])])] = True
        starts = np.flatnonzero(cut)
        symbols = self.inner[raw]
        ends = np.append(starts[1:], len(raw)) - 1
        symbols[ends] = self.last[raw[ends]]
        ids, sizes = self.table.merge(symbols, ends + 1 - starts)
        first = np.searchsorted(starts, offsets[:-1])  # part of each word
        return ids, np.add.reduceat(sizes, first) if len(first) else sizes

    def _some(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = pc.and_(pc.match_substring_regex(words, _PLAIN), pc.invert(pc.match_substring(words, "<|"))).to_numpy(zero_copy_only=False)
        ids, own = self._merged(pc.utf8_lower(words.filter(pa.array(plain))))
        sizes = np.zeros(len(words), np.int64)
        sizes[plain] = own
        if plain.all():
            return ids, sizes
        found = [f.ids for f in self.tokenizer.encode_batch(words.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)]
        sizes[~plain] = [len(f) for f in found]
        out = np.empty(int(sizes.sum()), np.int64)
        ours = np.repeat(plain, sizes)
        out[ours] = ids
        out[~ours] = [i for f in found for i in f]
        return out, sizes

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all these words, one after the other, and how many each word has."""
        try:
            words = words.cast(pa.large_string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            words = pa.array([w.decode(errors="replace") for w in words.to_pylist()], pa.large_string())
        parts = [self._some(words.slice(at, WORDS_AT_ONCE)) for at in range(0, len(words), WORDS_AT_ONCE)]
        ids, sizes = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0), np.empty(0, np.int64))
        return ids.astype("<u4"), sizes

    def encode(self, block: B.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids (little-endian uint32) of the block's documents, one after the other, and how many each document has."""
        starts, ends, doc = B.words(block)
        closed = np.cumsum(ends - starts)  # without white space the words lie end to end
        codes, words = B.distinct(B.without_space(block.data), closed - (ends - starts), closed)
        ids, sizes = self.encode_words(words)
        return B.taken(ids, sizes, codes), np.bincount(doc, sizes[codes], block.n_docs).astype(np.int64)


def tokenizer(path: str) -> WordTokenizer:
    own = kept(__name__)
    if path not in own:
        own[path] = WordTokenizer(path)
    return own[path]


@dataclass(frozen=True)
class Ids:
    """Numbers of windows: the round of merging above the partition above the window within it, in bits of their own."""

    round_bits: int = 7
    partition_bits: int = 24
    window_bits: int = 32

    def first(self, round: int, partition: int) -> int:
        """The number of the first window. A field that is full is an error."""
        if round >> self.round_bits or partition >> self.partition_bits:
            raise OverflowError(f"round {round} or partition {partition} of packing has no number")
        return ((round << self.partition_bits) | partition) << self.window_bits

    def within(self, windows: int) -> None:
        if windows > 1 << self.window_bits:
            raise OverflowError(f"{windows} windows of a partition have no numbers")


class Packer:
    """Best fit over a bounded number of open windows. add() and close() give (window, size) of those that are done."""

    def __init__(self, window: int, open_windows: int):
        self.window, self.most = window, open_windows
        self.open: list[tuple[int, int]] = []  # (room, window id), by room
        self.made = 0

    def add(self, size: int) -> tuple[int, int, list[tuple[int, int]]]:
        """(window, offset within it, windows emitted). 0 < size <= window."""
        done = []
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            room, name = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                left, fullest = self.open.pop(0)
                done.append((fullest, self.window - left))
            room, name = self.window, self.made
            self.made += 1
        if room == size:
            done.append((name, self.window))
        else:
            insort(self.open, (room - size, name))
        return name, self.window - room, done

    def close(self) -> list[tuple[int, int]]:
        left, self.open = [(name, self.window - room) for room, name in self.open], []
        return left


_PIECES = "start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, fill long, open boolean"


def _pack(path: str, window: int, open_windows: int, end_id: int, ids_of: Ids, schema: T.StructType):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, words = ids_of.first(0, TaskContext.get().partitionId()), tokenizer(path)
        packer = Packer(window, open_windows)
        waiting: dict[int, list[list]] = {}  # pieces of the open windows
        ids_type = schema[0].name

        def rows(windows: list[tuple[int, int]], still_open: bool) -> list[list]:
            return [[*piece, fill, still_open] for name, fill in windows for piece in waiting.pop(name)]

        def batch_of(out: list[list]) -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            doc = pa.array(next(columns), id_type)
            return pa.RecordBatch.from_arrays([doc, *(pa.array(c) for c in columns)], names=[ids_type, *schema.names[1:]])

        id_type = None
        for batch in batches:
            id_type, out = batch.schema.field(0).type, []
            for block in B.blocks(batch.column(1), TOKEN_BYTES):
                ids, sizes = words.encode(block)
                ids, at = ids.view(np.uint8).data, 0
                for doc, size in zip(batch.column(0).slice(block.first, block.n_docs).to_pylist(), sizes.tolist(), strict=True):
                    own = bytes(ids[at : at + 4 * size]) + end
                    at, total = at + 4 * size, size + 1
                    for start in range(0, total, window):
                        piece = own[4 * start : 4 * (start + window)]
                        name, offset, done = packer.add(len(piece) // 4)
                        waiting.setdefault(name, []).append([doc, start, len(piece) // 4, zlib.crc32(piece), total, first + name, offset])
                        out += rows(done, False)
            ids_of.within(packer.made)
            if out:
                yield batch_of(out)
        if left := rows(packer.close(), True):
            yield batch_of(left)

    return run


def _merge(window: int, open_windows: int, ids_of: Ids, level: int):
    """Packs leftover windows, each a whole, into new ones; the rows are the moves (window, target, base, fill of target)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = ids_of.first(level, TaskContext.get().partitionId())
        packer = Packer(window, open_windows)
        moves, fills = [], {}
        items = [x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        for name, fill in sorted(items, key=lambda x: (-x[1], x[0])):  # the largest first
            target, base, done = packer.add(fill)
            moves.append((name, first + target, base))
            fills |= {first + w: f for w, f in done}
        fills |= {first + w: f for w, f in packer.close()}
        ids_of.within(packer.made)
        if moves:
            a, b, c = zip(*moves, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c), pa.array([fills[w] for w in b])], names=["window", "target", "base", "target_fill"])

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", ids: Ids = Ids()) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row for each piece of a document.

    Each document's ids and an end id lie in exactly one piece each; a null or empty text is its end id alone.
    Pieces lie in their sequence from offset 0 without a gap, and a sequence holds ``window`` ids at most. Rows
    that repeat an id, and null ids, are documents like any other. Memory: the open windows of a partition and a
    block of TOKEN_BYTES of text; a merging task takes LEFTOVERS_PER_TASK leftover windows of two numbers each.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(_PIECES).fields])
    pieces = checkpointed(map_texts(docs, _pack(tokenizer_path, window, open_windows, end_id, ids, schema), schema))
    done = pieces.where("not open").select("*", F.col("window").alias("sequence_id"))
    # Leftover windows: rounds of merging, each in fewer tasks, until one task takes all that is open or they merge no further.
    where = pieces.where("open").groupBy("window").agg(F.first("fill").alias("fill"))
    where = checkpointed(where.select("window", F.col("window").alias("target"), F.lit(0).cast("long").alias("base"), F.col("fill").alias("target_fill")))
    level, before = 1, None
    while True:
        left = where.where(F.col("target_fill") < window).select("target", "target_fill").distinct()
        n = left.count()
        tasks = -(-n // LEFTOVERS_PER_TASK)
        if not n or (before is not None and (before <= 1 or tasks >= before)):
            break
        moved = left.repartition(tasks, "target").mapInArrow(_merge(window, 1 << 62, ids, level), "window long, target long, base long, target_fill long")
        moved = moved.select(F.col("window").alias("old"), F.col("target").alias("new"), F.col("base").alias("shift"), F.col("target_fill").alias("new_fill"))
        where = where.join(moved, where.target == moved.old, "left").select("window", F.coalesce("new", "target").alias("target"), (F.col("base") + F.coalesce("shift", F.lit(0))).alias("base"), F.coalesce("new_fill", "target_fill").alias("target_fill"))
        where = checkpointed(where)
        level, before = level + 1, tasks
    late = pieces.where("open").join(where.drop("target_fill"), "window").select(*[c for c in pieces.columns if c != "offset"], (F.col("offset") + F.col("base")).alias("offset"), F.col("target").alias("sequence_id"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return done.select(*names).unionByName(late.select(*names))
