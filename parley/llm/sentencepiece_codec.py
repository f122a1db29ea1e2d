"""SentencePiece encoding of merge-type (BPE) vocabularies, with a score-ordered agenda of adjacent symbol pairs.

A text is cut where no merge can reach: no piece of the vocabulary has its space mark behind another character,
so each run of spaces with the characters up to the next space is encoded apart. Each distinct chunk of a block of
an Arrow batch is encoded once by the agenda and compared with what the sentencepiece library gives for it; a
difference stops the job. The library decodes each text's ids as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import blocks as B
from parley.llm.merges import MergeTable
from parley.llm.shared import kept, map_texts

MARK = "▁"  # what stands for a space in pieces
CODE_BYTES = 8 << 20  # of text whose chunks are encoded together
CHUNKS_AT_ONCE = 1 << 16


@dataclass
class Coded:
    """Ids and their decimals (each with a comma behind it) of texts, and where each text's end."""

    ids: np.ndarray
    shown: np.ndarray
    id_cuts: np.ndarray
    shown_cuts: np.ndarray

    def ids_of(self, k: int) -> np.ndarray:
        return self.ids[self.id_cuts[k] : self.id_cuts[k + 1]]

    def shown_of(self, k: int) -> memoryview:
        return self.shown[self.shown_cuts[k] : max(self.shown_cuts[k], self.shown_cuts[k + 1] - 1)].data


class Codec:
    """A vocabulary of merges and its agenda. The model must keep white space as it is and put a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = size = lib.vocab_size()
        special = {i for i in range(size) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)}
        self.piece_id = {lib.id_to_piece(i): i for i in range(size) if i not in special}
        self.score = {p: lib.get_score(i) for p, i in self.piece_id.items()}
        self.byte_id = {lib.id_to_piece(i): i for i in range(size) if lib.is_byte(i)}
        self.unknown = lib.unk_id()
        if any(MARK in p.lstrip(MARK) for p in self.piece_id):
            raise ValueError("a piece of this vocabulary crosses words; texts can't be cut at spaces")
        if lib.normalize("  a \nﬁ") != f"{MARK * 3}a{MARK}\nﬁ":
            raise ValueError("this vocabulary changes texts before it encodes them")
        self.table = self._symbols()
        self.of_point = -1 - np.arange(0x110000)  # symbol of each code point; those without one are negative
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.of_point[ord(c)] = i
        self.of_point[0x20] = self.of_point[ord(MARK)]
        self.name = {i: c for c, i in self.symbol.items() if i >= size}
        decimals = [f"{i},".encode() for i in range(size)]
        self.decimals, self.decimal_sizes = np.frombuffer(b"".join(decimals), np.uint8), np.array([len(d) for d in decimals])

    def _symbols(self) -> MergeTable:
        """Symbols: ids of pieces, behind them the characters that occur within pieces without being one."""
        self.symbol = dict(self.piece_id)
        for p in self.piece_id:
            for c in p:
                self.symbol.setdefault(c, self.size + len(self.symbol))
        rank = {s: r for r, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        pairs = []
        for p, i in self.piece_id.items():
            for k in range(1, len(p)):
                if (a := self.symbol.get(p[:k])) is not None and (b := self.symbol.get(p[k:])) is not None:
                    pairs.append((a, b, rank[self.score[p]], i))
        return MergeTable(pairs)

    def unpieced(self, char: str) -> list[int]:
        """Ids of a character that is no piece: its bytes, or the unknown id."""
        return [self.byte_id[f"<0x{b:02X}>"] for b in char.encode()] if self.byte_id else [self.unknown]

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, one after the other, and how many each has: of all adjacent pairs that form a piece the best score merges first, then the leftmost."""
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        merged, sizes = self.table.merge(self.of_point[points], np.array([len(c) for c in chunks]))
        if len(merged) and not ((merged >= 0) & (merged < self.size)).all():
            kinds, of = np.unique(merged, return_inverse=True)
            spelt = [[i] if 0 <= i < self.size else self.unpieced(self.name[i] if i >= 0 else chr(-1 - i)) for i in kinds.tolist()]
            widths = np.array([len(x) for x in spelt])
            merged, sizes = B.taken(np.array(list(chain.from_iterable(spelt)), np.int64), widths, of), np.add.reduceat(widths[of], np.cumsum(sizes) - sizes)
            if not self.byte_id:  # a run of unknown characters is one unknown id
                owner = np.repeat(np.arange(len(sizes)), sizes)
                again = np.zeros(len(merged), bool)
                again[1:] = (merged[1:] == self.unknown) & (merged[:-1] == self.unknown) & (owner[1:] == owner[:-1])
                merged, sizes = merged[~again], np.bincount(owner[~again], minlength=len(sizes))
        return merged, sizes

    def checked(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """encode_chunks of chunks that begin with a space, held against the library."""
        ids, sizes = self.encode_chunks(chunks)
        theirs = self.library.encode([c[1:] for c in chunks], num_threads=1)
        alone = [k for k, c in enumerate(chunks) if c == " "]  # to the library that is an empty text
        cuts = np.cumsum(sizes)
        for k in alone:
            theirs[k] = ids[cuts[k] - sizes[k] : cuts[k]].tolist()
        flat = np.fromiter(chain.from_iterable(theirs), np.int64)
        if not np.array_equal(sizes, [len(x) for x in theirs]) or not np.array_equal(ids, flat):
            wrong = next(c for c, n, x, end in zip(chunks, sizes, theirs, cuts, strict=True) if ids[end - n : end].tolist() != x)
            raise ValueError(f"the agenda and the sentencepiece library differ on {wrong!r}")
        return ids, sizes

    def decode(self, ids: np.ndarray) -> bytes:
        return self.library.decode(ids, return_type=bytes) if len(ids) else b""

    def encode(self, column: pa.Array) -> Coded:
        """Of one block of texts, without nulls."""
        column = pc.replace_substring(column, MARK, " ")  # the vocabulary has one mark for both
        spaced = pc.if_else(pc.equal(column, ""), column, pc.binary_join_element_wise("", column, " "))
        data, offsets = B.flat(spaced)
        space = data == 0x20
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(first)
        codes, kinds = B.distinct(data, starts, np.append(starts[1:], len(data)) if len(starts) else starts)
        chunks = [c.decode(errors="replace") for c in kinds.to_pylist()]
        parts = [self.checked(chunks[at : at + CHUNKS_AT_ONCE]) for at in range(0, len(chunks), CHUNKS_AT_ONCE)]
        ids, sizes = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in (0, 1))
        doc, n = np.searchsorted(offsets, starts, side="right") - 1, len(column)
        long = self.decimal_sizes[ids]
        shown = B.taken(self.decimals, self.decimal_sizes, ids)
        shown_sizes = np.add.reduceat(long, np.cumsum(sizes) - sizes) if len(sizes) else sizes
        cuts = [np.concatenate([[0], np.cumsum(np.bincount(doc, x[codes], n))]).astype(np.int64) for x in (sizes, shown_sizes)]
        return Coded(B.taken(ids.astype(np.int32), sizes, codes), B.taken(shown, shown_sizes, codes), *cuts)


def codec(path: str) -> Codec:
    own = kept(__name__)
    if path not in own:
        own[path] = Codec(path)
    return own[path]


def encode_documents(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string), one row for each row of ``docs``; null and empty texts have no ids.

    Nothing is shuffled: each row's result depends on its text alone, so repeats and null ids need no rule.
    """
    def columns(own: Codec, coded: Coded, n: int) -> list[pa.Array]:
        ids = pa.ListArray.from_arrays(pa.array(coded.id_cuts, pa.int32()), pa.array(coded.ids))
        return [ids, pa.array([own.decode(coded.ids_of(k)).decode(errors="replace") for k in range(n)], pa.string())]

    return _mapped(docs, doc_id, text, [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())], model_path, columns)


def encoding_digests(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the digests of what encode_documents gives."""
    added = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]

    def columns(own: Codec, coded: Coded, n: int) -> list[pa.Array]:
        sha = hashlib.sha256
        return [pa.array(np.diff(coded.id_cuts)), pa.array([sha(coded.shown_of(k)).hexdigest() for k in range(n)]), pa.array([sha(own.decode(coded.ids_of(k))).hexdigest() for k in range(n)])]

    return _mapped(docs, doc_id, text, added, model_path, columns)


def _mapped(docs: DataFrame, doc_id: str, text: str, added: list, model_path: str, columns) -> DataFrame:
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for block in B.blocks(texts, CODE_BYTES):
                coded = own.encode(texts.slice(block.first, block.n_docs))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.first, block.n_docs), *columns(own, coded, block.n_docs)], names=schema.names)

    return map_texts(docs, run, schema)
