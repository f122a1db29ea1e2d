"""Arrow text columns as flat byte buffers: word boundaries and word hashes without Python strings.

A *block* is a run of whole documents (``offsets`` into one UTF-8 ``data`` buffer) small enough that
the per-byte NumPy temporaries stay near a hundred megabytes. A single document longer than the block
size forms a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 1 << 20
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_STRIPE = 32  # from this length on XXH64 works in stripes
_WORD_SEED = 42

#: Token hashes that no word takes part in: the end of a text and the context before its first word.
END = np.uint64(0xD1B54A32D192ED03)
BEGIN = np.uint64(0xABC98388FB8FAC03)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a + _GOLDEN) ^ (b * _MIX2 + _GOLDEN))


def _lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] = table[97:123]
    return table


LOWER = _lowered()
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Block:
    first: int  # row of the batch at which the block starts
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than there are documents

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string array; null counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    data, offsets = flat(column)
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield Block(start, data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start])
        start = stop


def words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document index of the runs of bytes that are not white space (0x20, 0x09-0x0D)."""
    data, offsets = block.data, block.offsets
    if not len(data):
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)  # a document begins here
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def without_space(data: np.ndarray) -> np.ndarray:
    return data[~_SPACE[data]]


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """(number of each span's bytes among the distinct ones, the distinct ones) of spans that cover ``data``."""
    offsets = np.append(starts, ends[-1:]) if len(starts) else np.zeros(1, np.int64)
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = array.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def taken(values: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Of consecutive runs of ``values`` with these sizes, the runs that ``codes`` names, one after the other."""
    width = values.dtype.itemsize
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64) * width
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])
    _, at, data = runs.take(pa.array(codes)).buffers()
    return np.frombuffer(data, values.dtype, int(np.asarray(sizes)[codes].sum())) if data is not None and len(codes) else values[:0]


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 of each byte span, A-Z counted as a-z."""
    lower = np.zeros(len(data) + 8, np.uint8)
    np.take(LOWER, data, out=lower[: len(data)])
    sizes = ends - starts
    h = sizes.astype(np.uint64) + (np.uint64(_WORD_SEED) + _P5)
    at = starts.astype(np.int64)
    eight = np.ndarray(len(data) + 1, "<u8", lower, strides=(1,))  # the eight bytes from each place on
    rest = np.flatnonzero((sizes >= 8) & (sizes < _STRIPE))
    while len(rest):
        h[rest] = _rotated(h[rest] ^ (_rotated(eight[at[rest]] * _P2, 31) * _P1), 27) * _P1 + _P4
        at[rest] += 8
        rest = rest[ends[rest] - at[rest] >= 8]
    rest = np.flatnonzero((ends - at >= 4) & (sizes < _STRIPE))
    if len(rest):
        four = eight[at[rest]] & np.uint64(0xFFFFFFFF)
        h[rest] = _rotated(h[rest] ^ (four * _P1), 23) * _P2 + _P3
        at[rest] += 4
    rest = np.flatnonzero((at < ends) & (sizes < _STRIPE))
    while len(rest):
        h[rest] = _rotated(h[rest] ^ (lower[at[rest]].astype(np.uint64) * _P5), 11) * _P1
        at[rest] += 1
        rest = rest[at[rest] < ends[rest]]
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(sizes >= _STRIPE):
        h[i] = xxhash.xxh64_intdigest(lower[starts[i] : ends[i]], _WORD_SEED)
    return h


def text_hash(text: str) -> int:
    """The hash that span_hashes gives a single word; for tests and lookups by hand."""
    return xxhash.xxh64_intdigest(LOWER[np.frombuffer(text.encode(), np.uint8)], _WORD_SEED)
