"""SimHash near-duplicates: Golay-code fuzzy hashing finds the fingerprints that differ in few bits.

A 64-bit fingerprint has three segments of 22, 21 and 21 bits. Two errors leave one segment A untouched and,
for one such A, at most one error in the next segment B (in cyclic order). B, padded to 23 bits, is keyed by
the perfect binary Golay code: every codeword within distance 4 of it, 1 or 6 of them. Two words at distance
1 have such a codeword in common: the one nearest to either is at most 3 from it and 4 from the other. A key
is then A's bits with B's 12-bit codeword index, 16 keys a fingerprint on average, and candidates that share
one are verified by their differing bits.

Within a key no list of pairs is made. Fingerprints of a key with few are compared directly. Those of crowded keys
are grouped, all of them together, by what at most one flipped bit turns them into: two differ in at most 2 bits
exactly when such groups have them in common. A group has 65 members at most and each is linked to the smallest, so a
crowded key becomes rows that spread over all tasks. Equal fingerprints are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import blocks as B
from parley.llm.graph import components, forest
from parley.llm.shared import checkpointed, map_texts, rows_in, stored_rows, written

SEED = 42
SHINGLE = 3
MAX_BITS = 2  # what the keys are built for
DIRECT = 32  # fingerprints with a key that are compared one with another
_SEGMENTS = ((0, 22), (22, 21), (43, 21))
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], dtype=np.uint64)


def shingle_hashes(raw: bytes) -> list[int]:
    """XXH64 of each 3-word shingle of a UTF-8 text, lower-cased A-Z, repeats included; of fewer words, the whole sequence."""
    text = b" ".join(raw.translate(_LOWER).split())
    if not text:
        return []
    gaps = [i for i in np.flatnonzero(np.frombuffer(text, np.uint8) == 32).tolist()]
    starts, ends = [0, *(g + 1 for g in gaps)], [*gaps, len(text)]
    digest = xxhash.xxh64_intdigest
    return [digest(text[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :], strict=False)] or [digest(text, SEED)]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of consecutive groups of 64-bit hashes, the bits set in over half of each group; 0 for an empty group."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    first = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    cuts = -(-sizes[full] // 255)  # a byte counts to 255
    owner = np.cumsum(cuts) - cuts
    starts = np.repeat(first, cuts) + 255 * (np.arange(cuts.sum()) - np.repeat(owner, cuts))
    by_byte = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)  # little-endian
    for byte in range(8):
        lanes = np.add.reduceat(_LANES[by_byte[:, byte]], starts).view(np.uint8).reshape(-1, 8)
        bits = np.add.reduceat(lanes.astype(np.int64), owner, axis=0) * 2 > sizes[full][:, None]
        for k in range(8):
            out[full] |= bits[:, k].astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in B.blocks(batch.column("text")):
            data, cuts = block.data.tobytes(), block.offsets.tolist()
            each = [shingle_hashes(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            sizes = np.array([len(x) for x in each], np.int64)
            hashes = np.array([h for x in each for h in x], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.first, block.n_docs), pa.array(majority(hashes, sizes).view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long): the SimHash of each whole text; null and blank texts have 0."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_texts(docs, _fingerprints, T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())]))


# --- the Golay code -------------------------------------------------------------------------------------------

_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _remainders(bits: int) -> np.ndarray:
    """Remainder of each word below 2**bits by the generator polynomial."""
    x = np.arange(1 << bits, dtype=np.int64)
    for k in range(bits - 1, 10, -1):
        x = np.where((x >> k) & 1, x ^ (_GENERATOR << (k - 11)), x)
    return x


_SYNDROME_LOW = _remainders(12)
_SYNDROME_HIGH = np.array([_SYNDROME_LOW[0]] * (1 << 11), np.int64)


def _prepare() -> np.ndarray:
    single = []
    for k in range(23):
        x = 1 << k
        for j in range(22, 10, -1):
            if (x >> j) & 1:
                x ^= _GENERATOR << (j - 11)
        single.append(x)
    for h in range(1 << 11):
        s = 0
        for k in range(11):
            if (h >> k) & 1:
                s ^= single[12 + k]
        _SYNDROME_HIGH[h] = s
    error = np.full(1 << 11, -1, np.int64)
    error[0] = 0
    for i in range(23):
        error[single[i]] = 1 << i
        for j in range(i):
            error[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                error[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    return error


_ERROR = _prepare()


def nearest_codeword(words: np.ndarray) -> np.ndarray:
    """The one codeword within distance 3 of each 23-bit word."""
    return words ^ _ERROR[_SYNDROME_LOW[words & 4095] ^ _SYNDROME_HIGH[words >> 12]]


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(12-bit indices of the codewords within distance 4 of each 23-bit word, mask of the distinct ones), 24 columns."""
    flips = np.concatenate([[0], 1 << np.arange(23)])
    index = np.sort(nearest_codeword(words[:, None] ^ flips) >> 11, axis=1)  # the code is systematic: the upper bits tell
    fresh = np.ones(index.shape, bool)
    fresh[:, 1:] = index[:, 1:] != index[:, :-1]
    return index, fresh


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position in fp) of all keys of unsigned fingerprints."""
    keys, rows = [], []
    part = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in _SEGMENTS]
    for a in range(3):
        index, fresh = golay_keys(part[(a + 1) % 3])
        key = (np.int64(a) << 36) | (part[a][:, None] << 12) | index
        row, _ = np.nonzero(fresh)
        keys.append(key[fresh])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy()
        key, row = fuzzy_keys(fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], names=["key", "fp"])


def links_of(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links among unsigned fingerprints with equal keys; key is sorted, each has DIRECT fingerprints at most."""
    a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for d in range(1, DIRECT):
        same = np.flatnonzero(key[d:] == key[:-d])
        if not len(same):
            break
        near = same[np.bitwise_count(fp[same] ^ fp[same + d]) <= MAX_BITS]
        a.append(fp[near])
        b.append(fp[near + d])
    return forest(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; the last key of a batch waits for the next one. (a, b) is a link, (a, null) a fingerprint of a crowded key."""
    key, fp = np.empty(0, np.int64), np.empty(0, np.int64)
    crowded = None  # the waiting key, if it has had more than DIRECT fingerprints

    def out(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(k):
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            sizes = np.diff(np.append(starts, len(k)))
            many = np.repeat(sizes > DIRECT, sizes) | (k == crowded if crowded is not None else False)
            a, b = links_of(k[~many], f[~many].view(np.uint64))
            lone = np.unique(f[many])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, lone])), pa.concat_arrays([pa.array(b), pa.nulls(len(lone), pa.int64())])], names=["a", "b"])

    for batch in batches:
        if batch.num_rows:
            key, fp = np.concatenate([key, batch.column(0).to_numpy()]), np.concatenate([fp, batch.column(1).to_numpy()])
            done = int(np.searchsorted(key, key[-1]))
            if not done and len(key) > DIRECT:
                crowded, done = key[-1], len(key)
            yield from out(key[:done], fp[:done])
            key, fp = key[done:], fp[done:]
    yield from out(key, fp)


def _flipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
    for batch in batches:
        fp = batch.column(0).to_numpy()
        centers = (fp.view(np.uint64)[:, None] ^ flips).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(centers.view(np.int64)), pa.array(np.repeat(fp, 65))], names=["center", "fp"])


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): links of distinct fingerprints (fp long) that connect all those with MAX_BITS or fewer differing bits."""
    keyed = nodes.select("fp").mapInArrow(_keyed, "key long, fp long")
    found = checkpointed(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_linked, "a long, b long"))
    crowd = found.where("b IS NULL").select(F.col("a").alias("fp")).distinct().mapInArrow(_flipped, "center long, fp long")
    lowest = crowd.groupBy("center").agg(F.collect_set("fp").alias("all"))  # 65 at most
    crowd = lowest.where(F.size("all") > 1).select(F.explode("all").alias("a"), F.array_min("all").alias("b")).where("a != b").distinct()
    return found.where("b IS NOT NULL").union(crowd)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``docs``.

    Fingerprints link at MAX_BITS or fewer differing bits; component_id is the smallest id reachable. Null and
    blank texts have fingerprint 0 and link like any other. Rows that repeat an id count each; null ids get a
    component like any row but never name one, unless a component has no other.
    """
    rows = checkpointed(fingerprints(docs, doc_id, text))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("lowest"))
    roots = components(links(nodes))
    nodes = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "lowest", F.coalesce("root", "fp").alias("root"))
    named = nodes.groupBy("root").agg(F.min("lowest").alias("component_id"))
    named = nodes.select("fp", "root").join(named, "root").select("fp", "component_id")
    out = rows.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def numbered(docs: DataFrame) -> DataFrame:
    """(doc struct, row long): the rows of ``docs`` in files of the shared folder, so that their numbers stay."""
    return written(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("row")), "near")


def first_rows(rows: DataFrame, members: DataFrame, doc_id: str) -> DataFrame:
    """The documents of ``rows``; of each root's ``members`` (row, root) only the one with the smallest id, null last, then row."""
    ids = rows.select("row", F.col("doc").getField(doc_id).alias("id"))
    members = members.join(rows_in(ids, stored_rows(members.select("row"), rows)), "row")
    first = members.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row"))["row"].alias("first"))
    gone = members.join(first, "root").where("row != first").select("row")
    return rows_in(rows, stored_rows(gone, rows), inside=False).select("doc.*")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, that stay: of each component the first row with its smallest id, null last."""
    rows = numbered(docs)
    found = near_duplicates(rows.select("row", F.col("doc").getField(text).alias("text")), "row", "text")
    return first_rows(rows, found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("root")), doc_id)
