"""SimHash near-copies of texts, verified by the Jaccard similarity of their 5-word shingles.

Candidates come from the operator of simhash (64-bit fingerprints of the shingle sets, Golay-code keys, 2 bits). Those
alone would find few of the wanted pairs: at a similarity of 0.8 two fingerprints differ in 10 bits on average, and a
segment key that stands so many errors no longer tells texts apart. So MinHash bands are added: 288 minima in 48
bands of 6 give a text 48 more keys, whatever its length, and two texts of similarity s share none with probability
(1 - s**6)**48, below 1e-6 at 0.8.

Candidates are tied within their keys only, by sketches: two bits of each of 256 minima, 64 bytes a text. At a similarity
of 0.8 two sketches agree in 218 places on average, with a deviation of 5.7; of 0.3, in 122. Texts of a key are tied
where they agree in 180 or more, so that pages of one template, which share a key here and there, stay apart, and a
wanted pair is lost with a probability far below that of the bands. A text whose sketch is nearly that of an earlier one
in its block (236 places) is tied to it and leaves it their common keys; the earlier one remembers how far off it was,
and others are tied to it at so many places less. So a large group of copies costs an exchange a row for each block.
Sketches go only to keys that several rows have; a crowded key is cut into chunks that meet in blocks of their own.

The components of these ties hold every wanted pair. A component is dealt out in chunks: the first chunk meets every
other one, and each meets itself. What then is still apart in a component of several chunks, is chunked anew by what
it is linked to: only texts outside its largest group meet all the others. Chunks that meet count all their common
shingles at once, as a product of matrices; so all links are decided on whole texts, none is estimated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm import blocks as B
from parley.llm import shared, simhash
from parley.llm.graph import components, forest
from parley.llm.shared import checkpointed, map_texts

SHINGLE = 5
LEAST = (4, 5)  # a Jaccard similarity of 4/5 and more
BANDS, ROWS = 48, 6
CHUNK_ROWS = 256
SALTS = 64  # tasks that the members of a large component go to where they are told what it is like
CHUNK_BYTES = 8 << 20
MARKS = "row long, fp long, sketch binary, slack long, keys array<long>, ties array<long>"
PLACES = 256  # of a sketch, two bits each
NEAR = 180  # places in which the sketches of a tie agree, less what either row stands for
SAME = 236  # in which a row agrees that leaves its key to an earlier one
CROWD = 4096  # rows of a key that are compared in one block with as many others
PAIRS = 1 << 17  # of sketches that a task compares at a time
DIRECT = 32  # rows of a key that are compared with each other side by side
COLUMNS = 4096  # shingles that a product of matrices takes at a time
_SEEDS = B.mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, -1)
_PLACES = B.mix(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def shingles(block: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each shingle of words, A-Z as a-z, by document; of fewer words, the whole sequence."""
    starts, ends, doc = B.words(block)
    words = B.span_hashes(block.data, starts, ends)
    n = np.bincount(doc, minlength=block.n_docs)
    place = np.arange(len(words)) - (np.cumsum(n) - n)[doc]
    first = np.flatnonzero((place + SHINGLE <= n[doc]) | ((place == 0) & (n[doc] < SHINGLE)))
    sums = np.zeros(len(first), np.uint64)
    for k in range(SHINGLE):
        inside = np.flatnonzero(place[first] + k < n[doc[first]])
        sums[inside] += words[first[inside] + k] * _PLACES[k]
    return B.mix(sums), doc[first]


def band_keys(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of BANDS keys and a sketch (eight words) for each group of shingle hashes; a group begins at each of ``starts`` and has a member."""
    keys, sketch = np.empty((len(starts), BANDS), np.uint64), np.zeros((len(starts), PLACES // 32), np.uint64)
    for band in range(BANDS):
        key = np.full(len(starts), band, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            least = np.minimum.reduceat((hashes ^ _SEEDS[0, k]) * (_SEEDS[1, k] | np.uint64(1)), starts)
            key = B.pair_hash(key, least)
            if k < PLACES:
                sketch[:, k // 32] |= (B.mix(least) & np.uint64(3)) << np.uint64(2 * (k % 32))
        keys[:, band] = key
    return keys, sketch


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many places two sketches (the last axis) agree."""
    x = a ^ b
    return PLACES - np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=-1, dtype=np.int64)


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, fp, sketch, slack, keys, ties): a row whose sketch is nearly that of the first row in its block with the key is tied to it and does not have the key.

    slack: in how many places the rows that left a key to this one differ from it at most.
    """
    for batch in batches:
        for block in B.blocks(batch.column(1)):
            hashes, doc = shingles(block)
            if not len(doc):
                continue
            starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            row = batch.column(0).slice(block.first, block.n_docs).to_numpy()[doc[starts]]
            sizes = np.diff(np.append(starts, len(doc)))
            keys, sketch = band_keys(hashes, starts)
            keys = keys.ravel()
            _, first, of = np.unique(keys, return_index=True, return_inverse=True)
            owner = np.repeat(np.arange(len(row)), BANDS)
            hub = owner[first[of]]
            own = np.ones(len(keys), bool)
            later = np.flatnonzero(hub != owner)
            agree = agreement(sketch[owner[later]], sketch[hub[later]])
            own[later[agree >= SAME]] = False
            slack = np.zeros(len(row), np.int64)
            np.maximum.at(slack, hub[later[agree >= SAME]], PLACES - agree[agree >= SAME])
            tie = np.unique(np.stack([owner[~own], hub[~own]], 1), axis=0)

            def lists(of_row: np.ndarray, values: np.ndarray) -> pa.Array:
                cuts = np.concatenate([[0], np.cumsum(np.bincount(of_row, minlength=len(row)))])
                return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.int64()))

            columns = [pa.array(row), pa.array(simhash.majority(hashes, sizes).view(np.int64)), pa.array([x.tobytes() for x in sketch], pa.binary()), pa.array(slack), lists(owner[own], keys[own].view(np.int64)), lists(tie[:, 0], row[tie[:, 1]])]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "fp", "sketch", "slack", "keys", "ties"])


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key: those of keys with several rows."""
    last, given = None, False  # the row before, which waits if it was not given
    for batch in batches:
        if batch.num_rows:
            keys, rows = (c.to_numpy() for c in batch.columns)
            if last is not None:
                keys, rows = np.concatenate([[last[0]], keys]), np.concatenate([[last[1]], rows])
            same, some = keys[1:] == keys[:-1], np.zeros(len(keys), bool)
            some[1:] |= same
            some[:-1] |= same
            last, before = (keys[-1], rows[-1]), given
            given = bool(some[-1])
            some[0] &= not before
            yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(rows[some])], names=["key", "row"])


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, block, side, row, slack, sketch) come sorted by key and block: a forest of the ties of each block; where it has two sides, of those between them."""
    held: list[list] = []

    def out() -> Iterator[pa.RecordBatch]:
        key, block, side, row, slack, sketch = (np.concatenate(x) for x in zip(*held, strict=True))
        cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])]))
        sizes = np.diff(np.append(cuts, len(key)))
        group = np.repeat(np.arange(len(cuts)), sizes)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        few = np.flatnonzero(np.repeat(sizes <= DIRECT, sizes))
        for d in range(1, DIRECT):
            at = few[: len(few) - d]
            at = at[group[at] == group[few[d:]]]
            if not len(at):
                break
            near = at[agreement(sketch[at], sketch[at + d]) >= NEAR - slack[at] - slack[at + d]]
            a.append(row[near])
            b.append(row[near + d])
        for g in np.flatnonzero(sizes > DIRECT).tolist():
            first, last = cuts[g], cuts[g] + sizes[g]
            mixed, step = bool(side[first:last].any()), max(1, PAIRS // int(sizes[g]))
            for at in range(first, last, step):
                stop = min(at + step, last)
                near = agreement(sketch[at:stop, None], sketch[None, at:last]) >= NEAR - slack[at:stop, None] - slack[at:last]
                if mixed:
                    near &= side[at:stop, None] != side[None, at:last]
                i, j = np.nonzero(np.triu(near, 1))
                if len(i):
                    u, v = forest(row[at + i], row[at + j])
                    a.append(u)
                    b.append(v)
        u, v = forest(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["a", "b"])

    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [*(batch.column(c).to_numpy() for c in ("key", "block", "side", "row", "slack")), _sketches(batch.column("sketch"))]
        key, block = columns[:2]
        done = n > 1 << 16 and np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1]))
        if done is not False and len(done):
            cut = int(done[-1]) + 1
            held.append([c[:cut] for c in columns])
            yield from out()
            held, n = [], 0
            columns = [c[cut:] for c in columns]
        held.append(columns)
        n += len(columns[0])
    if held:
        yield from out()


def _ties(marks: DataFrame) -> DataFrame:
    """(a, b): ties of rows with a common key whose sketches agree."""
    keyed = marks.select(F.explode("keys").alias("key"), "row").repartition("key").sortWithinPartitions("key")
    common = checkpointed(keyed.mapInArrow(_common, "key long, row long"))
    crowds = common.groupBy("key").agg(F.ceil(F.count("*") / CROWD).cast("long").alias("chunks")).where("chunks > 1")
    rows = common.join(crowds, "key", "left").join(marks.select("row", "slack", "sketch"), "row")
    chunks = F.coalesce("chunks", F.lit(1).cast("long"))
    chunk = F.pmod(F.xxhash64("row"), chunks)
    # Chunk i meets chunk j in block (i, j); i is side 0 there and j is side 1. Block (j, j) is chunk j alone.
    as_first = F.transform(_sequence(chunk + 1, chunks - 1), lambda j: _place(chunk * chunks + j, 0))
    as_second = F.transform(_sequence(F.lit(0), chunk - 1), lambda i: _place(i * chunks + chunk, 1))
    blocks = F.concat(as_first, as_second, F.array(_place(chunk * chunks + chunk, 0)))
    dealt = rows.select("key", "row", "slack", "sketch", F.explode(blocks).alias("x")).select("key", F.col("x.block").alias("block"), F.col("x.side").alias("side"), "row", "slack", "sketch")
    dealt = dealt.repartition("key", "block").sortWithinPartitions("key", "block")
    return marks.select("row", F.explode("ties").alias("b")).toDF("a", "b").union(checkpointed(dealt.mapInArrow(_tied, "a long, b long")))


def _linked(sets: list[np.ndarray], rows: np.ndarray, side: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links among the texts of a block whose sides (0 or 1) meet: all pairs but those within side 0, unless there is no other."""
    size = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = n[column] > 1
    owner, column = owner[common], np.unique(column[common], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[a:b], column[a:b] - at] = 1
        both += has @ has.T
    near = (both > 0) & (both * (LEAST[0] + LEAST[1]) >= LEAST[0] * (size[:, None] + size))
    if side.any():
        near &= (side[:, None] == 1) | (side == 1)
    near &= (label[:, None] != label) | (label[:, None] < 0)
    i, j = np.nonzero(np.triu(near, 1))
    return forest(rows[i], rows[j])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block (root, block): the links of each. A block's shingles are held, one block at a time."""
    key, sets, rows, side, label = None, [], [], [], []

    def out() -> Iterator[pa.RecordBatch]:
        if len(sets) > 1:
            a, b = _linked(sets, np.array(rows), np.array(side), np.array(label))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        keys = list(zip(batch.column("root").to_pylist(), batch.column("block").to_pylist(), strict=True))
        columns = [batch.column(c).to_pylist() for c in ("row", "side", "label")]
        for block in B.blocks(batch.column("text")):
            hashes, doc = shingles(block)
            parts = np.split(hashes, np.searchsorted(doc, np.arange(1, block.n_docs)))
            for k, part in enumerate(parts, block.first):
                if keys[k] != key:
                    yield from out()
                    key, sets, rows, side, label = keys[k], [], [], [], []
                sets.append(np.unique(part))
                for held, column in zip((rows, side, label), columns, strict=True):
                    held.append(column[k])
    yield from out()


def _links(dealt: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) found where chunks meet. dealt: row, label, root and the blocks (array of block and side) that a row goes to."""
    some = shared.rows_in(texts, shared.stored_rows(dealt.select("row"), texts))
    blocks = dealt.join(some, "row").select("row", "label", "root", "text", F.explode("blocks").alias("x"))
    blocks = blocks.select("root", F.col("x.block").alias("block"), F.col("x.side").alias("side"), "row", "label", "text")
    blocks = blocks.repartition("root", "block").sortWithinPartitions("root", "block", "side", "row")
    return checkpointed(map_texts(blocks, _met, "a long, b long"))


def _place(block, side) -> Column:
    return F.struct(block.cast("long").alias("block"), F.lit(side).cast("long").alias("side"))


def _sequence(first, last) -> Column:
    """The numbers from ``first`` to ``last``, none where that is less."""
    return F.when(last >= first, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<long>"))


def _told(members: DataFrame, each: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """members.join(each, by) for ``each`` with one row a key: a key's members go to SALTS tasks, as one may have most of them."""
    each = each.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return members.withColumn("salt", F.pmod(F.xxhash64("row", F.lit("salt")), F.lit(SALTS)).cast("int")).join(each, [*by, "salt"], how).drop("salt")


def _chunked(members: DataFrame, by: list[str]) -> DataFrame:
    """Adds the row's chunk among those with the same ``by``, and how many chunks these have."""
    n = members.groupBy(*by).agg(F.greatest(F.ceil(F.count("*") / CHUNK_ROWS), F.ceil(F.sum("bytes") / CHUNK_BYTES)).alias("chunks"))
    rows = _told(members, n.where("chunks > 1"), by, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long")))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")))


def near_copies(texts: DataFrame) -> DataFrame:
    """(node, root) of all rows of ``texts`` (row long, unique, as numbered() gives them; text) that have a near copy; root is one of their component."""
    marks = shared.written(map_texts(texts.select("row", "text"), _marked, MARKS), "marks")
    ties = _ties(marks)
    named = marks.groupBy("fp").agg(F.min("row").alias("hub"))
    of_fp = simhash.links(named.select("fp"))
    first, second = (named.toDF(n, h) for n, h in (("a", "x"), ("b", "y")))
    ties = ties.union(marks.select("fp", "row").join(named, "fp").select("row", "hub")).union(of_fp.join(first, "a").join(second, "b").select("x", "y"))
    tied = components(ties)
    tied = tied.select(F.col("node").alias("row"), "root").union(tied.select("root", "root").distinct())

    sizes = shared.rows_in(texts.select("row", F.octet_length("text").alias("bytes")), shared.stored_rows(tied.select("row"), texts))
    members = checkpointed(_chunked(tied.join(sizes, "row"), ["root"]))
    chunk, others = F.col("chunk"), _sequence(F.lit(1), F.col("chunks") - 1)
    blocks = F.when(F.col("chunks") == 1, F.array(_place(F.lit(0), 0))).when(chunk == 0, F.concat(F.array(_place(F.lit(0), 1)), F.transform(others, lambda c: _place(c, 0)))).otherwise(F.array(_place(chunk, 1)))
    links = _links(members.select("row", F.lit(-1).cast("long").alias("label"), "root", blocks.alias("blocks")), texts)
    label = components(links)

    # Components of several chunks that are not yet one: their largest group, and what is outside it.
    left = members.where("chunks > 1").select("row", "root", "bytes").join(label.select(F.col("node").alias("row"), F.col("root").alias("label")), "row", "left").withColumn("label", F.coalesce("label", "row"))
    groups = left.groupBy("root", "label").agg(F.count("*").alias("n"))
    largest = groups.groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.count("*").alias("groups")).where("groups > 1")
    left = _told(left, largest, ["root"]).select("row", "root", "bytes", "label", (F.col("label") != F.col("largest")).alias("outside"))
    left = checkpointed(_chunked(left, ["root", "outside"]))
    if left.isEmpty():
        return label.union(label.select("root", "root").distinct())
    per = left.groupBy("root").agg(F.max(F.when(F.col("outside"), F.col("chunks"))).alias("o"), F.max(F.when(~F.col("outside"), F.col("chunks"))).alias("m"))
    left = _told(left, per, ["root"])
    o, m = F.col("o"), F.col("m")
    # Block (i, j) of outside chunks i <= j, and (i, o + j) of an outside chunk and one of the largest group.
    wide = o + m
    as_first = F.transform(_sequence(chunk + 1, wide - 1), lambda j: _place(chunk * wide + j, 0))
    as_second = F.transform(_sequence(F.lit(0), chunk - 1), lambda i: _place(i * wide + chunk, 1))
    inner = F.transform(_sequence(F.lit(0), o - 1), lambda i: _place(i * wide + o + chunk, 1))
    blocks = F.when(F.col("outside"), F.concat(as_first, as_second, F.array(_place(chunk * wide + chunk, 1)))).otherwise(inner)
    links = links.union(_links(left.select("row", "label", "root", blocks.alias("blocks")), texts))
    label = components(links)
    return label.union(label.select("root", "root").distinct())


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, without near copies: of each component one row stays, the one with the smallest id.

    Texts link when their sets of 5-word shingles (A-Z as a-z; of fewer words, the whole sequence) have a Jaccard
    similarity of 0.8 or more; so do repeated texts. Null and blank texts have no shingle and link with nothing. A
    null id sorts behind every other; of rows that repeat the smallest id the first one stays. Decided by row: other
    texts under the id of a copy stay. A very long text is read whole, in a block of its own.
    """
    rows = simhash.numbered(docs)
    label = near_copies(rows.select("row", F.col("doc").getField(text).alias("text")))
    return simhash.first_rows(rows, label.select(F.col("node").alias("row"), "root"), doc_id)
