"""Near copies against brute force over all pairs."""

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from parley.llm import blocks, near_copies


def plain_shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def edited(rng, words, n):
    words = list(words)
    for at in rng.choice(len(words), n, replace=False):
        words[at] = f"new{rng.integers(1 << 30)}"
    return words


@pytest.mark.parametrize("chunk", [256, 3])
def test_pipeline_stage_drops_near_copies_beyond_two_bits(spark, sf, monkeypatch, chunk):
    monkeypatch.setattr(near_copies, "CHUNK_ROWS", chunk)
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(60, 400))]
        texts += [" ".join(edited(rng, words, k)) for k in (0, max(1, len(words) // 60), len(words) // 20, len(words) // 5)]
    sets = [plain_shingles(t) for t in texts]
    label = list(range(len(texts)))
    for _ in range(4):
        for i in range(len(texts)):
            for j in range(len(texts)):
                if jaccard(sets[i], sets[j]) >= 0.8:
                    label[i] = min(label[i], label[j])
    want = {i for i, x in enumerate(label) if i == x}
    assert 40 <= len(want) <= 140
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], spark.read.parquet(f"{sf}/documents.parquet").schema)
    out = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == want


def test_shingles_like_sets():
    texts = ["", "a", "A b c d", "a b c d e", "a B c d e f  a b c d e", "x", None, " \n", "e d c b a", "a b c d e"]
    block = next(blocks.blocks(pa.array(texts, pa.string())))
    hashes, doc = near_copies.shingles(block)
    got = [np.unique(x) for x in np.split(hashes, np.searchsorted(doc, np.arange(1, block.n_docs)))]
    want = [plain_shingles(t) if (t or "").strip() else set() for t in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    for x, a in zip(got, want, strict=True):
        for y, b in zip(got, want, strict=True):
            assert len(np.intersect1d(x, y)) == len(a & b)


def test_bands_meet_at_the_bound():
    rng = np.random.default_rng(5)
    for _ in range(2000):
        own = rng.integers(0, 1 << 63, 90).astype(np.uint64)
        a, b = blocks.mix(own[:80]), blocks.mix(own[10:])  # 70 of 90 in common, Jaccard 0.78
        keys, sketch = near_copies.band_keys(np.concatenate([a, b]), np.array([0, 80]))
        assert (keys[0] == keys[1]).any() and near_copies.agreement(sketch[0], sketch[1]) >= near_copies.NEAR


def test_agreement_counts_places():
    rng = np.random.default_rng(6)
    a, b = (rng.integers(0, 4, (50, near_copies.PLACES)) for _ in range(2))
    b[:25, ::2] = a[:25, ::2]
    packed = [sum(x[:, k::32].astype(np.uint64) << np.uint64(2 * k) for k in range(32)) for x in (a, b)]
    assert (near_copies.agreement(*packed) == (a == b).sum(axis=1)).all()


def test_keys_that_several_rows_have():
    rng = np.random.default_rng(7)
    for _ in range(200):
        keys = np.sort(rng.integers(0, 15, rng.integers(1, 30)))
        rows = np.arange(len(keys))
        cuts = np.sort(rng.integers(0, len(keys) + 1, 4))
        parts = [(k, r) for k, r in zip(np.split(keys, cuts), np.split(rows, cuts), strict=True)]
        batches = [pa.RecordBatch.from_arrays([pa.array(k), pa.array(r)], names=["key", "row"]) for k, r in parts]
        got = [x for b in near_copies._common(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert sorted(got) == [(k, r) for k, r in zip(keys.tolist(), rows.tolist(), strict=True) if (keys == k).sum() > 1]


@pytest.mark.parametrize("crowd, direct", [(4096, 32), (7, 4)])
def test_ties_within_keys(spark, monkeypatch, crowd, direct):
    """Every pair with a common key and agreeing sketches is connected, and nothing else."""
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, (12, 8)).astype(np.uint64)
    sketch = base[rng.integers(0, 12, 150)]
    for i in range(150):  # some places change
        for k in rng.integers(0, 256, rng.integers(0, 60)):
            sketch[i, k // 32] ^= np.uint64(int(rng.integers(1, 4)) << (2 * (int(k) % 32)))
    keys = [np.unique(rng.integers(0, 9, rng.integers(0, 4))).tolist() for _ in range(150)]
    slack = rng.integers(0, 3, 150) * 5
    rows = [(i, bytearray(sketch[i].tobytes()), int(slack[i]), keys[i], []) for i in range(150)]
    ties = near_copies._ties(spark.createDataFrame(rows, "row long, sketch binary, slack long, keys array<long>, ties array<long>"))
    label = list(range(150))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(150):
        for j in range(i):
            if set(keys[i]) & set(keys[j]) and near_copies.agreement(sketch[i], sketch[j]) >= near_copies.NEAR - slack[i] - slack[j]:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    want = {i: find(i) for i in range(150)}
    got = {r.node: r.root for r in near_copies.components(ties).collect()}
    assert {i: got.get(i, i) for i in range(150)} == want and len(set(want.values())) < 140


def test_pages_of_one_template_do_not_meet(spark):
    """120 words, eight of them changed at random: none a near copy, so hardly a text goes to a block; and work grows with their number."""
    rng = np.random.default_rng(9)
    words = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    dealt = {}
    for n in (500, 1000):
        texts = [(i, " ".join(edited(rng, words, 8))) for i in range(n)]
        df = spark.createDataFrame(texts, "row long, text string")
        marks = near_copies.map_texts(df, near_copies._marked, near_copies.MARKS)
        ties = near_copies._ties(marks)
        dealt[n] = ties.select("a").union(ties.select("b")).distinct().count()
    assert max(dealt.values()) < 20
