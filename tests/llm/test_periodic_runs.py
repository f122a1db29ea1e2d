"""Periodic runs against a search of every period, on random, odd and planted texts."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.llm import periodic_runs, queries


def brute(words):
    """(start, length, period) of all runs, by trying every period everywhere."""
    found = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def collapsed(words, runs):
    drop = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


word = st.integers(0, 2)
piece = st.one_of(st.lists(word, max_size=12), st.tuples(st.lists(word, min_size=1, max_size=5), st.integers(2, 7)).map(lambda x: x[0] * x[1]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(piece, max_size=4).map(lambda x: sum(x, [])), min_size=1, max_size=4))
def test_runs_of_word_ids(texts):
    offsets = np.cumsum([0, *map(len, texts)])
    start, stop, period = periodic_runs.find_runs(np.array(sum(texts, []), np.int32), offsets)
    want = [(int(offsets[i]) + s, int(offsets[i]) + s + n, p) for i, t in enumerate(texts) for s, n, p in brute(t)]
    assert list(zip(start.tolist(), stop.tolist(), period.tolist(), strict=True)) == want


def test_no_run_reaches_over_a_text_border():
    ids = np.zeros(10, np.int32)
    assert [len(x) for x in periodic_runs.find_runs(ids, np.array([0, 5, 10]))] == [0, 0, 0]
    assert [x.tolist() for x in periodic_runs.find_runs(ids, np.array([0, 0, 4, 10, 10]))] == [[4], [10], [1]]


@pytest.mark.parametrize("ids", [np.zeros(300_000, np.int32), np.tile(np.arange(5000, dtype=np.int32), 40), np.random.default_rng(3).integers(0, 2, 200_000).astype(np.int32)])
def test_very_long_texts(ids):
    start, stop, period = periodic_runs.find_runs(ids, np.array([0, len(ids)]))
    assert len(start)
    for s, e, p in zip(start.tolist(), stop.tolist(), period.tolist(), strict=True):
        assert (ids[s + p : e] == ids[s : e - p]).all() and e - s >= max(6, 4 * p)
        assert s == 0 or ids[s - 1] != ids[s - 1 + p]
        assert e == len(ids) or ids[e] != ids[e - p]


def test_odd_tables(spark):
    texts = ["a a a a a a b", None, "", " \t\n", "a\x0bb\x0cc\x1cd", "x y " * 6, "x y " * 6, "é 日 " * 50_000, "one"]
    rows = [(i if i != 8 else None, t, "r", "c", 1) for i, t in enumerate(texts)] + [(0, texts[0], "r", "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed string, start int")
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(docs).collect()), key=str)
    want = [(i, brute(split(t)), collapsed(split(t), brute(split(t)))) for i, t, *_ in rows if i != 7] + [(7, [(0, 100_000, 2)], "é 日")]
    assert got == sorted(want, key=str)
    assert periodic_runs.periodic_runs(docs.limit(0)).collect() == []


def test_query_against_brute_force(spark, sf):
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs) and sum(r.n_runs > 0 for r in got.values()) > 10
    for doc_id, text in docs:
        w, h = split(text), zlib.crc32(str(doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 3000:  # every period of a long text takes too long: its digests are compared with the operator's runs
            ids = np.unique(w, return_inverse=True)[1].astype(np.int32)
            runs = [(s, e - s, q) for s, e, q in zip(*(x.tolist() for x in periodic_runs.find_runs(ids, np.array([0, n]))), strict=True)]
        else:
            runs = brute(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        want = (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest())
        assert tuple(got[doc_id]) == want


def test_highest_is_exact_where_lengths_in_periods_are_close(spark):
    rows = spark.sql("select array(named_struct('start', 0L, 'length', 4000003L, 'period', 1000000L), named_struct('start', 9L, 'length', 4000007L, 'period', 1000001L), named_struct('start', 10L, 'length', 4000007L, 'period', 1000001L)) as runs")
    want = max([(0, 4000003, 1000000), (9, 4000007, 1000001)], key=lambda r: (Fraction(r[1], r[2]), -r[0]))
    assert tuple(rows.select(periodic_runs.highest().alias("x")).select("x.*").first()) == want
    assert rows.select(F.expr("filter(runs, x -> false) as runs")).select(periodic_runs.highest().alias("x")).first().x is None
