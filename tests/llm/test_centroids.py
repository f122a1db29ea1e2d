"""Delta Lloyd against plain Lloyd rounds over all vectors and centroids."""

import hashlib
import math

import numpy as np
import pytest
from oracle import compare

from parley.llm import centroids, queries


def plain(rows, clusters, rounds, salt, size, scale):
    """(id, cluster, distance) and [(centroid, members, inertia)] by full comparisons, in Python integers."""
    fit = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(scale * x) for x in v]
            if max(map(abs, q)) <= centroids.largest(size):
                fit.append((i, q))
    order = sorted(fit, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest(), r[1]))
    c = [q for _, q in order[:clusters]]
    for k in range(rounds + 1):
        owners = [min((sum((a - b) ** 2 for a, b in zip(q, m, strict=True)), j) for j, m in enumerate(c)) for _, q in fit]
        if k < rounds:
            for j in range(len(c)):
                own = [q for (_, q), (_, o) in zip(fit, owners, strict=True) if o == j]
                if own:
                    c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    table = [(j, m, sum(o == j for _, o in owners), sum(d for d, o in owners if o == j)) for j, m in enumerate(c)]
    return sorted((i if i is not None else -1, o, d) for (i, _), (d, o) in zip(fit, owners, strict=True)), table


def got(spark, rows, clusters, rounds, salt, size, scale):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as owner", "'x' as vector", "0L as distance", "2 as cluster", "'y' as first")
    a, c = centroids.delta_lloyd(df.repartition(3), clusters, rounds, salt, size, scale)
    return sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance) for r in a.collect()), sorted(tuple(r) for r in c.collect())


@pytest.mark.parametrize("seed, n, clusters, rounds, size, scale", [(1, 300, 12, 5, 3, 4), (2, 200, 7, 30, 2, 2), (3, 60, 40, 4, 5, 256), (4, 5, 9, 3, 2, 1)])
def test_rounds_against_plain_ones(spark, seed, n, clusters, rounds, size, scale):
    """Few small integers make many ties, repeated vectors and empty centroids."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, size) / 2]) for i in rng.integers(0, n, n)]
    assert got(spark, rows, clusters, rounds, "s:", size, scale) == plain(rows, clusters, rounds, "s:", size, scale)


def test_odd_vectors(spark):
    nan, inf, big = float("nan"), float("inf"), 1e300
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (1, [0.0, -1.0]), (None, [3.0, 4.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [1.0, inf]), (8, [big, 1.0]), (9, [-0.0, 0.0]), (10, [1.0, 2.0, 3.0])]
    assert got(spark, rows, 3, 2, "", 2, 10) == plain(rows, 3, 2, "", 2, 10)
    assert got(spark, rows[4:8], 3, 2, "", 2, 10) == ([], [])
    assert got(spark, [(None, None)][:0], 3, 2, "", 2, 10) == ([], [])


def test_large_components_are_exact(spark):
    most = centroids.largest(2)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-most, most, 2)]) for i in range(40)] + [(99, [float(most), float(-most)]), (100, [float(most) + 1, 0.0])]
    assert got(spark, rows, 5, 3, "z", 2, 1) == plain(rows, 5, 3, "z", 2, 1)


def test_only_changed_centroids_and_vectors_they_left_are_compared(monkeypatch):
    """The result of a full comparison, from far fewer distances."""
    rng = np.random.default_rng(5)
    x, c = rng.integers(-9, 10, (500, 4)), rng.integers(-9, 10, (20, 4))
    counted = [0]
    plain_distances = centroids._distances

    def distances(a, b):
        counted[0] += len(a) * len(b)
        return plain_distances(a, b)

    monkeypatch.setattr(centroids, "_distances", distances)
    owner, d = centroids.reassigned(x, np.full(500, -1), np.zeros(500, np.int64), c, np.arange(20))
    assert counted[0] == 10_000
    for _ in range(40):
        counted[0], moved = 0, rng.choice(20, 2, replace=False)
        c[moved] += rng.integers(-2, 3, (2, 4))
        owner, d = centroids.reassigned(x, owner, d, c, np.sort(moved))
        full = plain_distances(x, c)
        assert (owner == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()
        assert counted[0] < 4000


def test_query_equals_sql(spark, sf):
    compare(spark, sf, queries.QUERIES["op13_centroids"], queries.ORACLE_SQL["op13_centroids"])
