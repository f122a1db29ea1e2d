"""The factorisation machine: its sums against all pairs, its gradient against differences, quality of held-out labels."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.llm import blocks, factorisation, queries
from parley.llm.folds import fold


def auc(y, s):
    a, b = s[y == 1], s[y == 0]
    return float((a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean())


def block_of(texts):
    (block,) = blocks.blocks(pa.array(texts, pa.string()), 1 << 30)
    return block


def drawn(rng, n=5):
    of, feature = np.sort(rng.integers(0, n, 40)), rng.integers(0, 12, 40)
    return of, feature, rng.normal(size=40).astype(np.float32), rng.normal(0, 0.4, (12, 1 + factorisation.FACTORS))


def test_sum_of_squares_is_the_sum_over_pairs():
    of, feature, x, weights = drawn(np.random.default_rng(1))
    got, _ = factorisation._linear(weights, of, feature, x, 5)
    for i in range(5):
        own = np.flatnonzero(of == i)
        want = sum(weights[feature[a], 0] * x[a] for a in own)
        want += sum(weights[feature[a], 1:] @ weights[feature[b], 1:] * x[a] * x[b] for k, a in enumerate(own) for b in own[k + 1 :])
        assert got[i] == pytest.approx(want, abs=1e-6)


def test_gradient_against_differences():
    rng = np.random.default_rng(2)
    of, feature, x, weights = drawn(rng)
    y, weight = rng.integers(0, 2, 5).astype(float), rng.random(5) + 0.5
    head, g = factorisation.gradient(weights, 0.3, y, weight, of, feature, x)
    loss = lambda w, b: factorisation.gradient(w, b, y, weight, of, feature, x)[0][0]
    assert head[1] == pytest.approx((loss(weights, 0.3 + 1e-5) - loss(weights, 0.3 - 1e-5)) / 2e-5, rel=1e-4)
    for i, f in [(0, 0), (3, 1), (7, 4), (11, 8)]:
        step = np.zeros_like(weights)
        step[i, f] = 1e-5
        assert g[i, f] == pytest.approx((loss(weights + step, 0.3) - loss(weights - step, 0.3)) / 2e-5, rel=1e-3, abs=1e-6)


def test_statistics_of_a_text():
    text = "Go GO!! go\n\nab 12 é\nGo GO!! go\n"
    numbers, of, bucket, x = factorisation.features(block_of([text, "", None, " \n", "a"]))
    got = dict(zip(factorisation.STATISTICS, numbers[0].tolist(), strict=True))
    raw, words = text.encode(), text.encode().split()
    visible = len(raw) - 4 - 6  # without line ends and spaces
    want = {"bytes": len(raw), "words": 9, "word_bytes": sum(map(len, words)) / 9, "upper": 6 / visible, "digits": 2 / visible, "marks": 4 / visible, "wide": 2 / visible, "capitals": 2 / 9, "marked": 2 / 9, "single": 0}
    want |= {"distinct": 5 / 9, "commonest": 4 / 9, "stutter": 0, "lines": 3, "line_bytes": len(raw) / 3, "repeated_lines": 1 / 3}
    assert got == pytest.approx(want)
    assert not numbers[1].any() and not numbers[2].any() and numbers[3][0] == 2 and numbers[4][1] == 1
    assert set(of.tolist()) == {0, 4}
    assert np.bincount(of, x.astype(float) ** 2, 5) == pytest.approx([1, 0, 0, 0, 1])


def test_odd_rows_and_clashing_columns(spark):
    long = "plain words of a text " * 50_000
    rows = [(i, t, 1, 0.5, 7, None if i % 2 else 3.0, 1.0, "x") for i, t in enumerate(["GOOD words here", "junk junk junk", None, "", " \t", long, "GOOD words here"])] + [(None, "junk junk", 1, 0.5, 7, 1.0, 1.0, "x"), (0, "GOOD words here", 1, 0.5, 7, 3.0, 1.0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int, weight double, more int, size double, score double, id string")
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (2, 0), (5, 1), (6, 1), (None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    everything = lambda c: F.lit(True)
    sampled = sorted((r.y, r.weight, r.text) for r in factorisation.sample(docs, labels, everything, "quality", 100, metadata=("size",)).collect())
    assert sampled == [(0, 1.0, ""), (0, 1.0, "junk junk junk"), (1, 1.0, "GOOD words here"), (1, 1.0, long), (1, 2.0, "GOOD words here")] or sampled == [(0, 1.0, ""), (0, 1.0, "junk junk junk"), (1, 1.0, "GOOD words here"), (1, 2.0, "GOOD words here"), (1, 1.0, long)]
    model = factorisation.fit(docs, labels, everything, metadata=("size",), rounds=5)
    out = factorisation.score(docs, model)
    assert out.columns == ["doc_id", "y", "weight", "more", "size", "id", "score", "predicted"]
    got = out.collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id in (0, 6)}) == 1
    assert factorisation.score(docs.limit(0), model).collect() == []
    unlearned = factorisation.fit(docs, labels.limit(0), everything)
    assert {r.score for r in factorisation.score(docs, unlearned).collect()} == {0.5}
    one = factorisation.fit(docs, labels.where("quality = 1"), everything, rounds=3)
    assert {r.predicted for r in factorisation.score(docs, one).collect()} == {1}


def test_sample_is_bounded_by_rows_not_ids(spark):
    docs = spark.range(40_000).selectExpr("id % 50 as doc_id", "concat('text ', id div 2) as text")
    labels = spark.range(50).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    n = {r.y: r["count"] for r in factorisation.sample(docs, labels, lambda c: F.lit(True), "quality", 300).groupBy("y").count().collect()}
    assert all(150 < v < 600 for v in n.values()) and len(n) == 2


def test_held_out_quality(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    rows = queries.op12_quality(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = rows.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").withColumn("want", fold("doc_id", 3) == 1).toPandas()
    assert len(got) == docs.count() and (got.held_out == got.want).all() and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    held = got[got.held_out & got.quality.notna()]
    y = held.quality.to_numpy(int)
    assert auc(y, held.score.to_numpy()) > 0.97 and (held.predicted == y).mean() > 0.95


def test_labels_of_held_out_rows_are_not_learned(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(fold("doc_id", 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (factorisation.fit(docs, x, lambda c: fold(c, 3) != 1, rounds=3) for x in (labels, turned))
    assert np.allclose(a.weights, b.weights, atol=1e-4) and a.bias == pytest.approx(b.bias, abs=1e-4)
