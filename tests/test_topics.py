import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parley.operators import departments, ml, topics, trend
from parley.settings import Settings


def angles(*degrees):
    return np.array([[math.cos(math.radians(d)), math.sin(math.radians(d))] for d in degrees])


@pytest.mark.parametrize(("method", "threshold", "groups"), [("single", 0.85, 1), ("average", 0.85, 2), ("average", 0.75, 1), ("complete", 0.75, 2), ("single", 0, 3)])
def test_linkage_of_a_chain(method, threshold, groups):
    assert len(set(topics.linkage_groups(angles(0, 25, 50), threshold, method).tolist())) == groups


def test_zero_centroids_stay_apart():
    assert len(set(topics.linkage_groups(np.zeros((2, 3)), 0.85).tolist())) == 2
    with pytest.raises(ValueError, match="linkage"):
        topics.linkage_groups(np.eye(2), 0.5, "ward")


def test_class_tfidf_by_hand(spark):
    terms = spark.createDataFrame([(0, "贷款", 3), (0, "还款", 1), (1, "理财", 2)], "topic_id int, word string, n long")
    got = {(r.topic_id, r.word): (r["rank"], r.score) for r in topics.class_tfidf(terms).collect()}
    assert got == {(0, "贷款"): (1, round(0.75 * math.log(2), 8)), (0, "还款"): (2, round(0.25 * math.log(4), 8)), (1, "理财"): (1, round(math.log(2.5), 8))}


def test_gates(spark):
    rows = spark.createDataFrame([(1, 0.1, (2 - 0.1) / 2, 0), (2, 4.0, 0.2, 0), (3, 1.0, 0.01 / 1.01, 0)], "n int, distance double, margin double, _topic int")
    gates = Settings(max_distance=3, min_margin=0.1)
    assert [r.topic_id for r in topics.gated(rows, gates).orderBy("n").collect()] == [0, -1, -1]
    assert [r.topic_id for r in topics.gated(rows).collect()] == [0, 0, 0]


def test_merge_and_rollup_keep_distinct_customers(spark):
    rows = [(t, f"{t}{i}", i % 7, 1 + t, v) for t, v in ((0, [1.0, 0.0]), (1, [1.0, 0.05]), (2, [0.0, 1.0])) for i in range(12)]
    s = spark.createDataFrame(rows, "topic_id int, session_id string, customer int, msg_count long, vector array<float>")
    volume = topics.topic_volume(s)
    mapping = topics.merge_map(volume, topics.packed(topics.centroids(s)))
    assert {r.topic_id: r.canonical for r in mapping.collect()} == {0: 1, 1: 1, 2: 2}
    merged = {r.topic_id: r for r in topics.topic_volume(topics.canonical_sessions(s, mapping)).collect()}
    assert (merged[1].heat, merged[1].session_count, merged[1].customer_count) == (36, 24, 7)
    assert sum(r.heat for r in merged.values()) == 72


def test_ranking_breaks_ties_by_topic(spark):
    v = spark.createDataFrame([(3, 10, 1), (1, 10, 1), (2, 5, 1000)], "topic_id int, heat long, customer_count long")
    assert [r.topic_id for r in topics.ranked(v).orderBy("rank").collect()] == [2, 1, 3]


def test_quotas_cover_every_member(spark):
    def places(sizes, cap):
        rows = spark.createDataFrame([(1, m, n) for m, n in sizes.items()], "topic_id int, member int, size long")
        return {r.member: r.places for r in topics.quotas(rows, cap).collect()}

    assert places({0: 8, 1: 8}, 4) == {0: 2, 1: 2} and places({0: 90, 1: 2, 2: 1}, 30) == {0: 28, 1: 1, 2: 1}
    assert sum(places({k: 2 for k in range(7)}, 5).values()) == 5 and places({0: 2, 1: 1}, 9) == {0: 2, 1: 1}


def test_bottom_k_ignores_partitioning(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("topic_id"), "id")
    a = {r.id for r in topics.bottom_k(rows, F.col("id"), 5).collect()}
    assert a == {r.id for r in topics.bottom_k(rows.repartition(7), F.col("id"), 5).collect()} and len(a) == 15


def test_mmr_prefers_unlike():
    x = np.array([[1, 0.01], [1, 0.0], [0.2, 1.0]])
    assert ml.mmr(x, 2) == [0, 2] and ml.mmr(x[:1], 5) == [0]


def test_three_separable_clusters(spark):
    rng = np.random.default_rng(123)
    x = np.concatenate([4 * np.eye(4)[k] + rng.normal(0, 0.04, (25, 4)) for k in range(3)])
    rows = spark.createDataFrame([(i, v.tolist(), i // 25) for i, v in enumerate(x)], "n int, vector array<float>, truth int")
    out = ml.cluster_topics(rows, s=Settings(clusters=3, pca_components=3)).toPandas()
    assert out.groupby("truth").topic_id.nunique().max() == 1 and out.topic_id.nunique() == 3
    assert out.distance.max() < 1


@pytest.mark.parametrize("bad", [[[1.0, 2.0], [3.0]], [[1.0, None], [1.0, 2.0]], [[1.0, math.nan], [1.0, 2.0]]])
def test_bad_vectors_are_refused(spark, bad):
    rows = spark.createDataFrame([(v,) for v in bad], "vector array<float>")
    with pytest.raises(Exception, match="vectors must be"):
        ml.checked_vectors(rows).collect()


def boards(spark, today, before):
    schema = "rank int, topic_id int, heat long, words array<string>"
    return spark.createDataFrame(today, schema), spark.createDataFrame(before, schema)


def test_trend_matches_each_predecessor_once(spark):
    today = [(1, 1, 30, ["a", "b"]), (2, 2, 15, ["a", "b"]), (3, 3, 25, ["z"]), (4, 4, 10, ["y"])]
    rows = {r["rank"]: r for r in trend.with_trend(*boards(spark, today, [(1, 9, 20, ["a", "b"])])).collect()}
    assert (rows[1].prev_heat, rows[1].heat_change_pct, rows[1].is_new, rows[1].is_surge) == (20, 0.5, False, True)
    assert (rows[2].prev_heat, rows[2].heat_change_pct, rows[2].is_new, rows[2].is_surge) == (0, None, True, False)
    assert rows[3].is_surge and not rows[4].is_surge


def test_trend_needs_heat_and_similarity(spark):
    rows = trend.with_trend(*boards(spark, [(1, 1, 5, list("abcd"))], [(1, 8, 0, list("abcd")), (2, 9, 7, list("axyz"))])).collect()
    assert rows[0].is_new  # the best match has no heat, and the next is too unlike


def test_floor_rounds_up(spark):
    v = spark.createDataFrame([("d", 1, 1000), ("d", 2, 5), ("d", 3, 6), ("e", 1, 3), ("e", 2, 2)], "department string, topic_id int, session_count long")
    assert {(r.department, r.topic_id) for r in departments.above_floor(v).collect()} == {("d", 1), ("d", 3), ("e", 1)}


def test_split_of_two_groups(spark):
    x = [[1.0, 0.02 * (i % 3)] for i in range(20)] + [[0.02 * (i % 3), 1.0] for i in range(20)]
    rows = spark.createDataFrame([("d", 7, str(i), 1, i % 5, v) for i, v in enumerate(x)] + [("d", 8, "other", 1, 1, [1.0, 0.0])], "department string, topic_id int, session_id string, msg_count long, customer int, vector array<double>")
    out = departments.split_targets(rows, spark.createDataFrame([("d", 7)], "department string, topic_id int"), 10)
    got = {(r.topic_id, r.parent_topic_id): r.session_count for r in topics.topic_volume(out, ["topic_id", "parent_topic_id"]).collect()}
    assert got == {(10, 7): 20, (11, 7): 20, (8, None): 1}
    alike = rows.withColumn("vector", F.array(F.lit(1.0), F.lit(1.0)))
    out = departments.split_targets(alike, spark.createDataFrame([("d", 7)], "department string, topic_id int"), 10)
    assert {(r.topic_id, r.parent_topic_id) for r in out.collect()} == {(7, None), (8, None)}


def test_roster_fan_out_and_fallback(spark):
    s = spark.createDataFrame([("m1", 1), ("m2", 1), ("m9", 1)], "staff string, topic_id int")
    roster = spark.createDataFrame([("A", "m1"), ("B", "m1"), ("B", "m2"), ("B", "m2")], "department string, manager string")
    assert sorted((r.department, r.staff) for r in departments.sliced(s, roster).collect()) == [("A", "m1"), ("B", "m1"), ("B", "m2")]
    board = spark.createDataFrame([(10, 1, ["a"]), (5, None, ["x", "y", "z", "w"]), (6, None, [])], "topic_id int, parent_topic_id int, words array<string>")
    catalog = spark.createDataFrame([(1, "意图")], "topic_id int, customer_intent string")
    got = {r.topic_id: (r.customer_intent, r.intent_source) for r in departments.with_fallback(board, catalog).collect()}
    assert got == {10: ("意图", "global"), 5: ("客户关注x、y、z", "department"), 6: ("客户关注相关业务", "department")}


def test_readiness(spark):
    def runs(*ids):
        return spark.createDataFrame([(i,) for i in ids], "run_id string")

    assert departments.is_ready(runs("r"), runs("r", "r"))
    assert not departments.is_ready(runs("r"), runs("r", "q")) and not departments.is_ready(runs(), runs("r"))


def test_silhouette_by_hand(spark):
    x = np.array([[1.0, 0.0], [0.8, 0.6], [0.0, 1.0], [0.28, 0.96], [-1.0, 0.0]])
    part = [0, 0, 1, 1, 2]
    rows = spark.createDataFrame([("d", 1, str(i), v.tolist(), 3, p) for i, (v, p) in enumerate(zip(x, part, strict=True))], "department string, topic_id int, session_id string, unit array<double>, k int, part int")
    gaps = ((x[:, None] - x) ** 2).sum(2)
    want = []
    for i, p in enumerate(part):
        mean = {q: np.mean([gaps[i, j] for j, r in enumerate(part) if r == q and j != i]) for q in set(part) if q != p or part.count(p) > 1}
        want.append(0.0 if part.count(p) == 1 else (min(mean[q] for q in mean if q != p) - mean[p]) / max(min(mean[q] for q in mean if q != p), mean[p]))
    got = departments.split_quality(rows).first()
    assert abs(got.quality - np.mean(want)) < 1e-12 and (got.least, got.n) == (1, 5)
