"""Table functions in SQL, the log for trials, phrase automata, pool sketches and linkage against plain versions."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import tables
from parley.functions.hashing import shard_number
from parley.functions.segment import Dictionary
from parley.operators import contacts, evidence, topics
from parley.sources import synthetic

WORDS = {"定期": 30, "存款": 50, "定期存款": 20, "利率": 40, "多少": 60}


def test_tokenize_in_sql(spark):
    tables.register(spark, WORDS)
    rows = [(1, "定期存款利率是多少 abc"), (2, None), (3, ""), (1, "利率 利率")]
    spark.createDataFrame(rows, "id int, text string").createOrReplaceTempView("_texts")
    got = [tuple(r) for r in spark.sql("SELECT id, t.place, t.word FROM _texts, LATERAL tokenize(text) t").collect()]
    assert sorted(got) == sorted((i, k, w) for i, t in rows for k, w in enumerate(Dictionary(WORDS).words(t)))


def test_rows_within_a_budget_in_sql(spark):
    tables.register(spark)
    rng = np.random.default_rng(1)
    rows = [(f"m{rng.integers(3)}", int(rng.integers(4)), i, int(rng.integers(1, 30)) if i % 11 else None, f"t{i}") for i in range(300)]
    lines = spark.createDataFrame(rows, "manager string, customer int, line_no int, cost int, line string")
    lines.repartition(5).createOrReplaceTempView("_lines")
    got = spark.sql("SELECT * FROM within_budget(TABLE(_lines), 'manager, customer', 'line_no', 'cost', 60)")
    want = contacts.fitted_lines(lines, F.coalesce("cost", F.lit(0)), 60, keys=["manager", "customer"])
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []
    with pytest.raises(Exception, match="no column nothing"):
        spark.sql("SELECT * FROM within_budget(TABLE(_lines), 'nothing', 'line_no', 'cost', 60)")


def test_alias_table_has_the_weights():
    for weights in ([1], [1, 1], [14, 12, 1, 3], [s[1] for s in synthetic.SCENARIOS], [0, 5, 0.5]):
        share, alias = synthetic.alias_table(weights)
        mass = np.zeros(len(weights))
        for i, (x, j) in enumerate(zip(share, alias, strict=True)):
            mass[i] += x
            mass[j] += 1 - x
        assert np.allclose(mass / len(weights), np.array(weights) / sum(weights))


def test_log_is_the_same_by_any_partitions_and_has_its_shares(spark):
    log = synthetic.synthetic_log(spark, 4000, seed=7)
    n = log.count()
    same = log.select(F.bit_xor(F.xxhash64(*log.columns))).first()[0]
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "13")
    try:
        assert synthetic.synthetic_log(spark, 4000, seed=7).select(F.bit_xor(F.xxhash64(*log.columns))).first()[0] == same
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert synthetic.synthetic_log(spark, 4000, seed=8).select(F.bit_xor(F.xxhash64(*log.columns))).first()[0] != same
    assert log.select("id").distinct().count() == n and 4000 * 5 < n < 4000 * 6
    weights = {s[0]: s[1] / 100 for s in synthetic.SCENARIOS}
    found = {r.scenario: r.n / 4000 for r in log.groupBy("scenario").agg(F.countDistinct(F.floor(F.col("id") / 16)).alias("n")).collect()}
    assert sum(weights.values()) == pytest.approx(1) and all(abs(found[k] - w) < 5 * (w / 4000) ** 0.5 for k, w in weights.items())
    later = log.where("id % 16 > 0")
    assert abs(later.where("msg_type <> 'text'").count() / later.count() - synthetic.OTHER_SHARE) < 0.01
    assert log.where(F.col("shard") != shard_number(F.col("from_user"))).count() == 0 and log.where("id % 16 = 0 AND from_user NOT LIKE 'wm%'").count() == 0
    days = synthetic.log_statistics(log).collect()
    assert len(days) == 30 and sum(d.messages for d in days) == n


@pytest.mark.parametrize("most", [4_000_000, 30])
def test_phrases_in_texts(spark, most):
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("ab"), n))
    texts = [(i, word(rng.integers(0, 40)) if i % 9 else None) for i in range(80)] + [(3, "abab")]
    phrases = [(i, word(rng.integers(1, 7))) for i in range(40)] + [(98, ""), (99, None), (7, "aba"), (55, "aba")]
    got = evidence.contained(spark.createDataFrame(texts, "doc long, t string"), spark.createDataFrame(phrases, "item long, p string"), most)
    want = sorted((d, i) for d, t in texts for i, p in phrases if t and p and p in t)
    assert sorted(map(tuple, got.collect())) == want != []
    assert evidence.contained(spark.createDataFrame(texts, "doc long, t string"), spark.createDataFrame([], "item long, p string")).count() == 0


def test_sketches_of_parts_merge_to_the_sketch_of_all(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.zipf(1.5)) % 6 if i % 50 else None, i, f"text {i}", [float(i), 1.0]) for i in range(3000)]
    df = spark.createDataFrame(rows, "topic_id int, n int, text string, vector array<double>").repartition(7)
    ranked = df.selectExpr("*", "row_number() over (partition by topic_id order by md5(cast(n as string)), cast(n as string)) as sample_rank").where("sample_rank <= 40")
    order = lambda x: sorted(map(str, x.select("topic_id", "n", "text", "vector", "sample_rank").collect()))
    assert order(topics.bottom_k(df, F.col("n"), 40)) == order(ranked)
    parts = [topics.pool_sketch(df.where(F.col("n") % 3 == k), F.col("n"), 40) for k in range(3)]
    assert order(topics.ranked_sketch(topics.merged_sketch(parts[0].union(parts[1]).union(parts[2]), 40))) == order(ranked)
    # Topics that became one: their sketches merge without the rows.
    one = F.when(F.col("topic_id") < 3, 0).otherwise(F.col("topic_id"))
    merged = topics.merged_sketch(topics.pool_sketch(df, F.col("n"), 40).withColumn("topic_id", one), 40)
    assert order(topics.ranked_sketch(merged)) == order(topics.bottom_k(df.withColumn("topic_id", one), F.col("n"), 40))
    keyed = df.select("topic_id", F.md5(F.col("n").cast("string")).alias("_order"), F.col("n").cast("string").alias("_tie"))
    parts = keyed.rdd.getNumPartitions()
    assert keyed.mapInArrow(topics._smallest(5, 1, keyed.schema), keyed.schema).count() <= 5 * 7 * parts  # what a task sends


def plain_linkage(centers, threshold, method):
    """All pairs of groups, again and again."""
    length = [np.linalg.norm(c) for c in centers]
    gap = lambda i, j: 1 - centers[i] @ centers[j] / (length[i] * length[j]) if min(length[i], length[j]) > 1e-12 else np.inf
    join = {"single": min, "complete": max, "average": lambda x: sum(x) / len(x)}[method]
    groups = [[i] for i in range(len(centers))]
    while len(groups) > 1:
        d, a, b = min((join([gap(i, j) for i in groups[a] for j in groups[b]]), a, b) for a in range(len(groups)) for b in range(a + 1, len(groups)))
        if d > 1 - threshold + 1e-12:
            break
        groups[a] += groups.pop(b)
    return sorted(sorted(g) for g in groups)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from(["single", "average", "complete"]), st.floats(0.1, 0.98))
def test_linkage_like_all_pairs_of_groups(seed, method, threshold):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(rng.integers(2, 14), 3))
    centers[rng.random(len(centers)) < 0.1] = 0
    group = topics.linkage_groups(centers, threshold, method)
    found = sorted(sorted(np.flatnonzero(group == g).tolist()) for g in np.unique(group))
    assert found == plain_linkage(centers, threshold, method)


def test_linkage_of_many_topics():
    rng = np.random.default_rng(0)
    centers = np.repeat(rng.normal(size=(2500, 16)), 2, axis=0) + rng.normal(0, 0.01, (5000, 16))
    for method in ("single", "average", "complete"):
        assert len(np.unique(topics.linkage_groups(centers, 0.97, method))) == 2500


def test_keys_of_any_type_in_sketches(spark):
    schema = T.StructType([T.StructField("topic_id", T.StringType()), T.StructField("n", T.DateType())])
    df = spark.createDataFrame([], schema)
    assert topics.bottom_k(df, F.col("n"), 3).columns == ["topic_id", "n", "sample_rank"]
    assert topics.bottom_k(df, F.col("n"), 3).count() == 0
