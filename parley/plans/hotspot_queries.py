"""Queries of sessions, topics, words, trends and departments over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import hashing, text, vectors
from parley.operators import departments, incremental, ml, moments, sessions, topics, trend
from parley.plans.registry import query
from parley.settings import Settings
from parley.sources import readers
from parley.sources.readers import event_messages, table, topic_vectors

MESSAGES = """m AS (
    SELECT event_id AS id, user_id % 10 AS manager, user_id AS customer, event_type <> 'error' AS from_customer, event_type AS topic_id, ts AS msg_time, props AS content, value FROM events
)"""
SESSIONS = f"""WITH {MESSAGES}, g AS (
    SELECT *, CASE WHEN msg_time - lag(msg_time) OVER (PARTITION BY topic_id, customer ORDER BY msg_time, id) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM m WHERE from_customer
), s AS (
    SELECT *, sum(fresh) OVER (PARTITION BY topic_id, customer ORDER BY msg_time, id ROWS UNBOUNDED PRECEDING) AS seq FROM g
), ses AS (
    SELECT topic_id, customer, CAST(seq AS BIGINT) AS session_seq, count(*) AS msg_count, min(msg_time) AS started, max(msg_time) AS ended FROM s GROUP BY 1, 2, 3
)"""
WORDS = """w AS (
    SELECT lang AS topic_id, unnest(string_split_regex(lower(text), '\\s+')) AS word FROM documents
), t AS (SELECT topic_id, word, count(*) AS n FROM w WHERE word <> '' GROUP BY 1, 2)"""
TFIDF = f"""WITH {WORDS}, z AS (SELECT topic_id, sum(n) AS size FROM t GROUP BY 1), a AS (SELECT avg(size) AS mean FROM z), o AS (SELECT word, sum(n) AS alln FROM t GROUP BY 1),
    c AS (SELECT t.topic_id, t.word, round(CAST(n AS DOUBLE) / CAST(size AS DOUBLE) * ln(1 + mean / CAST(alln AS DOUBLE)), 8) AS score FROM t JOIN z USING (topic_id) JOIN o USING (word) CROSS JOIN a),
    r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, word) AS rank FROM c)"""
CENTERS = """e AS (SELECT CAST(label AS INTEGER) AS topic_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
    c AS (SELECT topic_id, pos, avg(CAST(x AS DOUBLE)) AS mean FROM e GROUP BY 1, 2)"""
COSINES = f"""WITH {CENTERS}, n AS (SELECT topic_id, sqrt(sum(mean * mean)) AS len FROM c GROUP BY 1),
    p AS (SELECT a.topic_id AS a, b.topic_id AS b, sum(a.mean * b.mean) AS d FROM c a JOIN c b ON a.pos = b.pos AND a.topic_id < b.topic_id GROUP BY 1, 2),
    sim AS (SELECT p.a, p.b, d / (x.len * y.len) AS similarity FROM p JOIN n x ON x.topic_id = p.a JOIN n y ON y.topic_id = p.b)"""
SLICES = """v AS (SELECT vec_id, CAST(label AS INTEGER) AS topic_id, vec_id % 3 + 1 AS msg_count, vec_id % 7 AS customer, vec_id % 10 AS staff FROM embeddings),
    roster AS (SELECT DISTINCT s_nationkey % 5 AS department, s_suppkey % 10 AS staff FROM supplier),
    sl AS (SELECT * FROM v JOIN roster USING (staff)),
    vol AS (SELECT department, topic_id, CAST(sum(msg_count) AS BIGINT) AS heat, count(*) AS session_count, count(DISTINCT customer) AS customer_count FROM sl GROUP BY 1, 2)"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = event_messages(spark, sf_dir).where("from_customer")
    return sessions.aggregate_sessions(sessions.sessionize(kept, ["topic_id", "customer"]), ["topic_id", "customer"], content=None)


def _slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    roster = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).alias("department"), (F.col("s_suppkey") % 10).alias("manager"))
    return departments.sliced(topic_vectors(spark, sf_dir), roster)


def _centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.packed(topics.centroids(topic_vectors(spark, sf_dir)))


def _words(spark: SparkSession, sf_dir: str, by: str = "lang") -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("topic_id", F.col(by))
    return topics.term_counts(docs, text.tokens(F.col("text")))


@query(f"{SESSIONS}, v AS (SELECT topic_id, CAST(sum(msg_count) AS BIGINT) AS heat, count(*) AS session_count, count(DISTINCT customer) AS customer_count FROM ses GROUP BY 1), r AS (SELECT *, round(heat * pow(greatest(1, customer_count), 0.3), 6) AS score FROM v) SELECT *, row_number() OVER (ORDER BY score DESC, topic_id) AS rank FROM r ORDER BY rank LIMIT 20")
def hotspot_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top 20 topics by messages times breadth of audience (the limit is the board)."""
    return topics.ranked(topics.topic_volume(_sessions(spark, sf_dir))).where("rank <= 20")


@query(f"{SESSIONS} SELECT topic_id, customer, session_seq, msg_count, started, ended, topic_id || ':' || customer || ':' || session_seq AS session_id FROM ses")
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir)


@query(f"WITH {MESSAGES} SELECT from_customer, count(*) AS n, count(DISTINCT customer) AS customers FROM m GROUP BY 1")
def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_messages(spark, sf_dir).groupBy("from_customer").agg(F.count("*").alias("n"), F.countDistinct("customer").alias("customers"))


@query("""WITH l AS (
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'wm' WHEN o_orderkey % 3 = 1 THEN 'staff' ELSE 'wo' END || o_custkey AS from_user, CASE WHEN o_custkey % 2 = 0 THEN 'staff' ELSE 'wm' END || o_custkey AS to_user FROM orders
), p AS (SELECT *, starts_with(from_user, 'wm') OR starts_with(from_user, 'wo') AS sent, starts_with(to_user, 'wm') OR starts_with(to_user, 'wo') AS got FROM l)
SELECT id, CASE WHEN sent THEN to_user ELSE from_user END AS manager, CASE WHEN sent THEN from_user ELSE to_user END AS customer, sent AS from_customer FROM p WHERE sent <> got""")
def pair_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as messages between made-up ids: those of which exactly one side is a customer."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 3
    sender = F.concat(F.when(k == 0, "wm").when(k == 1, "staff").otherwise("wo"), F.col("o_custkey").cast("string"))
    receiver = F.concat(F.when(F.col("o_custkey") % 2 == 0, "staff").otherwise("wm"), F.col("o_custkey").cast("string"))
    log = o.select(F.col("o_orderkey").alias("id"), sender.alias("from_user"), receiver.alias("to_user"), F.lit("").alias("content"), F.col("o_orderdate").alias("msg_time"))
    return sessions.pair_messages(log).select("id", "manager", "customer", "from_customer")


@query("""WITH h AS (SELECT c_custkey, c_name, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(c_name, ''), lambda x: CAST(unicode(x) AS BIGINT))), lambda a, c: (a * 31 + c) & 4294967295) AS u FROM customer),
g AS (SELECT c_custkey, CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS hash FROM h)
SELECT c_custkey, hash, ((hash % 20) + 20) % 20 + 1 AS shard FROM g""")
def shard_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", hashing.java_hash(name).alias("hash"), hashing.shard_number(name).alias("shard"))


@query()
def crc_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each of eight CRC-32 partitions of customers."""
    part = hashing.crc_partition(F.col("c_name"), 8)
    return table(spark, sf_dir, "customer").groupBy(part.alias("part")).agg(F.count("*").alias("n"))


MASKED = r"""WITH a AS (SELECT doc_id, text AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(^|[^0-9])[0-9]{17}[0-9Xx]($|[^0-9])', '\1[身份证]\2', 'g'), '(^|[^0-9])[0-9]{17}[0-9Xx]($|[^0-9])', '\1[身份证]\2', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}', '[邮箱]', 'g') AS t FROM b),
d AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(^|[^0-9])[0-9]{16,19}($|[^0-9])', '\1[卡号]\2', 'g'), '(^|[^0-9])[0-9]{16,19}($|[^0-9])', '\1[卡号]\2', 'g') AS t FROM c),
x AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(^|[^0-9])1[3-9][0-9]{9}($|[^0-9])', '\1[手机号]\2', 'g'), '(^|[^0-9])1[3-9][0-9]{9}($|[^0-9])', '\1[手机号]\2', 'g') AS t FROM d)"""


@query(f"{MASKED} SELECT doc_id, md5(t) AS masked_md5, length(t) AS masked_length FROM x")
def pii_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = text.mask_pii(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(masked).alias("masked_md5"), F.length(masked).cast("long").alias("masked_length"))


@query(r"""SELECT doc_id, md5(regexp_replace(text, '[ \t\n\r\x0b\f]+', '', 'g')) AS no_space, md5(regexp_replace(text, '[ \t\n\r\x0b\f\[\]【】（）()“”"''‘’「」《》<>，。、；：！？,.;:!?…·~～-]', '', 'g')) AS evidence,
CAST(ceil(round(0.7 * (length(text) - length(regexp_replace(text, '[　-〿㐀-鿿＀-￯]', '', 'g'))) + 0.35 * length(regexp_replace(text, '[　-〿㐀-鿿＀-￯]', '', 'g')), 6)) AS BIGINT) AS tokens,
CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '…' ELSE text END AS line, substr(text, 1, 7500) = text AS whole FROM documents""")
def text_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(text.without_space(t)).alias("no_space"), F.md5(text.evidence_key(t)).alias("evidence"), text.estimate_tokens(t).alias("tokens"),
        text.clip_line(t).alias("line"), (F.substring(t, 1, 7500) == t).alias("whole"),
    )


@query(r"""WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '\s+')) AS word FROM documents),
stop AS (SELECT DISTINCT n_word FROM (SELECT unnest(string_split_regex(lower(text), '\s+')) AS n_word FROM benchmark))
SELECT doc_id, count(*) AS n_tokens, count(DISTINCT word) AS n_words FROM w WHERE length(word) >= 2 AND word NOT IN (SELECT n_word FROM stop) GROUP BY 1""")
def filtered_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of two or more characters that no benchmark item has, which plays the stop words."""
    stop = table(spark, sf_dir, "benchmark").select(F.explode(text.tokens(F.col("text"))).alias("word")).distinct()
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.business_tokens(text.tokens(F.col("text")), han=False)).alias("word"))
    return words.join(stop, "word", "left_anti").groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.countDistinct("word").alias("n_words"))


@query(f"{TFIDF} SELECT topic_id, rank, word, score FROM r WHERE rank <= 10")
def class_tfidf_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.class_tfidf(_words(spark, sf_dir))


@query("SELECT md5(text) AS text_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(text)")
def unique_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an embedder would see: each text once, under its smallest id."""
    docs = table(spark, sf_dir, "documents").select(F.md5("text").alias("text_hash"), "doc_id")
    copies = docs.groupBy("text_hash").agg(F.count("*").alias("copies"))
    return topics.dedupe_first(docs, ["text_hash"], ["doc_id"]).join(copies, "text_hash")


@query("SELECT DISTINCT md5(text) AS text_hash FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM benchmark UNION ALL SELECT md5(text) FROM documents WHERE source = 'src1')")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text_hash", F.md5("text"))
    cache = table(spark, sf_dir, "benchmark").select(F.md5("text").alias("text_hash")).union(docs.where("source = 'src1'").select("text_hash")).distinct()
    return incremental.misses(docs, cache).select("text_hash")


@query(f"WITH {CENTERS} SELECT topic_id, pos, round(mean, 6) AS mean FROM c")
def topic_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.centroids(topic_vectors(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query(f"{COSINES} SELECT a, b, round(similarity, 6) AS similarity FROM sim")
def centroid_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.centroid_similarity(_centers(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


_NEAREST = f"""WITH {CENTERS}, v AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
    d AS (SELECT vec_id, topic_id, sqrt(sum((CAST(x AS DOUBLE) - mean) * (CAST(x AS DOUBLE) - mean))) AS d FROM v JOIN c USING (pos) GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, topic_id) AS n FROM d),
    q AS (SELECT a.vec_id, a.topic_id, a.d AS distance, (b.d - a.d) / greatest(b.d, 1e-12) AS margin FROM k a JOIN k b ON a.vec_id = b.vec_id AND a.n = 1 AND b.n = 2)"""


@query(f"{_NEAREST} SELECT vec_id, topic_id, round(distance, 5) AS distance, round(margin, 5) AS margin FROM q")
def nearest_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topic_vectors(spark, sf_dir).select(F.col("n").alias("vec_id"), "vector")
    return topics.nearest_centroid(rows, _centers(spark, sf_dir)).select("vec_id", "topic_id", F.round("distance", 5).alias("distance"), F.round("margin", 5).alias("margin"))


_GATES = Settings(max_distance=0.95, min_margin=0.01)


@query(f"""{_NEAREST}, g AS (SELECT vec_id, CASE WHEN distance > 0.95 OR margin < 0.01 THEN -1 ELSE topic_id END AS topic_id, distance, vec_id % 3 + 1 AS msg_count FROM q)
SELECT count(*) FILTER (topic_id <> -1) AS assigned, count(*) FILTER (topic_id = -1) AS rejected, CAST(coalesce(sum(msg_count) FILTER (topic_id = -1), 0) AS BIGINT) AS rejected_messages, round(avg(CASE WHEN topic_id <> -1 THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(distance * distance) FILTER (topic_id <> -1), 5) AS mean_squared_distance FROM g""")
def gate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topic_vectors(spark, sf_dir).select("vector", "msg_count")
    out = topics.coverage(topics.nearest_centroid(rows, _centers(spark, sf_dir), s=_GATES))
    return out.withColumn("coverage", F.round("coverage", 6)).withColumn("mean_squared_distance", F.round("mean_squared_distance", 5))


_MERGE = Settings(merge_similarity=0.05)
_MERGED = f"""WITH RECURSIVE {COSINES.removeprefix("WITH ")}, vol AS (SELECT CAST(label AS INTEGER) AS topic_id, CAST(sum(vec_id % 3 + 1) AS BIGINT) AS heat FROM embeddings GROUP BY 1),
    l AS (SELECT a, b FROM sim WHERE similarity >= 0.05 UNION ALL SELECT b, a FROM sim WHERE similarity >= 0.05),
    reach AS (SELECT topic_id AS a, topic_id AS b FROM vol UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
    best AS (SELECT r.a AS topic_id, arg_min(v.topic_id, -v.heat * 1000 + v.topic_id) AS canonical FROM reach r JOIN vol v ON v.topic_id = r.b GROUP BY 1)"""


@query(f"{_MERGED} SELECT topic_id, canonical FROM best")
def single_linkage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = topic_vectors(spark, sf_dir)
    return topics.merge_map(topics.topic_volume(v), _centers(spark, sf_dir), s=_MERGE)


@query(f"{_MERGED} SELECT canonical AS topic_id, CAST(sum(e.vec_id % 3 + 1) AS BIGINT) AS heat, count(*) AS session_count, count(DISTINCT e.vec_id % 7) AS customer_count FROM embeddings e JOIN best ON best.topic_id = e.label GROUP BY 1")
def canonical_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = topic_vectors(spark, sf_dir)
    mapping = topics.merge_map(topics.topic_volume(v), _centers(spark, sf_dir), s=_MERGE)
    return topics.topic_volume(topics.canonical_sessions(v, mapping))


@query()
def average_linkage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = topic_vectors(spark, sf_dir)
    return topics.merge_map(topics.topic_volume(v), _centers(spark, sf_dir), s=Settings(merge_similarity=0.05, merge_linkage="average"))


@query()
def complete_linkage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = topic_vectors(spark, sf_dir)
    return topics.merge_map(topics.topic_volume(v), _centers(spark, sf_dir), s=Settings(merge_similarity=0.05, merge_linkage="complete"))


@query("SELECT c_mktsegment AS topic_id, count(*) AS heat, count(DISTINCT o_custkey) AS customer_count, round(count(*) * pow(count(DISTINCT o_custkey), 0.3), 6) AS score FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def customer_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = rows.groupBy(F.col("c_mktsegment").alias("topic_id")).agg(F.count("*").alias("heat"), F.countDistinct("o_custkey").alias("customer_count"))
    return out.withColumn("score", F.round(topics.rank_score(F.col("heat"), F.col("customer_count")), 6))


@query(f"WITH {SLICES} SELECT * FROM vol")
def department_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.topic_volume(_slices(spark, sf_dir), ["department", "topic_id"])


_FLOOR = Settings(department_min_share=0.1)
_BOARD = f"""WITH {SLICES}, tot AS (SELECT department, sum(session_count) AS total FROM vol GROUP BY 1),
    fl AS (SELECT vol.*, greatest(3, CAST(ceil(round(total * 0.1, 9)) AS BIGINT)) AS floor FROM vol JOIN tot USING (department)),
    sc AS (SELECT department, topic_id, heat, session_count, customer_count, floor, round(heat * pow(greatest(1, customer_count), 0.3), 6) AS score FROM fl WHERE session_count >= floor)
    SELECT *, row_number() OVER (PARTITION BY department ORDER BY score DESC, topic_id) AS rank FROM sc"""


@query(_BOARD)
def department_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All departments at once: topics over the floor, ranked in each."""
    volume = topics.topic_volume(_slices(spark, sf_dir), ["department", "topic_id"])
    return topics.ranked(departments.above_floor(volume, _FLOOR).drop("total"), ["department"])


_LOCAL = f"""WITH {SLICES}, {CENTERS}, x AS (SELECT sl.department, sl.topic_id, u.pos, avg(CAST(u.x AS DOUBLE)) AS mean FROM sl JOIN (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) u USING (vec_id) GROUP BY 1, 2, 3),
    sm AS (SELECT x.department, x.topic_id, sum(x.mean * c.mean) / (sqrt(sum(x.mean * x.mean)) * sqrt(sum(c.mean * c.mean))) AS similarity FROM x JOIN c ON c.topic_id = x.topic_id AND c.pos = x.pos GROUP BY 1, 2)"""
_DRIFT = Settings(drift_similarity=0.9, split_min_sessions=8)


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = _slices(spark, sf_dir)
    by = ["department", "topic_id"]
    local = topics.topic_volume(slices, by).join(topics.packed(topics.centroids(slices, by), by), by)
    return departments.drifted(local, _centers(spark, sf_dir), _DRIFT)


@query(f"{_LOCAL} SELECT department, topic_id, session_count, round(similarity, 6) AS similarity FROM sm JOIN vol USING (department, topic_id) WHERE session_count >= 8 AND similarity < 0.9")
def department_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(spark, sf_dir).select("department", "topic_id", "session_count", F.round("similarity", 6).alias("similarity"))


@query(f"{_LOCAL} SELECT count(*) AS n, round(min(similarity), 6) AS least, round(quantile_cont(similarity, 0.5), 6) AS median FROM sm JOIN vol USING (department, topic_id) WHERE session_count >= 8")
def drift_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, minimum and median of the similarities that the drift of departments is judged by."""
    slices, by = _slices(spark, sf_dir), ["department", "topic_id"]
    local = topics.topic_volume(slices, by).join(topics.packed(topics.centroids(slices, by), by), by)
    found = departments.large_enough(departments.similarities(local, _centers(spark, sf_dir)), _DRIFT).agg(*departments.distribution())
    return found.select("n", *(F.round(c, 6).alias(c) for c in ("least", "median")))


@query()
def department_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes after drifting topics were split where they have parts."""
    out = departments.split_targets(_slices(spark, sf_dir), _drift(spark, sf_dir), 10)
    return topics.topic_volume(out, ["department", "topic_id", "parent_topic_id"])


@query("""WITH t AS (SELECT DISTINCT lang, word, n FROM (SELECT lang, word, count(*) AS n FROM (SELECT lang, source, unnest(string_split_regex(lower(text), '\\s+')) AS word FROM documents) GROUP BY 1, 2) WHERE word <> '')
SELECT a.lang AS a, b.lang AS b, count(*) AS common FROM t a JOIN t b ON a.word = b.word AND a.lang < b.lang GROUP BY 1, 2""")
def shared_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that two languages have in common: a join on words, after each language's are distinct."""
    t = _words(spark, sf_dir).select("topic_id", "word")
    a, b = t.select(F.col("topic_id").alias("a"), "word"), t.select(F.col("topic_id").alias("b"), "word")
    return a.join(b, "word").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))


_BOARDS = r"""WITH d AS (SELECT *, source AS topic_id, doc_id % 2 AS half FROM documents), w AS (SELECT half, topic_id, unnest(string_split_regex(lower(text), '\s+')) AS word FROM d),
    t AS (SELECT half, topic_id, word, count(*) AS n FROM w WHERE word <> '' GROUP BY 1, 2, 3),
    tr AS (SELECT *, row_number() OVER (PARTITION BY half, topic_id ORDER BY n DESC, word) AS k FROM t),
    vol AS (SELECT half, topic_id, count(*) AS heat FROM d GROUP BY 1, 2), vr AS (SELECT *, row_number() OVER (PARTITION BY half ORDER BY heat DESC, topic_id) AS rank FROM vol),
    b AS (SELECT vr.half, vr.rank, vr.topic_id, vr.heat, tr.word FROM vr JOIN tr ON tr.half = vr.half AND tr.topic_id = vr.topic_id AND k <= 10 WHERE rank <= 20),
    j AS (SELECT x.rank, y.topic_id AS prev_topic, y.rank AS prev_rank, y.heat AS prev_heat, count(*) AS c FROM b x JOIN b y ON x.half = 1 AND y.half = 0 AND x.word = y.word GROUP BY 1, 2, 3, 4),
    s AS (SELECT half, rank, count(*) AS n FROM b GROUP BY 1, 2)"""


def _boards(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sources as topics, documents of odd and even number as today and yesterday, their commonest words as hot words."""
    d = table(spark, sf_dir, "documents").withColumn("half", F.col("doc_id") % 2).withColumnRenamed("source", "topic_id")
    terms = topics.term_counts(d, text.tokens(F.col("text")), ["half", "topic_id"])
    from pyspark.sql import Window

    top = terms.withColumn("k", F.row_number().over(Window.partitionBy("half", "topic_id").orderBy(F.desc("n"), "word"))).where("k <= 10")
    words = top.groupBy("half", "topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]).alias("words"))
    volume = d.groupBy("half", "topic_id").agg(F.count("*").alias("heat"))
    rank = F.row_number().over(Window.partitionBy("half").orderBy(F.desc("heat"), "topic_id"))
    boards = volume.withColumn("rank", rank).where("rank <= 20").join(words, ["half", "topic_id"])
    return boards.where("half = 1").drop("half"), boards.where("half = 0").drop("half")


@query(f"{_BOARDS} SELECT j.rank, j.prev_rank, j.prev_topic, j.prev_heat, round(CAST(c AS DOUBLE) / (x.n + y.n - c), 6) AS similarity FROM j JOIN s x ON x.half = 1 AND x.rank = j.rank JOIN s y ON y.half = 0 AND y.rank = j.prev_rank")
def trend_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.similarities(*_boards(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


@query(_BOARDS.replace("WITH d AS", "WITH RECURSIVE d AS") + """, sims AS (SELECT j.rank, j.prev_rank, j.prev_topic, j.prev_heat, CAST(c AS DOUBLE) / (x.n + y.n - c) AS similarity FROM j JOIN s x ON x.half = 1 AND x.rank = j.rank JOIN s y ON y.half = 0 AND y.rank = j.prev_rank),
    g AS (SELECT CAST(0 AS BIGINT) AS rank, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS pick
        UNION ALL SELECT rank + 1, CASE WHEN best IS NULL THEN used ELSE list_append(used, best) END, best FROM (
            SELECT g.rank, g.used, (SELECT CASE WHEN arg_min(similarity, (-similarity, prev_rank)) >= 0.3 AND arg_min(prev_heat, (-similarity, prev_rank)) > 0 THEN min_by(prev_rank, (-similarity, prev_rank)) END
                FROM sims WHERE sims.rank = g.rank + 1 AND NOT list_contains(g.used, sims.prev_rank)) AS best FROM g WHERE g.rank < 20)),
    m AS (SELECT g.rank, sims.prev_topic, sims.prev_heat FROM g JOIN sims ON sims.rank = g.rank AND sims.prev_rank = g.pick),
    o AS (SELECT vr.topic_id, vr.heat, CAST(vr.rank AS INTEGER) AS rank, m.prev_topic, m.prev_heat, round((vr.heat - m.prev_heat) / CAST(m.prev_heat AS DOUBLE), 4) AS pct FROM vr LEFT JOIN m ON m.rank = vr.rank WHERE half = 1 AND vr.rank <= 20)
    SELECT topic_id, heat, rank, prev_topic, coalesce(prev_heat, 0) AS prev_heat, pct AS heat_change_pct, prev_heat IS NULL AS is_new, heat >= 20 AND (prev_heat IS NULL OR pct >= 0.5) AS is_surge FROM o""")
def trend_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board with each topic's match of the day before, chosen greedily by rank."""
    return trend.with_trend(*_boards(spark, sf_dir)).drop("words")


@query("SELECT r_name, n_name, c_mktsegment, count(*) AS heat, count(DISTINCT o_custkey) AS customer_count FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((c_mktsegment), (r_name, c_mktsegment), (r_name, n_name, c_mktsegment))")
def boards_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The company's and the departments' boards as grouping sets of one scan."""
    for name in ("orders", "customer", "nation", "region"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"_{name}")
    return spark.sql("""SELECT r_name, n_name, c_mktsegment, count(*) AS heat, count(DISTINCT o_custkey) AS customer_count
        FROM _orders JOIN _customer ON o_custkey = c_custkey JOIN _nation ON c_nationkey = n_nationkey JOIN _region ON n_regionkey = r_regionkey
        GROUP BY GROUPING SETS ((c_mktsegment), (r_name, c_mktsegment), (r_name, n_name, c_mktsegment))""")


@query("WITH r AS (SELECT doc_id, lang AS topic_id, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS sample_rank FROM documents) SELECT * FROM r WHERE sample_rank <= 40")
def bottom_k_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty documents of each language by hash (the operator is a sample)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("topic_id"))
    return topics.bottom_k(docs, F.col("doc_id"), 40)


@query()
def kmeans_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions and messages of each topic of a PCA and k-means clustering."""
    rows = topic_vectors(spark, sf_dir).select("session_id", "msg_count", "customer", "vector")
    out = ml.cluster_topics(rows, s=Settings(clusters=10))
    return topics.topic_volume(out)


@query("""WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), m AS (SELECT i, avg(x) AS mean, count(*) AS n FROM e GROUP BY 1)
SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, p.n, round(p.mean, 6) + 0.0 AS mean, round(sum((a.x - p.mean) * (b.x - q.mean)), 4) + 0.0 AS scatter FROM e a JOIN e b USING (vec_id) JOIN m p ON p.i = a.i JOIN m q ON q.i = b.i GROUP BY 1, 2, 3, 4""")
def merged_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and scatter of all vectors, merged from the sketches of seven days (by number) without their rows."""
    rows = topic_vectors(spark, sf_dir).select((F.col("n") % 7).alias("day"), "vector")
    out = moments.merged_moments(moments.moments(rows, ["day"]).drop("day"))
    out = out.select("i", "n", F.element_at("mean", F.col("i") + 1).alias("mean"), F.posexplode("scatter").alias("j", "scatter"))
    return out.select("i", "j", "n", (F.round("mean", 6) + F.lit(0.0)).alias("mean"), (F.round("scatter", 4) + F.lit(0.0)).alias("scatter"))


@query()
def incremental_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions and messages of each topic of the batch-wise clustering."""
    rows = topic_vectors(spark, sf_dir).select("session_id", "msg_count", "customer", "vector")
    return topics.topic_volume(moments.incremental_topics(rows, s=Settings(clusters=10)))


@query()
def diverse_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight diverse texts of each topic's pool."""
    v = topic_vectors(spark, sf_dir).select("n", "topic_id", "vector")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("n"), "text")
    pool = topics.bottom_k(v.join(docs, "n"), F.col("n"), Settings().pool_size)
    return ml.representative_texts(pool).withColumn("text", F.md5("text"))


@query(f"WITH {CENTERS}, n AS (SELECT topic_id, sqrt(sum(mean * mean)) AS len FROM c GROUP BY 1), v AS (SELECT vec_id, CAST(label AS INTEGER) AS topic_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), d AS (SELECT vec_id, topic_id, sum(CAST(x AS DOUBLE) * mean) AS dot, sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS own FROM v JOIN c USING (topic_id, pos) GROUP BY 1, 2) SELECT vec_id, round(dot / (own * len), 6) AS similarity FROM d JOIN n USING (topic_id)")
def topic_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each session's vector with its topic's centroid."""
    rows = topic_vectors(spark, sf_dir).join(F.broadcast(_centers(spark, sf_dir)), "topic_id")
    return rows.select(F.col("n").alias("vec_id"), F.round(vectors.cosine(F.col("vector"), F.col("centroid")), 6).alias("similarity"))


@query(f"{SESSIONS}, x AS (SELECT topic_id, customer, CAST(seq AS BIGINT) AS session_seq, count(*) AS msg_count, string_agg(content, ' ' ORDER BY msg_time, id) AS text FROM s GROUP BY 1, 2, 3) SELECT topic_id, customer, session_seq, msg_count, md5(text) AS text_hash FROM x")
def session_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with the fingerprint of their joined and masked texts, in message order."""
    kept = event_messages(spark, sf_dir).where("from_customer")
    out = sessions.aggregate_sessions(sessions.sessionize(kept, ["topic_id", "customer"]), ["topic_id", "customer"])
    return out.select("topic_id", "customer", "session_seq", "msg_count", "text_hash")


_LOG = "SELECT event_id AS id, ts AS msg_time, CAST(CAST(ts AS DATE) AS VARCHAR) AS create_date, CASE WHEN event_id % 7 = 0 THEN 'image' ELSE 'text' END AS msg_type, CASE WHEN event_type = 'error' THEN 's' || user_id % 10 ELSE 'wm' || user_id END AS from_user, CASE WHEN event_type = 'error' THEN 'wm' || user_id ELSE 's' || user_id % 10 END AS to_user, substr(props, 1, 1 + event_id % 12) AS content FROM events"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a raw log: errors come from a manager, every seventh is an image, contents have 1 to 12 characters."""
    e, staff, customer = table(spark, sf_dir, "events"), F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string")), F.concat(F.lit("wm"), F.col("user_id").cast("string"))
    error = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("msg_time"), F.to_date("ts").cast("string").alias("create_date"), F.when(F.col("event_id") % 7 == 0, "image").otherwise("text").alias("msg_type"),
        F.when(error, staff).otherwise(customer).alias("from_user"), F.when(error, customer).otherwise(staff).alias("to_user"), F.expr("substr(props, 1, CAST(1 + event_id % 12 AS INT))").alias("content"),
    )


@query(f"WITH l AS ({_LOG}) SELECT id, to_user AS staff, from_user AS customer, content FROM l WHERE create_date = '2024-01-10' AND msg_type = 'text' AND from_user LIKE 'wm%'")
def day_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' text messages of a day by its creation date."""
    return readers.customer_messages(_log(spark, sf_dir), "2024-01-10").select("id", "staff", "customer", "content")


@query(f"WITH l AS ({_LOG}) SELECT id, from_user, to_user FROM l WHERE msg_type = 'text' AND msg_time >= TIMESTAMP '2024-01-10' AND msg_time < TIMESTAMP '2024-01-11'")
def day_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text messages of a day by message time, its bounds half open."""
    return readers.day_messages(_log(spark, sf_dir), "2024-01-10").select("id", "from_user", "to_user")


@query(f"WITH l AS ({_LOG}) SELECT id FROM l WHERE msg_type = 'text' AND (from_user = 's3' OR to_user = 's3') AND msg_time >= TIMESTAMP '2024-01-05' AND msg_time < TIMESTAMP '2024-01-21'")
def manager_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text messages from or to one manager between two days, both included."""
    return readers.manager_messages(_log(spark, sf_dir), "s3", "2024-01-05", "2024-01-20").select("id")


@query(f"WITH l AS ({_LOG}), c AS (SELECT content FROM l GROUP BY 1 HAVING count(*) > 50) SELECT id FROM l WHERE msg_type = 'text' AND length(trim(content)) >= 5 AND trim(content) NOT IN (SELECT trim(content) FROM c)")
def kept_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages long enough that are not chitchat, which common contents play here."""
    log = _log(spark, sf_dir)
    chitchat = log.groupBy(F.trim("content").alias("word")).agg(F.count("*").alias("n")).join(log.groupBy("content").agg(F.count("*").alias("m")).where("m > 50").select(F.trim("content").alias("word")).distinct(), "word").select("word")
    return sessions.keep_messages(log, chitchat).select("id")


@query(f"WITH l AS ({_LOG}) SELECT id, from_user FROM l WHERE msg_type = 'text' UNION ALL SELECT id, from_user FROM l WHERE msg_type = 'image'")
def union_of_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log put together from two shards whose columns stand in another order."""
    log = _log(spark, sf_dir)
    return readers.union_of_shards([log.where("msg_type = 'text'").select("id", "from_user"), log.where("msg_type = 'image'").select("from_user", "id")])


@query("""WITH old AS (SELECT 'term' AS kind, n_name AS word, n_nationkey % 2 = 0 AS enabled FROM nation), added AS (SELECT 'term' AS kind, lower(n_name) AS word FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'term', r_name || ' region' FROM region)
SELECT coalesce(o.kind, a.kind) AS kind, coalesce(o.word, a.word) AS word, (coalesce(o.enabled, false) OR a.word IS NOT NULL) AND lower(coalesce(o.word, a.word)) <> 'brazil' AS enabled FROM old o FULL JOIN added a ON lower(o.word) = lower(a.word)""")
def lexicon_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon after words were added, some of them again in another case, and one was switched off."""
    nation = table(spark, sf_dir, "nation")
    old = nation.select(F.lit("term").alias("kind"), F.col("n_name").alias("word"), (F.col("n_nationkey") % 2 == 0).alias("enabled"))
    new = nation.where("n_nationkey % 3 = 0").select(F.lower("n_name").alias("word")).union(table(spark, sf_dir, "region").select(F.concat("r_name", F.lit(" region"))))
    return readers.lexicon_removed(readers.lexicon_added(old, new, "term"), "Brazil", "term").select("kind", "word", "enabled")


@query("""WITH m AS (SELECT lang AS topic_id, source AS member, count(*) AS size FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2), p AS (SELECT *, unnest(range(1, least(size, 40) + 1)) AS place FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY place > 1, CAST(size AS DOUBLE) / place DESC, member) AS k FROM p) SELECT topic_id, member, count(*) AS places FROM r WHERE k <= 40 GROUP BY 1, 2""")
def pool_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the forty places of a language's pool go to its sources."""
    members = table(spark, sf_dir, "documents").where("lang IS NOT NULL").groupBy(F.col("lang").alias("topic_id"), F.col("source").alias("member")).agg(F.count("*").alias("size"))
    return topics.quotas(members, 40)


@query(f"WITH {SLICES}, cat AS (SELECT DISTINCT topic_id, 'intent ' || topic_id AS intent FROM v WHERE topic_id % 2 = 0) SELECT department, topic_id, coalesce(intent, '客户关注word' || topic_id || '、x、y') AS customer_intent, CASE WHEN intent IS NULL THEN 'department' ELSE 'global' END AS intent_source FROM vol LEFT JOIN cat USING (topic_id)")
def intent_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents of department topics from the company's catalog, else from their hot words."""
    volume = topics.topic_volume(_slices(spark, sf_dir), ["department", "topic_id"]).withColumn("parent_topic_id", F.lit(None).cast("int"))
    board = volume.withColumn("words", F.array(F.concat(F.lit("word"), F.col("topic_id").cast("string")), F.lit("x"), F.lit("y"), F.lit("z")))
    catalog = topic_vectors(spark, sf_dir).where("topic_id % 2 = 0").select("topic_id", F.concat(F.lit("intent "), F.col("topic_id").cast("string")).alias("customer_intent")).distinct()
    return departments.with_fallback(board, catalog).select("department", "topic_id", "customer_intent", "intent_source")
