"""Registered queries of parley.llm, and the pipeline against a plain version of its stages."""

import re
import zlib

import __spark_entry__ as entry
import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from oracle import compare
from tokenizers import Tokenizer

from parley.llm import queries, secrets, toxicity
from test_near_copies import jaccard, plain_shingles

EMBEDDINGS = ("op5_vector_join", "op13_centroids")  # the queries of that table; all others are of documents


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    compare(spark, sf, queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_has_a_row_for_each_row(spark, sf, name):
    rows = queries.QUERIES[name](spark, sf).count()
    own = spark.read.parquet(f"{sf}/{'embeddings' if name in EMBEDDINGS else 'documents'}.parquet").count()
    assert rows >= own if name.startswith("op9") else rows == own


def test_entry_lists_them():
    assert {"pipeline", *queries.QUERIES} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_like_its_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit_folds(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(docs.select("doc_id", "text"), model).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text or "") for r in docs.collect() if r.doc_id not in toxic]
    best = {}
    for i, t in rows:
        key = re.sub("[\x20\x09-\x0d]", "", t)
        best[key] = min(best.get(key, (1, 0, "")), (-len(t), i, t))
    rows = sorted((i, t) for _, i, t in best.values())
    sets = [plain_shingles(t) if t.split() else set() for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8]
    label, before = [i for i, _ in rows], None
    while label != before:
        before = list(label)
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    rows = [(i, t) for (i, t), c in zip(rows, label, strict=True) if i == c]
    words = secrets.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, t in rows:
        ids = np.array([*tok.encode(secrets.redacted_text(t, secrets.find_secrets(t, words)), add_special_tokens=False).ids, 1], "<u4")
        want |= {(i, s, zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048)}
    out = corpus_pipeline.run(spark, sf).collect()
    assert {(r.doc_id, r.start, r.ids_crc32, r.doc_tokens) for r in out} == want and len(out) == len(want)


def test_stages_keep_the_columns_and_stand_odd_rows(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9002, "", "en", "s", 0), (None, "null id", "en", "s", 7)], docs.schema)
    for rows in (docs.union(odd), docs.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, rows, sf)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            path = str(tmp_path / f"{k}-{rows.count()}-{id(rows)}")
            out.write.parquet(path)
            rows = spark.read.parquet(path)
