"""Bounds that only show at a size tests don't reach: id fields, many spans, pivots of every label."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from parley.llm import packing, queries, secrets, vector_join

WORDS_PATH = public_tokenizers.path("word_bpe_49k.json")


def test_numbers_of_windows_never_meet():
    ids = packing.Ids(2, 3, 4)
    spans = [range(ids.first(r, p), ids.first(r, p) + 16) for r in range(4) for p in range(8)]
    assert len({x for s in spans for x in s}) == 4 * 8 * 16
    for wrong in ((4, 0), (0, 8)):
        with pytest.raises(OverflowError):
            ids.first(*wrong)
    with pytest.raises(OverflowError):
        ids.within(17)
    whole = packing.Ids()
    assert whole.first((1 << whole.round_bits) - 1, (1 << whole.partition_bits) - 1) + (1 << whole.window_bits) <= 1 << 63
    assert whole.first(1, 0) > whole.first(0, 800_000)


def test_packing_with_narrow_id_fields(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "repeat(concat('w', id, ' '), cast(id % 97 as int)) as text").repartition(12)
    out = packing.pack_documents(docs, WORDS_PATH, window=64, open_windows=4, ids=packing.Ids(3, 4, 12))
    taken = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.min("offset").alias("least"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert taken.where("n > 64 or least != 0 or end != n").count() == 0
    with pytest.raises(Exception, match="has no number"):
        packing.pack_documents(docs, WORDS_PATH, window=64, open_windows=4, ids=packing.Ids(3, 2, 12)).count()


def test_secrets_of_a_text_with_very_many_spans():
    rng = random.Random(0)
    words = secrets.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    hexes = ["".join(rng.choices("0123456789abcdef", k=64)) for _ in range(8000)]
    runs = ["".join(rng.choices("ghijkmnpqrstuvwxyzABCDEFGH0123456789", k=24)) for _ in range(8000)]
    text = " ".join(x for pair in zip(hexes, runs, strict=True) for x in pair)
    began = time.thread_time()
    found = secrets.find_secrets(text, words)
    assert time.thread_time() - began < 5  # it took 22 s when every run was held against every span
    assert sum(k == "hex" for k, *_ in found) == 8000 and sum(k == "random" for k, *_ in found) > 7900


def test_spans_over_spans_leave_no_random_one_inside():
    words = secrets.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(1)
    for _ in range(300):
        parts = ["password=", "token: ", "AKIA" + "".join(rng.choices("ABCZ019", k=14)), "".join(rng.choices("0123456789abcdef", k=rng.randint(28, 40))), "".join(rng.choices("qwxzGHJK0123456789/+=", k=rng.randint(10, 30))), " ", "\n"]
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        spans = secrets.find_secrets(text, words)
        base = [(s, e) for k, s, e in spans if k != "random"]
        runs = [m.span() for m in secrets._RUN.finditer(text)]
        for kind, start, end in spans:
            assert kind != "random" or (not any(s < end and start < e for s, e in base) and (start, end) in runs)
        free = [(a, b) for a, b in runs if not any(s < b and a < e for s, e in base)]
        want = [x for x in free if words.chars_per_token(text[x[0] : x[1]].rstrip("=")) <= secrets.MOST_CHARS_PER_TOKEN and not secrets.is_known(text[x[0] : x[1]].rstrip("="), words) and any(c.isalnum() for c in text[x[0] : x[1]])]
        assert [(s, e) for k, s, e in spans if k == "random"] == want


def test_every_label_of_the_query_has_pivots(spark, sf, monkeypatch):
    """With the default parameters the small tables come through the method: two cells and more in each label."""
    used = {}
    chosen = vector_join.chosen_pivots
    monkeypatch.setattr(vector_join, "chosen_pivots", lambda *a: used.update(found := chosen(*a)) or found)
    sf = sf.replace("sf0.001", "sf0.01")
    rows = queries.op5_vector_join(spark, sf).collect()
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert len(rows) == vectors.count()
    assert {k[0] for k in used} == {str(r.label) for r in vectors.select("label").distinct().collect()}
    for (label, _), p in used.items():
        assert len(p) >= 2
        x = np.array([r.embedding for r in vectors.where(F.col("label") == int(label)).collect()], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        _, cell, home = vector_join._near(x, p, 0.2)
        assert len(set(cell[home].tolist())) >= 2
