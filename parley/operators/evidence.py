"""Which of many phrases a text contains, by automata of bounded size instead of a comparison of all with all."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_CHARS = 4_000_000  # of the phrases of one automaton


def _found(phrases: list[tuple], schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        automaton, ids = ahocorasick.Automaton(), {}
        for phrase, item in phrases:
            ids.setdefault(phrase, []).append(item)
        for phrase, own in ids.items():
            automaton.add_word(phrase, own)
        automaton.make_automaton()
        for batch in batches:
            rows: tuple[list, list] = ([], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {id(x): x for _, x in automaton.iter(text)} if text else {}
                for item in (i for x in own.values() for i in x):
                    rows[0].append(doc)
                    rows[1].append(item)
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kind.types, strict=True)], schema=kind)

    return run


def contained(texts: DataFrame, phrases: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """(text's id, phrase's id) of every phrase that is part of a text; both tables are (id, text).

    The phrases become Aho-Corasick automata of ``most_chars`` characters at most (or one longer phrase); each reads all
    texts once, where they lie: time grows with the texts and the matches, and with the number of automata, not with
    phrases times texts. Nothing is shuffled but the phrases. Null texts contain nothing, null and empty phrases are in
    nothing; rows that repeat an id count each.
    """
    spark = texts.sparkSession
    (a, text), (b, phrase) = texts.columns, phrases.columns
    schema = T.StructType([T.StructField(a, texts.schema[a].dataType), T.StructField(b, phrases.schema[b].dataType)])
    known = phrases.where(F.coalesce(F.col(phrase), F.lit("")) != "")
    total = known.agg(F.sum(F.length(phrase)).alias("n")).first().n or 0
    parts = -(-total // most_chars)
    out = spark.createDataFrame([], schema)
    for k in range(parts):
        own = known.where(F.pmod(F.xxhash64(phrase), F.lit(parts)) == k).select(phrase, b)
        found = texts.select(a, text).mapInArrow(_found([tuple(r) for r in own.collect()], schema), schema)  # about most_chars characters
        out = found if k == 0 else out.unionByName(found)
    return out
