"""Connected components of links that stay distributed: alternating large-star and small-star rounds.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). A round keeps the components
and, as it replaces links by links to smaller nodes, ends in stars round the smallest node of each. Groupings
have partial sums; the joins are equi-joins that adaptive execution splits where one node has many links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.shared import checkpointed

FOLD_LINKS = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for all nodes of these links but the smallest ones themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while not (label == (label := label[label])).all():
            pass
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def out():
        u, v = forest(*map(np.concatenate, zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        n += batch.num_rows
        if n >= FOLD_LINKS:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def _sum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def components(links: DataFrame) -> DataFrame:
    """``links``: two long columns, each row one link, repeats and self-links allowed, no nulls.

    Returns (node, root) for every node that has a link to another one; root is the smallest node of its
    component, itself included. Runs one small job a round, about the logarithm of the longest chain in all. As soon
    as fewer than FOLD_LINKS links are left, one task ends it.
    """
    a, b = links.columns
    links = checkpointed(links.where(F.col(a) != F.col(b)).mapInArrow(_folded, "u long, v long").distinct())
    before = None
    while (now := _sum(links)) != before:
        if now[0] < FOLD_LINKS:
            links = checkpointed(links.repartition(1).mapInArrow(_folded, "u long, v long"))
            break
        before = now
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        links = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = links.groupBy("u").agg(F.min("v").alias("m"))
        links = links.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        links = checkpointed(links.where("u != v").distinct())
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
