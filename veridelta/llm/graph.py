"""Connected components of links that no single task or driver could hold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the links' nodes that aren't smallest themselves."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump
        if (label == before).all():
            break
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def edge_batch(u, v) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(u, dtype=np.int64)), pa.array(np.asarray(v, dtype=np.int64))], names=["u", "v"])


@lean
def _contract(batches):
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list = []
    rows = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        rows += batch.num_rows
        if rows > 2_000_000:
            u, v = forest(np.concatenate([u, *[h[0] for h in held]]), np.concatenate([v, *[h[1] for h in held]]))
            held, rows = [], 0
    if held:
        u, v = forest(np.concatenate([u, *[h[0] for h in held]]), np.concatenate([v, *[h[1] for h in held]]))
    if len(u):
        yield edge_batch(u, v)


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links(u, v) reach, for every node but the smallest ones themselves.

    Each partition's links become a forest; then large-star and small-star rounds (Kiveris and others, 2014), whose
    minima are combined before the shuffle, until the stars no longer change. Links with a null end and loops are
    ignored; no links give no rows."""
    edges = links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    edges = stored(edges.mapInArrow(_contract, "u long, v long"), "links")
    seen = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        own = low.select("u", F.col("m").alias("v"))
        edges = stored(small.unionByName(own).distinct(), "links")
