"""Connected components of an edge table, by alternating stars.

Each task first replaces the edges of every block it reads by the star
forest that spans them, which leaves few rounds for the shuffles.  A round
is two grouped minima, each joined back on the same key by a sort merge;
no group is gathered, and no edge reaches the driver.  Lineage is cut by writing the
edges of each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.llm.scratch import Scratch

#: Edges that a task holds at a time; more are taken block by block.
BLOCK_EDGES = 500_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars around the smallest node of each component of the edges."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        if (low == high).all():
            break
        np.minimum.at(parent, high, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
    below = parent != np.arange(len(nodes))
    return nodes[below], nodes[parent[below]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges with ``u > v`` that link the same nodes as ``edges``."""

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)])
            size += batch.num_rows
            if size >= BLOCK_EDGES:
                yield stars(held)
                held, size = [], 0
        if size:
            yield stars(held)

    def stars(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        u, v = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return edges.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")).where("u <> v").mapInArrow(shrink, "u bigint, v bigint")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u").toDF("u", "v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v")))


def _settled(edges: DataFrame) -> bool:
    """Whether each node is either a root or has one edge, to a root."""
    sides = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.lit(None).cast("bigint").alias("v")))
    odd = sides.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max(F.col("v").isNull()).alias("root"))
    return odd.where("low <> high or (low is not null and root)").isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, component)`` for each node of ``edges(u, v)``.

    ``component`` is the smallest node reachable.  Edge direction, repeated
    edges and self-loops don't matter; no edges give no rows.
    """
    now = scratch.keep(_contracted(edges), "edges")
    while not _settled(now):
        then = now
        now = scratch.keep(_contracted(_small_star(_large_star(now).distinct()).distinct()), "edges")
        scratch.drop(then)
    # every edge leads down, so that the root of a star is its smallest node
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots).distinct()
