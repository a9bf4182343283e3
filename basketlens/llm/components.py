"""Connected components of an edge table that never leaves the executors.

Alternating large-star and small-star steps: every node's neighbours are pointed to the smallest
one, until each node points to the smallest node it can reach. Each step is an aggregation with
map-side minima and one join; a node with very many neighbours is the skewed side of
that join, which adaptive execution splits. Rounds are written tables, so lineage stays short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from basketlens.sources.scratch import written, written_with_facts

MAX_ROUNDS = 60


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that occur in the edges and the smallest node each can reach by them; in memory."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def contracted(edges: DataFrame) -> DataFrame:
    """The same components from fewer edges: each batch is replaced by stars around its smallest nodes."""

    def stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes, root = roots(batch["a"].to_numpy(), batch["b"].to_numpy())
            away = nodes != root
            yield pd.DataFrame({"a": nodes[away], "b": root[away]})

    return edges.select("a", "b").mapInPandas(stars, "a long, b long")


def _state(edges: DataFrame) -> tuple[DataFrame, Row]:
    table, facts = written_with_facts(
        edges, "component-edges", F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")
    )
    return table, (facts["n"], facts["sum"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long): the smallest node reachable.

    Loops and rows with a null are left out; repeated edges count once; no edges, no rows.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b")
    current, state = _state(contracted(edges).distinct())
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        # Large star: all larger neighbours of a node point to its smallest neighbour.
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = written(large.where("a != b").distinct(), "component-large")
        # Small star: a node and its smaller neighbours point to the smallest of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = small.unionByName(low.select("a", F.col("low").alias("b"))).where("a != b").distinct()
        last = state
        current, state = _state(small)
        if state == last:
            break
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    points = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return points.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
