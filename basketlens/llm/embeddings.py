"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by the permutation of the ``NEAREST`` pivots it is closest to, nearest first. Each
pivot has an inverted list of the vectors that have it in their permutation, by label. Pairs
are retrieved from a list by the number of pivots that they share (``SHARED`` at least) and by the mean
difference of the ranks of these pivots (``SHIFT`` at most), each pair in the list of the smallest pivot
that it shares, and are then verified by exact cosines. Long lists are cut into blocks of at most
``BLOCK`` vectors, and every pair of blocks is a piece of work. What leaves it is a count per vector
and a spanning forest, so a group of copies costs no pairs of rows. Equal vectors are one
entry with a multiplicity.

The pivots are a spread choice from a bounded sample; every vector is indexed. Their number grows with the root of
the number of vectors, so lists grow like that root too. Recall against brute force is measured in the tests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm.components import components, roots
from basketlens.llm.tables import table
from basketlens.sources.scratch import written

LEAST_PIVOTS, MOST_PIVOTS = 96, 16_384
PIVOTS_PER_ROOT = 2.0  # pivots by the root of the number of different vectors
SAMPLE = 4  # sampled vectors by pivot
SPREAD = 0.9  # pivots are less alike than this, if the sample allows
NEAREST = 8
SHARED = 2
SHIFT = 4.0
BLOCK = 1024
COSINES_AT_ONCE = 4_000_000
PAIRS_AT_ONCE = 100_000
THRESHOLD = 0.98


def usable(vector: Column) -> Column:
    """Has it a direction? No nulls, no infinite or missing numbers, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def number_of_pivots(vectors: int) -> int:
    return min(MOST_PIVOTS, max(LEAST_PIVOTS, math.ceil(PIVOTS_PER_ROOT * math.sqrt(vectors))))


def choose_pivots(vectors: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Unit pivots by dimension, from the ``SAMPLE * count`` distinct vectors with the smallest hashes."""
    rows = vectors.select("vector", "hash").orderBy("hash").limit(SAMPLE * count).collect()
    chosen: dict[int, np.ndarray] = {}
    by_size: dict[int, list] = {}
    for row in rows:
        by_size.setdefault(len(row["vector"]), []).append(row["vector"])
    for size, every in by_size.items():
        x, own, n = unit(every), np.zeros((count, size)), 0
        for v in x:
            if n < count and (own[:n] @ v < SPREAD).all():
                own[n], n = v, n + 1
        chosen[size] = own[:n]
    return chosen


def unit(vectors: list) -> np.ndarray:
    x = np.array([np.asarray(v, float) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest_pivots(x: np.ndarray, pivots: np.ndarray | None, nearest: int) -> np.ndarray:
    """The numbers of the ``nearest`` pivots of each unit vector, nearest first."""
    if pivots is None or not len(pivots):
        return np.zeros((len(x), 0), np.int32)
    nearest = min(nearest, len(pivots))
    out = np.zeros((len(x), nearest), np.int32)
    step = max(1, COSINES_AT_ONCE // len(pivots))
    for low in range(0, len(x), step):
        far = -(x[low : low + step] @ pivots.T)
        near = np.sort(np.argpartition(far, nearest - 1, axis=1)[:, :nearest], axis=1)
        order = np.argsort(np.take_along_axis(far, near, axis=1), axis=1, kind="stable")
        out[low : low + step] = np.take_along_axis(near, order, axis=1)
    return out


def permutations(spark: SparkSession, vectors: Column, pivots: dict[int, np.ndarray], nearest: int) -> Column:
    """The pivots of each vector, nearest first, and the keys of their inverted lists."""
    held = spark.sparkContext.broadcast(pivots)

    @F.pandas_udf("near array<int>, keys array<string>")
    def keyed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near: list = [None] * len(batch)
            sizes = np.array([len(v) for v in batch])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = unit([batch.iloc[i] for i in at])
                for i, row in zip(at, nearest_pivots(x, held.value.get(int(size)), nearest), strict=True):
                    near[i] = row.tolist()
            keys = [[f"{size}:{pivot}" for pivot in n] or [f"{size}:"] for size, n in zip(sizes, near, strict=True)]
            yield pd.DataFrame({"near": near, "keys": keys})

    return keyed(vectors)


def candidates(a: np.ndarray, b: np.ndarray, pivot: int | None, shared: int, shift: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the permutations ``a`` and ``b`` that share enough pivots in like ranks, ``pivot`` the smallest of these."""
    if pivot is None:  # no pivots for vectors of this length
        i, j = np.indices((len(a), len(b)))
        return i.ravel(), j.ravel()
    names = np.intersect1d(a, b)
    there = []
    for near in (a, b):
        at = np.minimum(np.searchsorted(names, near), len(names) - 1)
        row, rank = np.nonzero(names[at] == near)
        marks = np.zeros((len(near), len(names)), np.float32)
        marks[row, at[row, rank]] = 1
        there.append(marks)
    i, j = np.nonzero(there[0] @ there[1].T >= min(shared, a.shape[1]))
    kept = []
    for low in range(0, len(i), PAIRS_AT_ONCE):
        x, y = a[i[low : low + PAIRS_AT_ONCE]], b[j[low : low + PAIRS_AT_ONCE]]
        same = x[:, :, None] == y[:, None, :]
        rank = np.arange(a.shape[1])
        apart = (same * np.abs(rank[:, None] - rank[None, :])).sum(axis=(1, 2))
        first = np.where(same.any(axis=2), x, np.iinfo(x.dtype).max).min(axis=1)
        kept.append((first == pivot) & (apart <= shift * same.sum(axis=(1, 2))))
    keep = np.concatenate(kept or [np.zeros(0, bool)])
    return i[keep], j[keep]


def compare_block(frame: pd.DataFrame, low: int, high: int, threshold: float, shared: int = SHARED, shift: float = SHIFT) -> pd.DataFrame:
    """Counts and forest edges of the pairs between blocks ``low`` and ``high`` of one list."""
    none = pd.DataFrame({"node": [], "links": [], "other": []}, dtype="int64")
    left, right = (frame[frame["block"] == b] for b in (low, high))
    if not len(left) or not len(right):
        return none
    near_l, near_r = (np.array(f["near"].tolist(), np.int32).reshape(len(f), -1) for f in (left, right))
    pivot = frame["key"].iloc[0].partition(":")[2]
    i, j = candidates(near_l, near_r, int(pivot) if pivot else None, shared, shift)
    if low == high:
        i, j = i[i < j], j[i < j]
    x, y = unit(left["vector"].tolist()), unit(right["vector"].tolist())
    alike = np.zeros(len(i), bool)
    for at in range(0, len(i), PAIRS_AT_ONCE):
        part = slice(at, at + PAIRS_AT_ONCE)
        alike[part] = np.einsum("pd,pd->p", x[i[part]], y[j[part]]) >= threshold
    i, j = i[alike], j[alike]
    if not len(i):
        return none
    ids = [f["node"].to_numpy() for f in (left, right)]
    copies = [f["copies"].to_numpy() for f in (left, right)]
    counts = pd.Series(np.concatenate([copies[1][j], copies[0][i]])).groupby(np.concatenate([ids[0][i], ids[1][j]])).sum()
    nodes, root = roots(ids[0][i], ids[1][j])
    return pd.DataFrame({"node": nodes, "links": counts.reindex(nodes).to_numpy(), "other": root})


def compare_lists(batches: Iterator[pd.DataFrame], threshold: float, shared: int, shift: float) -> Iterator[pd.DataFrame]:
    """Blocks of lists, one after the other; a block pair may span Arrow batches."""
    held: list[pd.DataFrame] = []
    last = None
    group = ["label", "key", "low", "high"]
    for batch in batches:
        for name, frame in batch.groupby(group, sort=False):
            if held and name != last:
                yield compare_block(pd.concat(held), last[2], last[3], threshold, shared, shift)
                held = []
            held.append(frame)
            last = name
    if held:
        yield compare_block(pd.concat(held), last[2], last[3], threshold, shared, shift)


def near_vectors(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    threshold: float = THRESHOLD, nearest: int = NEAREST, shared: int = SHARED, shift: float = SHIFT,
    block: int = BLOCK,
) -> DataFrame:
    """A row per row of ``rows``: vec_id, n_links, component_id, kept.

    Rows link if their labels are equal and not null and their cosine is at least
    ``threshold``. Vectors that are null, empty, zero or hold null or non-finite numbers, and
    rows without an id, link with nothing; vectors of different lengths do not link. A row that repeats
    another is linked with it. Other columns are not read. An empty table gives no rows.
    """
    base = rows.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    takes_part = usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    hashes = F.when(takes_part, F.xxhash64("vector")), F.when(takes_part, F.hash("vector", F.lit(1)))
    base = base.select("*", hashes[0].alias("hash"), hashes[1].alias("hash2"))
    # Equal vectors of a label are one node. It is named by what it is, for two vectors may carry one id.
    same = base.where(F.col("hash").isNotNull()).groupBy("label", "hash", "hash2")
    nodes = same.agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    nodes = written(nodes.withColumn("node", F.xxhash64("label", "hash", "hash2")), "vector-nodes")
    pivots = choose_pivots(nodes, number_of_pivots(nodes.count()))
    listed = nodes.select("label", "node", "copies", "vector", permutations(rows.sparkSession, F.col("vector"), pivots, nearest).alias("k"))
    listed = written(listed.select("label", "node", "copies", "vector", "k.near", F.explode("k.keys").alias("key")), "vector-lists")
    # Long lists are cut into blocks, and every pair of blocks is a piece of work of its own.
    sizes = listed.groupBy("label", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = sizes.select("label", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    spread = listed.join(sizes, ["label", "key"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = spread.withColumn("partner", partner).select(
        "label", "key", "node", "copies", "vector", "near", "block",
        F.least("block", "partner").alias("low"), F.greatest("block", "partner").alias("high"),
    )
    dealt = spread.repartition("label", "key", "low", "high").sortWithinPartitions("label", "key", "low", "high")
    found = written(dealt.mapInPandas(lambda b: compare_lists(b, threshold, shared, shift), "node long, links long, other long"), "vector-links")

    reached = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("label", "hash", "hash2", "node", "least", "copies").join(links, "node", "left").join(reached, "node", "left")
    known = written(known, "vector-components")
    least = known.where("component is not null").groupBy(F.col("component").alias("of")).agg(F.min("least").alias("smallest"))
    of_node = known.join(least, F.col("component") == F.col("of"), "left").select(
        F.col("label").alias("l"), F.col("hash").alias("h"), F.col("hash2").alias("h2"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("smallest", "least").alias("component"),
    )
    joined = base.select("vec_id", "label", "hash", "hash2").join(
        of_node, (F.col("l") == F.col("label")) & (F.col("h") == F.col("hash")) & (F.col("h2") == F.col("hash2")), "left"
    )
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
