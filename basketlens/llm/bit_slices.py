"""Exact top-k by inner product over bit-sliced blocks of vectors.

Vectors are whole numbers. A block of about ``BLOCK`` of them is one row of the index: of each dimension, quantised
to ``SLICES`` bits, the bitmap of every bit over the block's rows, and the components themselves. A query adds up
the slices, each shifted by the signed binary digits of its own components, with carry-save adders on whole bitmaps
(a subtraction adds the complement). From the sum's most significant slice downward the bitmaps are split
until the k-th largest sum is known. What quantising left out can move a score by a known amount at most,
so the rows whose sum is that near to the k-th or above are the boundary; they are scored exactly from their components.

Blocks meet chunks of about ``CHUNK`` queries in units of their own, and send k rows per query. So no task
holds more than one block and one chunk, and no pair of rows is ever written.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketlens.llm.tables import parts_for, table
from basketlens.llm.vectors import matrix, sizes, whole_vectors
from basketlens.sources.scratch import written

SCALE = 256
TOP = 5
EVERY = 50
BLOCK = 16_384
CHUNK = 1_024
SLICES = 6
INDEX = "block int, rows int, size int, shift int, ids array<long>, copies array<long>, kind string, components binary, slices binary"
FOUND = "query_id long, query_hash long, query_hash2 int, repeats long, vec_id long, score long, copies long"


@dataclass(frozen=True)
class Block:
    """Rows of one block: their ids, copies and components, and the slices of the quantised components.

    ``planes`` is (sign, dimension, bit, word): bitmaps of ``(x - least) >> shift`` and their complements.
    """

    ids: np.ma.MaskedArray
    copies: np.ndarray
    x: np.ndarray
    shift: int
    planes: np.ndarray
    every: np.ndarray

    @classmethod
    def of(cls, ids: np.ma.MaskedArray, copies: np.ndarray, x: np.ndarray, shift: int, plain: np.ndarray) -> Block:
        every = packed(np.ones(len(x), np.uint8))
        return cls(ids, copies, x, shift, np.stack([plain, plain ^ every]), every)


def quantised(x: np.ndarray, slices: int = SLICES) -> tuple[int, np.ndarray]:
    """(shift, bitmaps by dimension and bit) of the rows of a block."""
    lifted = x - x.min(axis=0)
    shift = max(0, int(lifted.max(initial=0)).bit_length() - slices)
    bits = ((lifted >> shift).T[:, None, :] >> np.arange(slices)[:, None]) & 1
    return shift, packed(bits.astype(np.uint8))


def packed(bits: np.ndarray) -> np.ndarray:
    """Bits of the last axis as words of 64, the last word filled up with zeros."""
    wide = np.pad(bits, [(0, 0)] * (bits.ndim - 1) + [(0, -bits.shape[-1] % 64)])
    return np.packbits(wide, axis=-1, bitorder="little").view(np.uint64)


def members(bitmap: np.ndarray) -> np.ndarray:
    """Row numbers of the bits that are set."""
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def digits(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signed binary digits of whole numbers, of which no two neighbours are set: (place, power, is it negative)."""
    left, found = values.astype(np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
    for power in range(64):
        odd = np.flatnonzero(left & 1)
        digit = 2 - (left[odd] & 3)  # 1 or -1, and the next digit is zero
        found.append((odd, np.full(len(odd), power), digit < 0))
        left[odd] -= digit
        left >>= 1
        if not left.any():
            break
    place, power, negative = (np.concatenate(part) for part in zip(*found, strict=True))
    return place, power, negative


def added(planes: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Sum of bitmaps by power of two: one bitmap of each power is left, its carries added to the next."""
    waiting, total, power = dict(planes), {}, min(planes, default=0)
    while waiting:
        if power in waiting:
            own, carries = waiting.pop(power), []
            while len(own) > 1:
                third = max(1, len(own) // 3)
                a, b, c = own[:third], own[third : 2 * third], own[2 * third : 3 * third]
                if len(c):
                    half = a ^ b
                    carries.append((a & b) | (half & c))
                    own = np.concatenate([half ^ c, own[3 * third :]])
                else:  # two bitmaps
                    carries.append(a & b)
                    own = a ^ b
            total[power] = own[0]
            if carries:
                above = [waiting[power + 1]] if power + 1 in waiting else []
                waiting[power + 1] = np.concatenate([*above, *carries])
        power += 1
    return total


def sum_slices(block: Block, query: np.ndarray) -> list[np.ndarray]:
    """Slices, least first, of the inner product with the quantised rows, but for a constant."""
    place, power, negative = digits(query)
    bits, words = block.planes.shape[2:]
    taken = block.planes[negative.astype(np.int64), place].reshape(len(place) * bits, words)
    weight = (power[:, None] + np.arange(bits)).ravel()
    found = added({int(w): taken[weight == w] for w in np.unique(weight)})
    nothing = np.zeros_like(block.every)
    return [found.get(w, nothing) for w in range(max(found, default=-1) + 1)]


def kth_largest(slices: list[np.ndarray], among: np.ndarray, k: int) -> int | None:
    """Value of the k-th largest sum of the rows ``among``; None if they are fewer."""
    if count(among) < k:
        return None
    value, level, wanted = 0, among, k
    for bit in reversed(range(len(slices))):
        upper = level & slices[bit]
        above = count(upper)
        if above >= wanted:
            level, value = upper, value | 1 << bit
        else:
            level, wanted = level & ~slices[bit], wanted - above
    return value


def at_least(slices: list[np.ndarray], among: np.ndarray, value: int) -> np.ndarray:
    """Rows ``among`` whose sum is ``value`` or more."""
    if value <= 0:
        return among
    more, same = np.zeros_like(among), among
    for bit in reversed(range(len(slices))):
        if value >> bit & 1:
            same = same & slices[bit]
        else:
            more = more | (same & slices[bit])
            same = same & ~slices[bit]
    return more | same


def boundary(block: Block, query: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the rows ``among`` that quantising leaves open as one of the k best."""
    slices = sum_slices(block, query)
    last = kth_largest(slices, among, k)
    if last is None:
        return members(among)
    # The bits cut off are worth less than this, in units of the sum.
    cut = int(np.abs(query).sum()) * ((1 << block.shift) - 1) >> block.shift
    return members(at_least(slices, among, last - cut))


def best_of_block(block: Block, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers, scores, copies) of the k best rows of the block, one copy of the query itself left out."""
    among, copies, unnamed = block.every, block.copies, np.ma.getmaskarray(block.ids)
    own = np.flatnonzero((block.ids.data == query_id) & ~unnamed)
    own = own[(block.x[own] == query).all(axis=1)]
    if len(own):
        copies = copies.copy()
        copies[own] -= 1
        among = packed((copies > 0).astype(np.uint8))
    rows = boundary(block, query, among, k)
    scores = block.x[rows].astype(np.int64) @ query
    order = np.lexsort((block.ids.data[rows], unnamed[rows], -scores))[:k]
    return rows[order], scores[order], np.minimum(copies[rows[order]], k)


def checked(x: np.ndarray) -> np.ndarray:
    limit = int(np.abs(x).max(initial=0))
    if limit * limit * x.shape[1] >= 2**62:
        raise ValueError(f"inner products of components up to {limit} do not fit a long")
    return x


def longs(column: pa.ChunkedArray) -> np.ma.MaskedArray:
    nulls = column.is_null().to_numpy()
    return np.ma.masked_array(column.fill_null(0).to_numpy(), nulls)


def index(vectors: DataFrame, size: int, block: int = BLOCK) -> DataFrame:
    """The blocks of distinct ``vectors`` (vec_id, x, copies) of one length, a row each."""
    blocks = parts_for(vectors.count(), block)

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        x = checked(matrix(rows["x"].combine_chunks(), size))
        shift, plain = quantised(x)
        kind = np.min_scalar_type(-1 - int(np.abs(x).max(initial=0)))
        one = {
            "block": pa.array([key[0].as_py()], pa.int32()),
            "rows": pa.array([len(x)], pa.int32()),
            "size": pa.array([size], pa.int32()),
            "shift": pa.array([shift], pa.int32()),
            "ids": pa.array([rows["vec_id"].to_pylist()], pa.list_(pa.int64())),
            "copies": pa.array([rows["copies"].to_numpy()], pa.list_(pa.int64())),
            "kind": pa.array([kind.str]),
            "components": pa.array([x.astype(kind).tobytes()], pa.binary()),
            "slices": pa.array([plain.tobytes()], pa.binary()),
        }
        return pa.table(one)

    dealt = vectors.select(place("vec_id", "x", blocks).alias("block"), "vec_id", "copies", "x")
    return written(dealt.groupBy("block").applyInArrow(build, INDEX), "bit-sliced-index")


def place(vec_id: str, x: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(vec_id, x), F.lit(parts)).cast("int")


def opened(row: pa.Table) -> Block:
    """The block of an index row."""
    r = {name: row[name][0] for name in row.column_names}
    n, size = r["rows"].as_py(), r["size"].as_py()
    x = np.frombuffer(r["components"].as_py(), r["kind"].as_py()).reshape(n, size)
    plain = np.frombuffer(r["slices"].as_py(), np.uint64).reshape(size, SLICES, -(-n // 64))
    return Block.of(longs(pa.chunked_array([r["ids"].values])), r["copies"].values.to_numpy(), x, r["shift"].as_py(), plain)


def search(blocks: DataFrame, queries: DataFrame, size: int, k: int = TOP, chunk: int = CHUNK) -> DataFrame:
    """The k best rows of every block of the index for every row of ``queries`` (vec_id, x, copies)."""
    # Blocks are numbered by a hash, so a number may be without rows.
    chunks, last = parts_for(queries.count(), chunk), blocks.agg(F.max("block")).first()[0]

    def unit(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 4]
        if left.num_rows and right.num_rows:
            block, x, ids = opened(left), checked(matrix(right["x"].combine_chunks(), size)), right["query_id"].to_numpy()
            for i, query in enumerate(x):
                rows, scores, copies = best_of_block(block, ids[i], query, k)
                found.append([np.full(len(rows), i), rows, scores, copies])
        query, rows, scores, copies = (np.concatenate(part) for part in zip(*found, strict=True))
        asked = right.select(["query_id", "query_hash", "query_hash2", "repeats"]).take(pa.array(query))
        named = left["ids"].combine_chunks().values.take(pa.array(rows)) if left.num_rows else pa.array([], pa.int64())
        for name, values in (("vec_id", named), ("score", pa.array(scores)), ("copies", pa.array(copies))):
            asked = asked.append_column(name, values)
        return asked

    asked = queries.select(
        place("vec_id", "x", chunks).alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(last))).alias("block"),
        F.col("vec_id").alias("query_id"), F.xxhash64("x").alias("query_hash"), F.hash("x", F.lit(1)).alias("query_hash2"),
        F.col("copies").alias("repeats"), "x",
    )
    held = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return held.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInArrow(unit, FOUND)


def best(found: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of all blocks; equal rows take a place each, and repeated queries too."""
    rows = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    query = Window.partitionBy("query_id", "query_hash", "query_hash2").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = rows.withColumn("rank", F.row_number().over(query)).where(F.col("rank") <= k)
    again = ranked.withColumn("repeat", F.explode(F.sequence(F.lit(1).cast("long"), "repeats")))
    return again.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_products(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", *, every: int = EVERY, k: int = TOP, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest inner products of each row whose id is divisible by ``every``.

    Components become floor(256 * x). All other rows are candidates, ties go to the smaller id, null ids come last and
    are no queries. Vectors that are null or hold null or non-finite components take no part; vectors of
    different lengths have no product. A row that repeats the query's id and vector is a row of its own: a candidate, and a
    query with results of its own. A query without candidates has no rows; with fewer than ``k`` it has all. Products
    that do not fit a long are an error. Other columns are not read. An empty table gives no rows.
    """
    whole = whole_vectors(rows, vector, SCALE, vec_id=vec_id).withColumn("vec_id", F.col("vec_id").cast("long"))
    vectors = written(whole.groupBy("vec_id", "size", "x").agg(F.count(F.lit(1)).alias("copies")), "whole-vectors")
    found = None
    for size in sizes(vectors):
        own = vectors.where(F.col("size") == size)
        queries = own.where(F.pmod("vec_id", F.lit(every)) == 0)
        if queries.isEmpty():
            continue
        part = search(index(own, size, block), queries, size, k, chunk)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], FOUND)
    return best(written(found, "block-results"), k)


def op13_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))
