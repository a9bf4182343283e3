"""Product codes of vectors; the nearest codebook entry is found by slicing and intersecting bitmasks.

A vector of whole numbers is cut into ``PARTS`` parts, and each part is replaced by the number of
the nearest of at most 64 entries of its position's codebook. For each dimension the entries'
coordinates are sorted, and each place in that order carries a mask of the entries before it. The
entries within a radius of a coordinate are then two binary searches and one exclusive or, and those
within it in every dimension are the AND of these uint64 masks. A first radius is doubled until
something is inside; the distance of the best entry found is the radius of a second
intersection, which holds every entry that is as near. So the answer is exact, ties included.

Codebooks are refined by passes over all vectors. A task adds up its vectors by (part, entry) and
sends sums only; what the driver holds is the codebooks, whose size does not depend on the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm.tables import table
from basketlens.llm.vectors import matrix, sizes, whole_vectors
from basketlens.operators.lookups import attach, held
from basketlens.sources.scratch import written

PARTS = 16
ENTRIES = 64  # as many as a mask has bits
ROUNDS = 2
SCALE = 256
CHUNK = 4096  # vectors compared at once


@dataclass(frozen=True)
class Slices:
    """A codebook by dimension: sorted coordinates, and before each place the mask of the entries passed."""

    entries: np.ndarray
    coordinates: np.ndarray
    masks: np.ndarray
    radius: int

    @classmethod
    def of(cls, entries: np.ndarray) -> Slices:
        order = np.argsort(entries, axis=0, kind="stable")
        bits = np.uint64(1) << order.astype(np.uint64)
        masks = np.zeros((len(entries) + 1, entries.shape[1]), np.uint64)
        masks[1:] = np.bitwise_or.accumulate(bits, axis=0)
        # A start that holds a few entries: half the median distance to the nearest other entry.
        gaps = squares(entries[:, None, :] - entries[None, :, :])
        np.fill_diagonal(gaps, np.iinfo(np.int64).max)
        start = isqrt(int(np.median(gaps.min(axis=1)))) // 2 if len(entries) > 1 else 0
        return cls(entries, np.take_along_axis(entries, order, axis=0), masks, max(1, start))

    def within(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Mask of the entries that differ by ``radius`` at most in every dimension."""
        found = np.full(len(x), self.masks[-1, 0] if len(self.masks) and x.shape[1] else all_of(len(self.entries)))
        for j in range(x.shape[1]):
            low = np.searchsorted(self.coordinates[:, j], x[:, j] - radius, side="left")
            high = np.searchsorted(self.coordinates[:, j], x[:, j] + radius, side="right")
            found &= self.masks[high, j] ^ self.masks[low, j]
        return found

    def best(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry in ``mask``, the lowest of equals, and its squared distance; -1 and the largest long without one."""
        entry, distance = np.full(len(x), -1), np.full(len(x), np.iinfo(np.int64).max)
        left, rows = mask.copy(), np.flatnonzero(mask)
        while len(rows):
            lowest = left[rows] & (~left[rows] + np.uint64(1))
            i = np.bitwise_count(lowest - np.uint64(1)).astype(np.int64)
            far = squares(x[rows] - self.entries[i])
            nearer = far < distance[rows]
            entry[rows[nearer]], distance[rows[nearer]] = i[nearer], far[nearer]
            left[rows] ^= lowest
            rows = rows[left[rows] != 0]
        return entry, distance

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each row's nearest entry."""
        radius = np.full(len(x), self.radius)
        mask = self.within(x, radius)
        empty = np.flatnonzero(mask == 0)
        while len(empty):
            radius[empty] *= 2
            mask[empty] = self.within(x[empty], radius[empty])
            empty = empty[mask[empty] == 0]
        entry, distance = self.best(x, mask)
        # The box holds a ball of its radius; an entry found beyond that ball may have nearer ones outside the box.
        reach = np.ceil(np.sqrt(distance.astype(float))).astype(np.int64)
        again = np.flatnonzero(reach > radius)
        if len(again):
            entry[again], distance[again] = self.best(x[again], self.within(x[again], reach[again]))
        return entry, distance


def all_of(count: int) -> np.uint64:
    return np.uint64((1 << count) - 1)


def squares(difference: np.ndarray) -> np.ndarray:
    return (difference * difference).sum(axis=-1)


def by_part(x: np.ndarray) -> np.ndarray:
    """(vector, part, place in it); zeros fill up a length that ``PARTS`` doesn't divide."""
    width = -(-x.shape[1] // PARTS)
    if (limit := int(np.abs(x).max(initial=0))) and (2 * limit) ** 2 * x.shape[1] >= 2**63:
        raise ValueError(f"squared distances of components up to {limit} do not fit a long")
    return np.pad(x, ((0, 0), (0, width * PARTS - x.shape[1]))).reshape(len(x), PARTS, width)


def assigned(x: np.ndarray, books: list[Slices]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (vector, part) and the squared distances summed over parts."""
    parts = by_part(x)
    codes, error = np.zeros((len(x), PARTS), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), CHUNK):
        rows = slice(at, at + CHUNK)
        for p, book in enumerate(books):
            codes[rows, p], distance = book.nearest(parts[rows, p])
            error[rows] += distance
    return codes, error


def first_books(vectors: DataFrame, size: int) -> np.ndarray:
    """(part, entry, place) of the vectors with the smallest ids; nulls last, equal ids by their vectors."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(ENTRIES).collect()
    return by_part(np.array([r["x"] for r in rows], np.int64).reshape(len(rows), size)).transpose(1, 0, 2)


def refined(vectors: DataFrame, books: np.ndarray, size: int) -> np.ndarray:
    """Every entry replaced by the floor of the mean of the parts assigned to it; unused ones stay."""
    parts, count, width = books.shape
    slices = [Slices.of(b) for b in books]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0), size)
            codes, _ = assigned(x, slices)
            cells = codes + np.arange(parts) * count
            # One row per entry and place; the place after the last one counts.
            total = np.zeros((parts * count, width + 1), np.int64)
            np.add.at(total, cells, np.concatenate([by_part(x), np.ones((len(x), parts, 1), np.int64)], axis=2))
            used = np.flatnonzero(total[:, width])
            cell = (used[:, None] * (width + 1) + np.arange(width + 1)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[used].ravel())], ["cell", "total"])

    added = vectors.select("x").mapInArrow(sums, "cell long, total long").groupBy("cell")
    rows = added.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # entries times places at most
    total = {r["cell"]: int(r["total"]) for r in rows}
    new = books.copy()
    for at in range(parts * count):
        if n := total.get(at * (width + 1) + width, 0):
            new[divmod(at, count)] = [total[at * (width + 1) + j] // n for j in range(width)]
    return new


def train(vectors: DataFrame, size: int, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, place) of the ``vectors`` (vec_id, size, x) of one length."""
    books = first_books(vectors, size)
    for _ in range(rounds):
        books = refined(vectors, books, size)
    return books


def coded(vectors: DataFrame, books: np.ndarray, size: int) -> DataFrame:
    """vec_id, label, code and error of each vector."""
    slices = [Slices.of(b) for b in books]
    digits = np.array([f"{i:02x}" for i in range(ENTRIES)])
    chosen = vectors.select("vec_id", "label", "x")

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, error = assigned(matrix(batch.column(2), size), slices)
            texts = ["".join(row) for row in digits[numbers]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in chosen.schema.fields}
    return chosen.mapInArrow(codes, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of the entries' components by part, entry and place."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()


def compress(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", *, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every complete vector of ``rows``.

    Vectors that are null or hold null or non-finite components are left out. Null ids and null labels
    are values like any other (the ids sort last); rows that repeat another are rows of their own. With
    fewer than 64 vectors the codebooks are that much shorter. A length that 16 doesn't divide is filled up
    with zeros; vectors of different lengths have codebooks of their own, and the digest
    covers them in order of length. Components whose squared distances do not fit a long are an error.
    Other columns are not read. An empty table gives no rows.
    """
    vectors = written(whole_vectors(rows, vector, SCALE, vec_id=vec_id, label=label), "whole-vectors")
    books = {size: train(vectors.where(F.col("size") == size), size, rounds) for size in sizes(vectors)}
    done = vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0)
    for size, own in books.items():
        done = done.unionByName(coded(vectors.where(F.col("size") == size), own, size))
    done = written(done, "vector-codes")
    errors = done.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_rows"))
    joined = attach(done, held(errors, ["label"]), ["label"], ["label_error"], "_rows")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(list(books.values()))).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))
