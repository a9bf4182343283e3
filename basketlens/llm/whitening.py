"""Whitening of vectors by shifted CholeskyQR.

The fit list A holds each distinct vector once, centred. A pass adds up the Gram matrix of its
rows, task by task, and the driver takes the Cholesky factor of that small matrix; the next pass
turns rows into rows times the inverse of the factors so far, by triangular solves, and adds up again. The
first factor is shifted, so that it exists however ill-conditioned A is. Passes repeat until the rows are
orthonormal; the product R of the factors then satisfies A = QR, and the singular values and right
singular vectors of R, a matrix of the vectors' length, are those of A.

Only Gram matrices, sums and factors reach the driver; their size is that of the vectors' length squared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm.tables import table
from basketlens.llm.vectors import matrix, sizes, whole_vectors
from basketlens.sources.scratch import written

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
MAX_PASSES = 6
ORTHONORMAL = 1e-10
UNIT = 2.0**-53


@dataclass(frozen=True)
class Centre:
    """Exact mean S/n of whole vectors, as a whole part and a rest of less than n."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        return cls(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n*x - S) squared; None where it does not fit a long."""
        apart = x - self.whole
        about = ((apart.astype(float) * self.n - self.rest) ** 2).sum(axis=1)
        fits = about < 2.0**61
        small = np.where(fits[:, None], apart, 0) * self.n - self.rest
        exact: list[int | None] = (small * small).sum(axis=1).tolist() if fits.any() else [None] * len(x)
        for i in np.flatnonzero(~fits):
            value = sum((int(a) * self.n - int(r)) ** 2 for a, r in zip(apart[i], self.rest, strict=True))
            exact[i] = value if value < 2**63 else None
        return exact


@dataclass(frozen=True)
class Whitening:
    """Model of one vector length: unit ``components`` by falling ``eigenvalues`` of the covariance."""

    centre: Centre
    components: np.ndarray
    eigenvalues: np.ndarray
    total: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Rows projected on the components and divided by their spread; NaN along one without any."""
        spread = np.sqrt(self.eigenvalues)
        return self.centre.centred(x) @ self.components.T / np.where(spread > 0, spread, np.nan)


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """X with X R = rows, R upper triangular: forward substitution, all rows side by side."""
    out = np.empty_like(rows)
    for j in range(factor.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def totals(vectors: DataFrame, size: int) -> Centre:
    """Number and exact sums of the vectors."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0), size)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(np.append(x.sum(axis=0), len(x)))], ["cell", "total"])

    added = vectors.select("x").mapInArrow(sums, "cell long, total long").groupBy("cell")
    rows = added.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    found = {r["cell"]: int(r["total"]) for r in rows}
    return Centre.of(found[size], [found[j] for j in range(size)])


def gram(vectors: DataFrame, size: int, width: int, rows_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all vectors of the outer products of their rows; a task sends one upper triangle."""
    upper = np.triu_indices(width)

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((width, width))
        for batch in batches:
            rows = rows_of(matrix(batch.column(0), size))
            own += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]))), pa.array(own[upper])], ["cell", "total"])

    added = vectors.select("x").mapInArrow(outer, "cell long, total double").groupBy("cell").agg(F.sum("total").alias("total"))
    out = np.zeros((width, width))
    for r in added.collect():
        out[upper[0][r["cell"]], upper[1][r["cell"]]] = r["total"]
    return out + np.triu(out, 1).T


def factor_of(product: np.ndarray, rows: int, *, shifted: bool) -> np.ndarray:
    """Upper Cholesky factor of a Gram matrix; shifted if asked, or if there is none without."""
    width = len(product)
    if not shifted:
        try:
            return np.linalg.cholesky(product).T
        except np.linalg.LinAlgError:  # directions without any spread
            pass
    shift = 11 * (rows * width + width * (width + 1)) * UNIT * np.trace(product)
    return np.linalg.cholesky(product + shift * np.eye(width)).T


def triangular_factor(vectors: DataFrame, size: int, centre: Centre) -> np.ndarray:
    """R of the centred rows."""
    factors: list[np.ndarray] = []

    def orthogonal(x: np.ndarray) -> np.ndarray:
        rows = centre.centred(x)
        for factor in factors:
            rows = solved(rows, factor)
        return rows

    whole_factor = np.eye(size)
    for number in range(MAX_PASSES):
        product = gram(vectors, size, size, orthogonal)
        if not product.any():
            return np.zeros((size, size))
        factor = factor_of(product, centre.n, shifted=number == 0)
        factors.append(factor)
        whole_factor = factor @ whole_factor
        # Orthonormal rows have the identity as Gram matrix, or a projector where directions have no spread.
        if np.abs(product @ product - product).max() <= ORTHONORMAL:
            break
    return whole_factor


def fit(vectors: DataFrame, size: int, count: int = COMPONENTS) -> Whitening:
    """Model of the distinct ``vectors`` (x) of one length."""
    centre = totals(vectors, size)
    _, singular, right = np.linalg.svd(triangular_factor(vectors, size, centre))
    eigenvalues = singular**2 / centre.n
    # What rounding leaves of directions without spread is none.
    eigenvalues = np.where(eigenvalues > size * 1e-14 * eigenvalues.max(initial=0.0), eigenvalues, 0.0)
    signs = np.sign(right[np.arange(size), np.abs(right).argmax(axis=1)])
    return Whitening(centre, (right * signs[:, None])[:count], eigenvalues[:count], float(eigenvalues.sum()))


def identity_error(vectors: DataFrame, size: int, model: Whitening) -> float | None:
    """Largest distance of the whitened covariance from the identity, over components with spread."""
    real = np.flatnonzero(model.eigenvalues > 0)
    if not len(real):
        return None
    covariance = gram(vectors, size, len(real), lambda x: model.apply(x)[:, real]) / model.centre.n
    return float(np.abs(covariance - np.eye(len(real))).max())


def whitened(vectors: DataFrame, size: int, model: Whitening, error: float | None) -> DataFrame:
    """Each row of ``vectors`` (vec_id, x), once per component."""
    count = len(model.components)
    share = model.eigenvalues / model.total if model.total > 0 else np.full(count, np.nan)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), size)
            values = model.apply(x).ravel()
            again = np.repeat(np.arange(len(x)), count)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(again)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    pa.array(model.centre.deviations(x), pa.int64()).take(pa.array(again)),
                    pa.array(values, mask=np.isnan(values)),
                    pa.array(np.tile(share, len(x)), mask=np.isnan(np.tile(share, len(x)))),
                ],
                ["vec_id", "component", "deviation", "whitened", "explained"],
            )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    out = vectors.select("vec_id", "x").mapInArrow(rows, f"vec_id {kind}, component int, deviation long, whitened double, explained double")
    return out.select(
        "vec_id", "component", F.lit(model.centre.n).cast("long").alias("n"), "deviation", "whitened", "explained",
        F.lit(error).cast("double").alias("identity_error"),
    )


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", *, count: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every complete vector and component.

    Vectors that are null or hold null or non-finite components are left out; rows that repeat another
    are returned each, but count once in the fit, and so do null ids, which are kept. Vectors shorter than ``count`` have fewer
    components. Along a component without spread (constant or dependent dimensions, or a single vector) ``whitened`` is null
    and ``explained`` 0, and it does not count in identity_error; without any spread explained and identity_error are null.
    A deviation that does not fit a long is null. Vectors of different lengths are fitted apart;
    an empty vector has no components. Other columns are not read. An empty table gives no rows.
    """
    vectors = written(whole_vectors(rows, vector, SCALE, SHIFT, vec_id=vec_id), "whole-vectors")
    done = None
    for size in sizes(vectors):
        own = vectors.where(F.col("size") == size)
        if not size:
            continue
        # Each distinct vector once; copies fall out before the shuffle.
        distinct = written(own.select("x").distinct(), "fit-list")
        model = fit(distinct, size, count)
        part = whitened(own, size, model, identity_error(distinct, size, model))
        done = part if done is None else done.unionByName(part)
    if done is None:
        nothing = F.lit(0.0)
        done = vectors.limit(0).select(
            "vec_id", F.lit(1).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
            nothing.alias("whitened"), nothing.alias("explained"), nothing.alias("identity_error"),
        )
    return done


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
