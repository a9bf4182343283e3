"""Vectors as whole numbers: shared by the operators that calculate exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGEST = 2.0**40  # a scaled component beyond it is an error: exact sums would not fit


def complete(vector: Column) -> Column:
    """Not null, and no component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine, F.lit(False))


def whole(vector: Column, scale: float, shift: int = 0) -> Column:
    """floor(scale * component) + shift of each component, taken as a double."""

    def one(x: Column) -> Column:
        scaled = x.cast("double") * F.lit(float(scale))
        large = F.raise_error(F.lit(f"a component times {scale:g} is beyond 2**40"))
        return F.when(F.abs(scaled) < LARGEST, F.floor(scaled).cast("long") + F.lit(shift).cast("long")).otherwise(large)

    return F.transform(vector, one)


def whole_vectors(rows: DataFrame, vector: str, scale: float, shift: int = 0, **keep: str) -> DataFrame:
    """The columns ``keep`` (new name: column), x and its length ``size``, for every complete vector of ``rows``."""
    named = rows.select(*[F.col(f"`{c}`").alias(new) for new, c in keep.items()], F.col(f"`{vector}`").alias("_vector"))
    fine = named.where(complete(F.col("_vector")))
    return fine.select(*keep, F.size("_vector").alias("size"), whole(F.col("_vector"), scale, shift).alias("x"))


def sizes(vectors: DataFrame) -> list[int]:
    """The lengths that occur; there is one in an ordinary table."""
    return sorted(r["size"] for r in vectors.select("size").distinct().collect())


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of an Arrow column of lists, each ``size`` long, as one matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)
