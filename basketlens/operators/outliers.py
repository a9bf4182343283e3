"""Exact interquartile fences and what lies outside them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.contracts import IQR_THRESHOLD
from basketlens.operators.cells import TASK_VALUES, Cells, Profile, Range, profile, settled


@dataclass(frozen=True)
class Fences:
    """Quartiles and fences of one column. As literals they are pushed into the scan."""

    q1: float
    median: float
    q3: float
    threshold: float

    @property
    def lower(self) -> float:
        return self.q1 - self.threshold * (self.q3 - self.q1)

    @property
    def upper(self) -> float:
        return self.q3 + self.threshold * (self.q3 - self.q1)

    def inside(self, column: str) -> Column:
        return F.col(column).between(F.lit(self.lower), F.lit(self.upper))

    def outside(self, column: str) -> Column:
        return (F.col(column) < F.lit(self.lower)) | (F.col(column) > F.lit(self.upper))


QUARTILES = (0.25, 0.5, 0.75)


def fences_of(cells: Cells, threshold: float, *population: Range) -> tuple[list[Range], Range, Range]:
    """Quartiles and both fences as far as the cells know them; ``population`` as for ``Cells.quantile``."""
    q = [cells.quantile(p, *population) for p in QUARTILES]
    if all(x.settled for x in q):
        f = Fences(*(float(x.low) for x in q), threshold)
        return q, Range(f.lower, f.lower), Range(f.upper, f.upper)
    spread = q[2].plus(q[0], -1)
    return q, q[0].plus(spread, -threshold), q[2].plus(spread, threshold)


def _known(df: DataFrame, column: str) -> Profile:
    seen = profile(df, column)
    if not seen.n:
        raise ValueError(f"{column} has no values")
    return seen


def fences(
    df: DataFrame,
    column: str,
    threshold: float = IQR_THRESHOLD,
    *,
    task_values: int = TASK_VALUES,
) -> Fences:
    """Exact quartiles and fences; only counters come back. Missing values are ignored."""
    (q, _, _), _ = settled(_known(df, column).cells, df, column, lambda cells: fences_of(cells, threshold), task_values)
    return Fences(*(float(x.low) for x in q), threshold)


def iqr_statistics(
    df: DataFrame,
    column: str = "unit_price",
    threshold: float = IQR_THRESHOLD,
    *,
    task_values: int = TASK_VALUES,
) -> DataFrame:
    """One row: column, threshold, q1, q3, both fences and the number of values beyond them.

    The rows beyond the fences are counted in the cells as well, so the quartiles and they share their passes.
    """

    def ask(cells: Cells) -> tuple[list[Range], Range, Range]:
        q, lower, upper = fences_of(cells, threshold)
        return q, cells.below(lower), cells.above(upper)

    (q, below, above), _ = settled(_known(df, column).cells, df, column, ask, task_values)
    f = Fences(*(float(x.low) for x in q), threshold)
    row = (column, float(threshold), f.q1, f.q3, f.lower, f.upper, int(below.low + above.low))
    kinds = "column string, threshold double, q1 double, q3 double, lower_fence double, upper_fence double, outlier_count long"
    return df.sparkSession.createDataFrame([row], kinds)


def inliers(df: DataFrame, column: str, f: Fences) -> DataFrame:
    """Rows on or within the fences."""
    return df.where(f.inside(column))


def distinct_outliers(df: DataFrame, column: str, f: Fences) -> DataFrame:
    """Different values beyond the fences, sorted."""
    return df.where(f.outside(column)).select(column).distinct().orderBy(column)
