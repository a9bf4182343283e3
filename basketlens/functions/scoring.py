"""RFM scores and segments as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cut:
    """Largest value of a score: everything below it belongs, ``inclusive`` says if it does itself."""

    value: float
    inclusive: bool

    def holds(self, c: Column) -> Column:
        limit = F.lit(self.value)
        return c <= limit if self.inclusive else c < limit


def quarter_score(c: Column, cuts: Sequence[Cut | None]) -> Column:
    """1 to 4 by the three cuts, null for null; a cut that no value satisfies is None."""
    score = None
    for points, cut in enumerate(cuts, start=1):
        if cut is not None:
            held = cut.holds(c)
            score = F.when(held, points) if score is None else score.when(held, points)
    last = F.when(c.isNotNull(), 4)
    return (last if score is None else score.otherwise(last)).cast("int")


def segment(r: Column | str, f: Column | str, m: Column | str) -> Column:
    """Ordered rules, first match wins."""
    r, f, m = (F.col(c) if isinstance(c, str) else c for c in (r, f, m))
    return (
        F.when((r == 4) & (f == 4) & (m == 4), "VIP")
        .when((r >= 3) & (f >= 3), "Loyal")
        .when((r == 4) & (f <= 2), "New")
        .when(r == 1, "Churned")
        .otherwise("Potential")
    )
