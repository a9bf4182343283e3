"""Order statistics of a whole column by counting in cells.

A cell is a range of values with the number of rows in it. The first pass counts rows in fixed cells, 64 to
a power of two, so their number does not depend on the data (268,000 at most). Questions (the k-th
value, rows below a bound, the first value from a bound on) are answered from the cells with a range: what is
asked is a point or lies within few cells. The cells that leave an answer open are split by the next pass, all questions'
cells at once: into single values where few rows are left, else into up to 65,536 equal steps between their smallest and largest
value. Each pass shortens what is open by that factor, so four passes settle any column of doubles, and nothing is estimated.

Questions may build on each other (fences on quartiles, quartiles of what is within the fences): ranges are carried through
the formulas, and the passes are shared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions.columns import nan_to_null

# Cells per power of two in the first pass.
OCTAVE = 64
# Steps that unsettled cells are split into, all together.
STEPS = 65_536
# Rows that are counted value by value, at most.
TASK_VALUES = 200_000
_LEAST_POWER = 1075  # a double is 0 or at least 2 to the power of -1074


def number(c: Column | str) -> Column:
    """The values that are counted: doubles; NaN is missing."""
    return nan_to_null((F.col(c) if isinstance(c, str) else c).cast("double"))


def first_cell(v: Column) -> Column:
    """Number of the fixed cell of a double; rises with the value."""
    size = F.floor(F.log2(F.abs(v)) * OCTAVE) + _LEAST_POWER * OCTAVE
    infinite = F.lit(2 * _LEAST_POWER * OCTAVE).cast("long")
    size = F.when(F.abs(v) == float("inf"), infinite).when(v == 0, F.lit(0).cast("long")).otherwise(size)
    return F.when(v < 0, -size).otherwise(size)


def step(v: Column, low: Column, high: Column, steps: int) -> Column:
    """Which of ``steps`` equal steps from ``low`` to ``high`` holds a value; the ends are in different ones."""
    whole = high / 2 - low / 2
    share = F.when(whole > 0, (v / 2 - low / 2) / whole).otherwise((v > low).cast("double"))
    return F.least(F.floor(share * steps), F.lit(steps - 1).cast("long"))


@dataclass(frozen=True)
class Range:
    """Where a number is known to lie."""

    low: float
    high: float

    @property
    def settled(self) -> bool:
        return self.low == self.high

    def plus(self, other: Range, factor: float) -> Range:
        """self + factor * other"""
        ends = sorted((factor * other.low, factor * other.high))
        return Range(self.low + ends[0], self.high + ends[1])


@dataclass(frozen=True)
class Cells:
    """Disjoint ranges in ascending order, which start and end with values that occur, and their rows."""

    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    open: set[int] = field(default_factory=set, compare=False)
    ends: np.ndarray = field(init=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "ends", np.concatenate([[0], np.cumsum(self.rows)]))

    @property
    def n(self) -> int:
        return int(self.ends[-1])

    def _answer(self, low: float, high: float, cells: np.ndarray) -> Range:
        """A range of values; if it is none, the ``cells`` it comes from have to be split."""
        if low != high:
            self.open.update(int(i) for i in cells if self.low[i] < self.high[i])
        return Range(low, high)

    def kth(self, first: int, last: int | None = None) -> Range:
        """The value at a 0-based index of the sorted values that lies between ``first`` and ``last``."""
        last = first if last is None else last
        a, b = (int(np.searchsorted(self.ends, min(max(i, 0), self.n - 1), side="right")) - 1 for i in (first, last))
        return self._answer(self.low[a], self.high[b], np.arange(a, b + 1))

    def _counted(self, sure: np.ndarray, possible: np.ndarray) -> Range:
        low, high = int(self.rows[sure].sum()), int(self.rows[possible].sum())
        if low != high:
            self.open.update(int(i) for i in np.flatnonzero(possible & ~sure) if self.low[i] < self.high[i])
        return Range(low, high)

    def below(self, x: Range) -> Range:
        """Rows less than ``x``."""
        return self._counted(self.high < x.low, self.low < x.high)

    def above(self, x: Range) -> Range:
        """Rows greater than ``x``."""
        return self._counted(self.low > x.high, self.high > x.low)

    def first_from(self, x: Range) -> Range:
        """The smallest value that is at least ``x``; there has to be one."""
        a, b = (min(int(np.searchsorted(self.high, e, side="left")), len(self.high) - 1) for e in (x.low, x.high))
        low = self.low[a] if self.low[a] >= x.low else x.low
        high = self.low[b] if self.low[b] >= x.high else self.high[b]
        return self._answer(low, high, np.arange(a, b + 1))

    def last_to(self, x: Range) -> Range:
        """The largest value that is at most ``x``; there has to be one."""
        a, b = (max(int(np.searchsorted(self.low, e, side="right")) - 1, 0) for e in (x.low, x.high))
        low = self.high[a] if self.high[a] <= x.low else self.low[a]
        high = self.high[b] if self.high[b] <= x.high else x.high
        return self._answer(low, high, np.arange(a, b + 1))

    def quantile(self, p: float, below: Range | None = None, inside: Range | None = None) -> Range:
        """Linear-interpolation quantile of all values, or of the ``inside`` ones that follow the first ``below``."""
        below, inside = below or Range(0, 0), inside or Range(self.n, self.n)
        at = [(m - 1) * p for m in (inside.low, inside.high)]
        if below.settled and inside.settled:
            first, last = (self.kth(int(below.low) + i) for i in (math.floor(at[0]), math.ceil(at[0])))
            if first.settled and last.settled:
                part = at[0] - math.floor(at[0])
                exact = (1 - part) * first.low + part * last.low
                return Range(exact, exact)
            return Range(first.low, last.high)
        around = self.kth(int(below.low) + math.floor(at[0]), int(below.high) + math.ceil(at[1]))
        return Range(around.low, around.high)

    def runs(self) -> list[tuple[int, int]]:
        """The open cells as runs of neighbours (first, last)."""
        found: list[tuple[int, int]] = []
        for i in sorted(self.open):
            if found and found[-1][1] == i - 1:
                found[-1] = (found[-1][0], i)
            else:
                found.append((i, i))
        return found

    def replaced(self, runs: Sequence[tuple[int, int]], low: np.ndarray, high: np.ndarray, rows: np.ndarray) -> Cells:
        """The cells with those of the runs given up for the new ones."""
        keep = np.ones(len(self.low), bool)
        for a, b in runs:
            keep[a : b + 1] = False
        return Cells.sorted(*(np.concatenate([old[keep], new]) for old, new in ((self.low, low), (self.high, high), (self.rows, rows))))

    @classmethod
    def sorted(cls, low: np.ndarray, high: np.ndarray, rows: np.ndarray) -> Cells:
        order = np.argsort(low, kind="stable")
        return cls(low[order], high[order], rows[order])


@dataclass(frozen=True)
class Profile:
    """First pass over a column: cells and moments of its values."""

    cells: Cells
    missing: int
    mean: float | None
    squares: float | None

    @property
    def n(self) -> int:
        return self.cells.n

    @property
    def std(self) -> float:
        """Sample standard deviation; 0 for one value."""
        return math.sqrt(self.squares / (self.n - 1)) if self.n > 1 else 0.0


def cell_counts(v: Column) -> list[Column]:
    """What is known of a cell: mergeable counts, ends and moments."""
    return [
        F.count(F.lit(1)).alias("_rows"),
        F.min(v).alias("_low"),
        F.max(v).alias("_high"),
        F.avg(v).alias("_mean"),
        (F.var_pop(v) * F.count(v)).alias("_squares"),
    ]


def gathered(counted: DataFrame) -> Profile:
    """Counted first cells (bounded in number) as a profile; the cell without a number is the missing values."""
    found = counted.select("_cell", "_rows", "_low", "_high", "_mean", "_squares").toArrow()
    known = found["_cell"].is_valid().to_numpy()
    low, high, rows, mean, squares = (found[c].to_numpy()[known] for c in ("_low", "_high", "_rows", "_mean", "_squares"))
    rows = rows.astype(np.int64)
    missing = int(found["_rows"].to_numpy()[~known].sum())
    if not len(rows):
        return Profile(Cells(low, high, rows), missing, None, None)
    order = np.argsort(low, kind="stable")  # the same sums whatever order the rows come in
    rows, mean, squares = rows[order], mean[order], squares[order]
    middle = float((rows * mean).sum() / rows.sum())
    spread = float((squares + rows * (mean - middle) ** 2).sum())
    return Profile(Cells(low[order], high[order], rows), missing, middle, spread)


def profile(df: DataFrame, column: str) -> Profile:
    """One pass: at most 64 cells for each power of two come back."""
    values = df.select(number(column).alias("_v")).select("_v", first_cell(F.col("_v")).alias("_cell"))
    return gathered(values.groupBy("_cell").agg(*cell_counts(F.col("_v"))))


def split(cells: Cells, df: DataFrame, column: str, task_values: int = TASK_VALUES, beside: Column | None = None) -> tuple[Cells, dict[int, int]]:
    """One pass that splits the open cells; ``beside`` is counted as well, for all rows with a value."""
    runs = cells.runs()
    values = df.select(number(column).alias("_v"), *([] if beside is None else [beside.alias("_beside")])).where("_v is not null")
    ends = [(float(cells.low[a]), float(cells.high[b])) for a, b in runs]
    left = sum(int(cells.rows[a : b + 1].sum()) for a, b in runs)
    v, run, key = F.col("_v"), F.lit(None).cast("int"), F.lit(None).cast("double")
    for i, (low, high) in enumerate(ends):
        within = v.between(F.lit(low), F.lit(high))
        run = F.when(within, i).otherwise(run)
        own = v if left <= task_values else step(v, F.lit(low), F.lit(high), max(2, STEPS // len(ends))).cast("double")
        key = F.when(within, own).otherwise(key)
    keyed = values.select("*", run.alias("_run"), key.alias("_key"))
    aggregates = [F.count(F.lit(1)).alias("_rows"), F.min("_v").alias("_low"), F.max("_v").alias("_high")]
    if beside is None:
        inside = F.lit(False)
        for low, high in ends:
            inside = inside | v.between(F.lit(low), F.lit(high))
        counted = keyed.where(inside).groupBy("_run", "_key").agg(F.lit(0).alias("_set"), F.lit(None).cast("int").alias("_beside"), *aggregates)
    else:
        sets = keyed.groupingSets([["_run", "_key"], ["_beside"]], "_run", "_key", "_beside")
        counted = sets.agg(F.grouping("_run").alias("_set"), *aggregates)
    found = counted.select("_set", "_run", "_beside", "_rows", "_low", "_high").toArrow()  # STEPS or task_values rows at most
    cut = (found["_set"].to_numpy() == 0) & found["_run"].is_valid().to_numpy()
    parts = [found[c].to_numpy()[cut] for c in ("_low", "_high", "_rows")]
    aside = found.filter(np.asarray(found["_set"].to_numpy() == 1)) if beside is not None else None
    counts = {} if aside is None else {k: int(n) for k, n in zip(aside["_beside"].to_pylist(), aside["_rows"].to_pylist(), strict=True)}
    return cells.replaced(runs, *parts), counts


def settled[T](cells: Cells, df: DataFrame, column: str, ask: Callable[[Cells], T], task_values: int = TASK_VALUES) -> tuple[T, Cells]:
    """The answer of ``ask`` once no cell leaves it open."""
    while True:
        answer = ask(cells)
        if not cells.open:
            return answer, cells
        cells, _ = split(cells, df, column, task_values)
