"""Descriptive statistics of the facts and their correlations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.contracts import HISTOGRAM_BINS, IQR_THRESHOLD, WEAK_CORRELATION
from basketlens.functions.columns import correlation, money, nan_to_null, order_month
from basketlens.operators.cells import (
    TASK_VALUES,
    Cells,
    Profile,
    Range,
    cell_counts,
    first_cell,
    gathered,
    number,
    profile,
    settled,
    split,
)
from basketlens.operators.exact import exact_quantiles
from basketlens.operators.outliers import QUARTILES, fences_of
from basketlens.operators.rfm import AMOUNT_SCALE
from basketlens.sources.scratch import written


SUMMARY = "count long, mean double, median double, std double, q1 double, q3 double, min double, max double"


def _summary_row(seen: Profile, quartiles: Sequence[float]) -> tuple:
    if not seen.n:
        raise ValueError("numeric summary requires at least one value")
    q1, median, q3 = map(float, quartiles)
    ends = float(seen.cells.low[0]), float(seen.cells.high[-1])
    return (seen.n, seen.mean, median, seen.std, q1, q3, *ends)


def numeric_summary(
    df: DataFrame, column: str, *, task_values: int = TASK_VALUES
) -> DataFrame:
    """One row: count, mean, median, std (sample; 0 for one value), q1, q3, min, max."""
    seen = profile(df, column)
    ask = lambda cells: [cells.quantile(p).low for p in QUARTILES] if seen.n else []
    quartiles, _ = settled(seen.cells, df, column, ask, task_values)
    return df.sparkSession.createDataFrame([_summary_row(seen, quartiles)], SUMMARY)


def column_profile(
    df: DataFrame, columns: Sequence[str], *, task_values: int = TASK_VALUES
) -> DataFrame:
    """One row per numeric column: missing values and the numeric summary, all columns at once."""
    cells = [
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value"))
        for c in columns
    ]
    long = df.select(F.inline(F.array(*cells)))
    stats = exact_quantiles(long, "value", QUARTILES, ["column_name"], few_groups=True, task_values=task_values)
    spread = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).otherwise(0.0)
    return stats.select(
        "column_name",
        "missing",
        F.col("n").alias("count"),
        "mean",
        F.col("q")[1].alias("median"),
        spread.alias("std"),
        F.col("q")[0].alias("q1"),
        F.col("q")[2].alias("q3"),
        F.col("low").alias("min"),
        F.col("high").alias("max"),
    )


@dataclass(frozen=True)
class Bars:
    """Equal bins from ``low`` to ``high``; a bin holds its left edge, the last one both."""

    low: float
    high: float
    bins: int

    @classmethod
    def over(cls, low: float, high: float, bins: int) -> Bars:
        return cls(low - 0.5, high + 0.5, bins) if low == high else cls(low, high, bins)

    def edge(self, i: Column) -> Column:
        step = (self.high - self.low) / self.bins
        return F.when(i == self.bins, F.lit(self.high)).otherwise(i * F.lit(step) + F.lit(self.low))

    def edges(self) -> list[float]:
        step = (self.high - self.low) / self.bins
        return [i * step + self.low for i in range(self.bins)] + [self.high]

    def of(self, v: Column) -> Column:
        """The bin of a value; one that rounding put on the wrong side of a computed edge is moved to the bin whose edges hold it."""
        last = self.bins - 1
        first = F.least(F.lit(last), F.floor((v - F.lit(self.low)) / F.lit(self.high - self.low) * self.bins))
        below, beyond = v < self.edge(first), (first < last) & (v >= self.edge(first + 1))
        return F.when(below, first - 1).when(beyond, first + 1).otherwise(first)


def histogram(
    df: DataFrame,
    column: str,
    bins: int = HISTOGRAM_BINS,
    *,
    value_range: tuple[float, float] | None = None,
) -> DataFrame:
    """(bin, left_edge, right_edge, count) of equal widths; empty bins are rows as well.

    A bin holds its left edge, the last one both. Values that rounding put on the wrong
    side of a computed edge are moved to the bin whose edges hold them.
    """
    lo, hi = value_range or df.agg(
        F.min(column).cast("double"), F.max(column).cast("double")
    ).first()
    if lo is None:
        raise ValueError(f"{column} has no values")
    bars = Bars.over(lo, hi, bins)
    v = F.col(column).cast("double")
    counts = df.where(v.isNotNull()).groupBy(bars.of(v).alias("_bin")).agg(F.count("*").alias("_count"))
    frame = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return frame.join(F.broadcast(counts), F.col("bin") == F.col("_bin"), "left").select(
        F.col("bin").cast("int").alias("bin"),
        bars.edge(F.col("bin")).alias("left_edge"),
        bars.edge(F.col("bin") + 1).alias("right_edge"),
        F.coalesce("_count", F.lit(0)).cast("long").alias("count"),
    )


BOX = "label string, q1 double, med double, q3 double, whislo double, whishi double"


@dataclass(frozen=True)
class Box:
    """Quartiles, and as whiskers the outermost values within the fences."""

    quartiles: list[Range]
    whislo: Range
    whishi: Range

    def row(self, label: str) -> tuple:
        return (label, *(float(x.low) for x in (*self.quartiles, self.whislo, self.whishi)))


def boxes(cells: Cells) -> tuple[Box, Box]:
    """Boxplots of all values and of those within the fences, as far as the cells know them.

    Quartiles and fences of the second one are those of what is left: order statistics of all
    values, shifted by the number of values below the first fence.
    """
    q, lower, upper = fences_of(cells, IQR_THRESHOLD)
    first = Box(q, cells.first_from(lower), cells.last_to(upper))
    below, above = cells.below(lower), cells.above(upper)
    inside = Range(cells.n - below.high - above.high, cells.n - below.low - above.low)
    kept, low, high = fences_of(cells, IQR_THRESHOLD, below, inside)
    low = Range(max(lower.low, low.low), max(lower.high, low.high))
    high = Range(min(upper.low, high.low), min(upper.high, high.high))
    return first, Box(kept, cells.first_from(low), cells.last_to(high))


def _boxplot(df: DataFrame, column: str, which: int, label: str, task_values: int) -> DataFrame:
    seen = profile(df, column)
    if not seen.n:
        raise ValueError(f"{column} has no values")
    both, _ = settled(seen.cells, df, column, boxes, task_values)
    return df.sparkSession.createDataFrame([both[which].row(label)], BOX)


def boxplot_before(df: DataFrame, column: str, *, task_values: int = TASK_VALUES) -> DataFrame:
    """One row: the boxplot of all values."""
    return _boxplot(df, column, 0, "Before IQR", task_values)


def boxplot_after(df: DataFrame, column: str, *, task_values: int = TASK_VALUES) -> DataFrame:
    """One row: the boxplot of the inliers, whose quartiles and fences are those of what is left."""
    return _boxplot(df, column, 1, "After IQR", task_values)


@dataclass(frozen=True)
class Description:
    """Everything a report says about an amount of the facts, from shared passes."""

    summary: dict[str, float | int]
    histogram_edges: list[float]
    histogram_counts: list[int]
    before: dict[str, float | str]
    after: dict[str, float | str]
    per_month: DataFrame
    per_key: DataFrame


def describe(
    facts: DataFrame, column: str, date_col: str, key: str, *, bins: int = HISTOGRAM_BINS,
    amount_scale: int = AMOUNT_SCALE, task_values: int = TASK_VALUES,
) -> Description:
    """Summary, histogram, both boxplots, totals per month and moments per key of ``column``.

    One pass counts by cell, by month and by key side by side; its result, partial sums of bounded
    or key-sized number, is written. The second splits the cells that quartiles, fences and whiskers
    lie in and counts the histogram's bins; the third usually settles the rest.
    """
    v = F.col("_v")
    keyed = facts.select(
        number(column).alias("_v"), money(column, amount_scale).alias("_amount"), order_month(date_col).alias("order_month"), F.col(key).alias("_key")
    ).select("*", first_cell(v).alias("_cell"))
    sets = keyed.groupingSets([["_cell"], ["order_month"], ["_key"]], "_cell", "order_month", "_key")
    partial = sets.agg(F.grouping_id().alias("_set"), F.count(v).alias("_n"), F.sum("_amount").alias("_total"), *cell_counts(v))
    partial = written(partial, "fact-partials")
    seen = gathered(partial.where("_set = 3"))
    if not seen.n:
        raise ValueError("numeric summary requires at least one value")
    bars = Bars.over(float(seen.cells.low[0]), float(seen.cells.high[-1]), bins)
    boxes(seen.cells)  # opens the cells it depends on
    cells, counts = split(seen.cells, facts, column, task_values, bars.of(number(column)))
    both, _ = settled(cells, facts, column, boxes, task_values)
    names = [n.split()[0] for n in SUMMARY.split(", ")]
    box = [n.split()[0] for n in BOX.split(", ")]
    month = partial.where("_set = 5 and order_month is not null")
    return Description(
        summary=dict(zip(names, _summary_row(seen, [x.low for x in both[0].quartiles]), strict=True)),
        histogram_edges=bars.edges(),
        histogram_counts=[counts.get(i, 0) for i in range(bins)],
        before=dict(zip(box, both[0].row("Before IQR"), strict=True)),
        after=dict(zip(box, both[1].row("After IQR"), strict=True)),
        per_month=month.select("order_month", F.coalesce("_total", F.lit(0)).cast("double").alias("monetary")).orderBy("order_month"),
        per_key=partial.where("_set = 6 and _key is not null and _n > 0").select("_key", "_n", "_mean", F.col("_squares").alias("_within")),
    )


def moments_per_key(facts: DataFrame, key: str, x: str) -> DataFrame:
    """(_key, _n, _mean, _within): count, mean and squared distances from it of ``x``, a row per key."""
    valued = facts.select(F.col(key).alias("_key"), F.col(x).cast("double").alias("_x")).dropna()
    return valued.groupBy("_key").agg(
        F.count("*").alias("_n"),
        F.avg("_x").alias("_mean"),
        (F.var_pop("_x") * F.count("*")).alias("_within"),
    )


def key_correlations(per_key: DataFrame, lookup: DataFrame, lookup_key: str, ys: Sequence[str]) -> DataFrame:
    """(attribute, keys, facts, correlation) of ``moments_per_key`` with each attribute ``ys`` of the keys.

    The attributes are the same for all facts of a key, so only rows per key are joined, once for all
    attributes: a hot key costs one row, and no fact is shuffled. The joined rows are written; weighted
    means are taken in one pass over them and co-moments about these means in a second, so neither large
    offsets nor keys without facts cost digits. An attribute counts over the keys that have it; its correlation is 0 if
    it or the amount is constant there. Of several rows of a key the smallest value counts.
    """
    names = [f"_y{i}" for i in range(len(ys))]
    known = lookup.select(F.col(lookup_key).alias("_lookup"), *[nan_to_null(F.col(y).cast("double")).alias(n) for y, n in zip(ys, names, strict=True)])
    known = known.where("_lookup is not null").groupBy("_lookup").agg(*[F.min(n).alias(n) for n in names])
    joined = per_key.join(known, F.col("_key") == F.col("_lookup")).select("_n", "_mean", "_within", *names)
    table = written(joined, "key-correlation")

    def with_y(y: str, c: Column) -> Column:
        return F.when(F.col(y).isNotNull(), c)

    n, x = F.col("_n"), F.col("_mean")
    total = {y: F.sum(with_y(y, n)) for y in names}
    means = table.agg(
        *[(F.sum(with_y(y, n * x)) / total[y]).alias(f"{y}_mx") for y in names],
        *[(F.sum(n * F.col(y)) / total[y]).alias(f"{y}_my") for y in names],
        *[(F.min(y) < F.max(y)).alias(f"{y}_varies") for y in names],
    )
    cells = []
    for y, name in zip(names, ys, strict=True):
        dx, dy = x - F.col(f"{y}_mx"), F.col(y) - F.col(f"{y}_my")
        xx, yy, xy = F.sum(with_y(y, F.col("_within") + n * dx * dx)), F.sum(n * dy * dy), F.sum(with_y(y, n * dx * dy))
        spread = F.when(F.any_value(f"{y}_varies") & (xx > 0) & (yy > 0), F.sqrt(xx) * F.sqrt(yy))
        found = F.coalesce(F.try_divide(xy, spread), F.lit(0.0))
        cells.append(F.struct(F.lit(name).alias("attribute"), F.count(y).alias("keys"), F.coalesce(total[y], F.lit(0)).alias("facts"), found.alias("correlation")))
    return table.crossJoin(F.broadcast(means)).agg(F.array(*cells).alias("c")).select(F.inline("c"))  # means: one row


def fact_correlations(facts: DataFrame, key: str, x: str, lookup: DataFrame, lookup_key: str, ys: Sequence[str]) -> DataFrame:
    """``key_correlations`` of a fact column with several attributes of its key: one pass over the facts."""
    return key_correlations(moments_per_key(facts, key, x), lookup, lookup_key, ys)


def fact_correlation(
    facts: DataFrame, key: str, x: str, lookup: DataFrame, lookup_key: str, y: str
) -> DataFrame:
    """One row: correlation of a fact column with an attribute of its key, 0 if one is constant."""
    return fact_correlations(facts, key, x, lookup, lookup_key, [y]).select("correlation")


def column_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: correlation over rows that have both, null if one is constant."""
    return df.agg(correlation(x, y).alias("correlation"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature_a, feature_b, correlation) for all ordered pairs, in one pass over the table."""
    upper = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    cells = df.agg(*[correlation(a, b).alias(f"{a}|{b}") for a, b in upper])
    rows = [
        F.struct(
            F.lit(a).alias("feature_a"),
            F.lit(b).alias("feature_b"),
            F.col(f"`{a}|{b}`" if (a, b) in upper else f"`{b}|{a}`").alias("correlation"),
        )
        for a in columns
        for b in columns
    ]
    return cells.select(F.inline(F.array(*rows)))


def strongest_pair(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The pair of different features with the largest absolute correlation."""
    pair = F.concat("feature_a", F.lit("|"), "feature_b")
    wanted = [f"{a}|{b}" for a, b in combinations(columns, 2)]
    return (
        matrix.where(pair.isin(*wanted))
        .orderBy(F.desc_nulls_last(F.abs("correlation")), "feature_a", "feature_b")
        .limit(1)
    )


def monthly_totals(
    facts: DataFrame,
    date_col: str = "order_date",
    amount_col: str = "unit_price",
    *,
    amount_scale: int = AMOUNT_SCALE,
) -> DataFrame:
    """(order_month, monetary) in calendar order; facts without a date belong to no month."""
    return (
        facts.where(F.col(date_col).isNotNull())
        .groupBy(order_month(date_col).alias("order_month"))
        .agg(
            F.coalesce(F.sum(money(amount_col, amount_scale)), F.lit(0))
            .cast("double")
            .alias("monetary")
        )
        .orderBy("order_month")
    )


def peak_month(monthly: DataFrame) -> DataFrame:
    """The month with the largest total, the earlier one on ties."""
    return monthly.orderBy(F.desc("monetary"), "order_month").limit(1)


def tail_label(mean: Column, median: Column) -> Column:
    return F.when(mean > median, "right tail possible").otherwise("no strong right tail")


def strength_label(r: Column) -> Column:
    return F.when(F.abs(r) < WEAK_CORRELATION, "very weak linear relation").otherwise(
        "weak linear relation"
    )
