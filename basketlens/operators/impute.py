"""Missing numeric values filled from the statistics of their group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from basketlens.contracts import IMPUTE_STRATEGIES
from basketlens.operators.cells import TASK_VALUES
from basketlens.operators.exact import group_statistics, quantile_indices, quantiles
from basketlens.operators.lookups import BROADCAST_ROWS, Lookup, attach


def _check_strategy(strategy: str) -> None:
    if strategy not in IMPUTE_STRATEGIES:
        raise ValueError("strategy must be 'median' or 'mean'")


def fill_values(
    learn: DataFrame,
    column: str,
    methods: Sequence[tuple[Sequence[str], str]],
    *,
    task_values: int = TASK_VALUES,
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> tuple[dict[tuple[str, ...], Lookup], dict[str, float | None]]:
    """What missing values get: per grouping a lookup (its columns, median, mean, _rows), and the statistics of all rows.

    All groupings and strategies come from one digest of the rows learnt from.
    """
    groupings = list(dict.fromkeys(tuple(by) for by, _ in methods if by))
    columns = list(dict.fromkeys(c for by in groupings for c in by))
    medians = any(strategy == "median" for _, strategy in methods)
    limits = {"task_values": task_values, "max_broadcast_rows": max_broadcast_rows}
    state = group_statistics(learn, column, columns, quantile_indices([0.5]) if medians else [], [*groupings, ()], **limits)
    lookups = {}
    if state.small:
        kinds = {f.name: f.dataType for f in learn.select(*columns).schema.fields}
        for i, by in enumerate(groupings):
            rows = [(*(r[c] for c in by), _median(r) if medians else None, r["mean"], r["n"] + r["missing"]) for r in state.rows if r["_set"] == i]
            schema = StructType([StructField(c, kinds[c]) for c in by]).add("_median", "double").add("_mean", "double").add("_rows", "long")
            lookups[by] = Lookup(learn.sparkSession.createDataFrame(rows, schema), rows)
        everything = next(({"median": _median(r) if medians else None, "mean": r["mean"]} for r in state.rows if r["_set"] == len(groupings)), None)
    else:
        median = quantiles(state.df, [0.5])[0] if medians else F.lit(None).cast("double")
        fills = state.df.select("_set", *columns, median.alias("_median"), F.col("mean").alias("_mean"), (F.col("n") + F.col("missing")).alias("_rows"))
        for i, by in enumerate(groupings):
            lookups[by] = Lookup(fills.where(F.col("_set") == i).select(*by, "_median", "_mean", "_rows"))
        everything = fills.where(F.col("_set") == len(groupings)).select(F.col("_median").alias("median"), F.col("_mean").alias("mean")).first()
    return lookups, {s: everything[s] if everything else None for s in IMPUTE_STRATEGIES}


def _median(row: Row) -> float | None:
    """From the two middle values."""
    if not row["n"]:
        return None
    first, last = row["_r0"][0], row["_r1"][0]
    return first if row["n"] % 2 else (first + last) / 2


def impute_each(
    df: DataFrame,
    column: str,
    methods: dict[str, tuple[Sequence[str], str]],
    *,
    known: DataFrame | None = None,
    task_values: int = TASK_VALUES,
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``df`` with one column more per method (grouping columns, strategy): ``column``, its gaps filled.

    A gap gets its group's statistic, else that of all rows. A missing group is a group of its
    own. ``known`` gives other rows to learn from.
    """
    for _, strategy in methods.values():
        _check_strategy(strategy)
    limits = {"task_values": task_values, "max_broadcast_rows": max_broadcast_rows}
    lookups, overall = fill_values(df if known is None else known, column, list(methods.values()), **limits)
    joined, values = df, {}
    for i, (by, lookup) in enumerate(lookups.items()):
        named = {s: f"_{s}{i}" for s in IMPUTE_STRATEGIES}
        renamed = Lookup(lookup.df.withColumnsRenamed({f"_{s}": new for s, new in named.items()}), lookup.rows)
        # Rows learnt from elsewhere say nothing about how often a group occurs in those filled.
        joined = attach(joined, renamed, by, list(named.values()), None if known is not None else "_rows", max_rows=max_broadcast_rows)
        values[by] = named
    filled = {}
    for name, (by, strategy) in methods.items():
        group = [F.col(values[tuple(by)][strategy])] if by else []
        filled[name] = F.coalesce(F.col(column).cast("double"), *group, F.lit(overall[strategy]).cast("double"))
    return joined.select(*df.columns, *[c.alias(name) for name, c in filled.items()])


def impute(
    df: DataFrame,
    column: str,
    group_columns: str | Sequence[str],
    strategy: str = "median",
    *,
    known: DataFrame | None = None,
    output: str | None = None,
    task_values: int = TASK_VALUES,
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``column`` filled as by ``impute_each``; ``output`` is another name for the filled column."""
    by = [group_columns] if isinstance(group_columns, str) else list(group_columns)
    limits = {"task_values": task_values, "max_broadcast_rows": max_broadcast_rows}
    filled = impute_each(df, column, {"_filled": (by, strategy)}, known=known, **limits)
    if output is not None and output != column:
        return filled.withColumnRenamed("_filled", output)
    return filled.select(*[F.col("_filled").alias(c) if c == column else F.col(c) for c in df.columns])


def impute_report(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """One row: values missing before and after."""
    return before.agg(F.count_if(F.col(column).isNull()).alias("missing_before")).crossJoin(
        F.broadcast(after.agg(F.count_if(F.col(column).isNull()).alias("missing_after")))
    )
