"""Percentile ranks of a whole table without sorting it in one task.

Equal values are counted first; only distinct values are dealt out by range, so a value that a third of all rows
have weighs no more than any other. The rows of each range are added up, the totals of the ranges below a range
are its offset, and running counts within the range do the rest. The ranked values are joined back
to the rows; values that are hot in the rows are broadcast and the rows that have them do not move.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions.columns import nan_to_null
from basketlens.operators.lookups import BROADCAST_ROWS, attach, held
from basketlens.sources.scratch import written

# Distinct values that one range holds, about.
RANGE_VALUES = 500_000


def value_ranks(df: DataFrame, value: str, *, range_values: int = RANGE_VALUES) -> DataFrame:
    """Per distinct value: ``value``, rows with it (``ties``), rows below it (``less``), and its average percentile ``rank``.

    The rank is that of the middle of the equal values, as a share of all rows with a value; missing values have none.
    """
    counted = written(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("ties")), "value-counts")
    ranges = max(1, -(-counted.count() // range_values))
    dealt = counted.repartitionByRange(ranges, value).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, "value-ranges")  # ranges are drawn by sampling: once written, they stay
    totals = sorted(dealt.groupBy("_range").agg(F.sum("ties").alias("n")).collect())  # a row per range
    rows = sum(r["n"] for r in totals)
    below = list(accumulate((r["n"] for r in totals), initial=0))[:-1]
    offsets = df.sparkSession.createDataFrame([(r["_range"], o) for r, o in zip(totals, below, strict=True)], "_of int, _below long")
    running = F.sum("ties").over(Window.partitionBy("_range").orderBy(value)) - F.col("ties")
    placed = dealt.withColumn("_running", running).join(F.broadcast(offsets), F.col("_range") == F.col("_of"))
    less = F.col("_below") + F.col("_running")
    return placed.select(value, "ties", less.alias("less"), ((less + (F.col("ties") + 1) / 2) / F.lit(float(rows or 1))).alias("rank"))


def percentile_ranks(
    df: DataFrame,
    values: dict[str, Column],
    *,
    range_values: int = RANGE_VALUES,
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``df`` with one column more for each of ``values``: the average percentile rank of that expression, null where it is missing."""
    given = df.columns
    for i, (name, value) in enumerate(values.items()):
        keyed = df.withColumn(f"_value{i}", nan_to_null(value.cast("double")))
        ranked = value_ranks(keyed, f"_value{i}", range_values=range_values)
        # Only a set of values that is small is broadcast; else hot ones are, and the rest is shuffled.
        lookup = held(ranked.select(f"_value{i}", F.col("rank").alias(name), F.col("ties").alias("_ties")), [f"_value{i}"], max_broadcast_rows)
        df = attach(keyed, lookup, [f"_value{i}"], [name], "_ties", max_rows=max_broadcast_rows).drop(f"_value{i}")
    return df.select(*given, *values)
