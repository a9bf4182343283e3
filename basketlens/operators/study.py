"""The hold-out study behind the choice of an imputation rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.operators.cells import TASK_VALUES
from basketlens.operators.exact import exact_quantiles
from basketlens.operators.impute import impute_each


def missing_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: share of rows in which it is missing."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return rates.unpivot([], list(columns), "column_name", "missing_rate")


def _sample_skewness() -> Column:
    """Skewness corrected for sample size, from a group's moments; null below three values or without spread."""
    n, spread = F.col("n"), F.col("m2") / F.col("n")
    skewness = F.try_divide(F.col("m3") / n, F.pow(spread, 1.5))
    corrected = skewness * F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.when((n > 2) & (F.col("low") < F.col("high")), corrected)


def group_profile(
    df: DataFrame, column: str, group: str, *, task_values: int = TASK_VALUES
) -> DataFrame:
    """Known values per group: count, mean, median, skewness, gap between mean and median."""
    stats = exact_quantiles(df.where(F.col(column).isNotNull()), column, [0.5], [group], task_values=task_values)
    median = F.col("q")[0]
    return stats.select(
        group,
        F.col("n").alias("known"),
        "mean",
        median.alias("median"),
        _sample_skewness().alias("skewness"),
        (F.col("mean") - median).alias("mean_median_gap"),
    )


def is_test_row(key: str) -> Column:
    """About a fifth of the keys, chosen by a digest of the key and so the same in every run."""
    return F.substring(F.md5(F.col(key).cast("string")), 1, 2) < "33"


def holdout_split(df: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) of the rows with a known value."""
    known = df.where(F.col(column).isNotNull())
    return known.where(~is_test_row(key)), known.where(is_test_row(key))


def holdout_errors(
    df: DataFrame,
    key: str,
    column: str,
    methods: dict[str, tuple[Sequence[str], str]],
    *,
    task_values: int = TASK_VALUES,
) -> DataFrame:
    """One row per method (grouping columns, strategy): error on values hidden from it."""
    train, test = holdout_split(df, key, column)
    hidden = test.withColumnRenamed(column, "_truth").withColumn(
        column, F.lit(None).cast(df.schema[column].dataType)
    )
    guesses = {f"_guess{i}": method for i, method in enumerate(methods.values())}
    hidden = impute_each(hidden, column, guesses, known=train, task_values=task_values)
    errors = []
    for i, name in enumerate(methods):
        miss = F.col(f"_guess{i}") - F.col("_truth")
        errors.append(
            F.struct(
                F.lit(name).alias("method"),
                F.count(miss).alias("test_rows"),
                F.avg(F.abs(miss)).alias("mae"),
                F.sqrt(F.avg(miss * miss)).alias("rmse"),
            )
        )
    return hidden.agg(F.array(*errors).alias("e")).select(F.inline("e"))


def with_improvement(errors: DataFrame, baseline: str) -> DataFrame:
    """Adds how much lower the MAE is than the baseline's, in percent; one row per method."""
    base = F.max(F.when(F.col("method") == baseline, F.col("mae"))).over(Window.partitionBy())  # a row per method
    return errors.withColumn("improvement_pct", (base - F.col("mae")) / base * 100)


def group_coverage(df: DataFrame, column: str, groupings: dict[str, Sequence[str]]) -> DataFrame:
    """One row per grouping: share of the rows to fill in which all its columns are present."""
    missing = df.where(F.col(column).isNull())
    shares = []
    for columns in groupings.values():
        present = F.lit(True)
        for c in columns:
            present = present & F.col(c).isNotNull()
        shares.append(F.avg(present.cast("int")))
    rows = missing.agg(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("grouping_name"),
                    F.count("*").alias("missing_rows"),
                    (share * 100).alias("coverage_pct"),
                )
                for name, share in zip(groupings, shares)
            ]
        ).alias("g")
    )
    return rows.select(F.inline("g"))


def group_policy(
    df: DataFrame, key: str, column: str, group: str, *, task_values: int = TASK_VALUES
) -> DataFrame:
    """Training rows and median per group, and which statistic its missing values get."""
    train = df.where(~is_test_row(key))
    stats = exact_quantiles(train, column, [0.5], [group], task_values=task_values)
    return stats.select(
        group,
        F.col("n").alias("training_rows"),
        F.col("q")[0].alias("median"),
        F.when(F.col("n") == 0, "global median").otherwise("group median").alias("policy"),
    )
