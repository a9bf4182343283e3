"""Checks that decide whether a table may be used."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.contracts import TableContract
from basketlens.functions.columns import parsed


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    """Raise before any job starts when a column is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"Missing columns: {missing}")


def schema_violation(df: DataFrame, contract: TableContract) -> str:
    """Why the columns of ``df`` break the contract; empty when they do not."""
    missing = sorted(set(contract.required) - set(df.columns))
    if missing:
        return f"missing required columns: {missing}"
    forbidden = sorted(set(contract.forbidden) & set(df.columns))
    if forbidden:
        return f"contains removed columns: {forbidden}"
    return ""


def contract_violation(df: DataFrame, contract: TableContract) -> str:
    """The first reason why ``df`` may not stand in for the contract's table."""
    reason = schema_violation(df, contract)
    if not reason and df.isEmpty():
        reason = "table has no data rows"
    return reason


def contract_report(tables: Sequence[tuple[DataFrame, TableContract]]) -> DataFrame:
    """One row per table: its row count and every broken part of its contract."""
    report = None
    for df, contract in tables:
        missing = sorted(set(contract.required) - set(df.columns))
        removed = sorted(set(contract.forbidden) & set(df.columns))
        row = df.agg(F.count("*").alias("row_count")).select(
            F.lit(contract.name).alias("table_name"),
            "row_count",
            F.lit(", ".join(missing)).alias("missing_columns"),
            F.lit(", ".join(removed)).alias("removed_columns"),
            (F.lit(not missing and not removed) & (F.col("row_count") > 0)).alias("valid"),
        )
        report = row if report is None else report.unionByName(row)
    return report


def dimension_key_report(df: DataFrame, key: str) -> DataFrame:
    """One row: rows without a key, keys used more than once, and the rows they sit on."""
    counts = df.groupBy(key).agg(F.count("*").alias("_rows"))
    repeated = F.col(key).isNotNull() & (F.col("_rows") > 1)
    return counts.agg(
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("_rows"))), F.lit(0))
        .cast("long")
        .alias("null_keys"),
        F.count_if(repeated).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(repeated, F.col("_rows"))), F.lit(0))
        .cast("long")
        .alias("duplicate_rows"),
    )


def unparsable(column: str, wanted: str) -> Column:
    """Number of non-null texts that are no value of the wanted type."""
    return F.count_if(F.col(column).isNotNull() & parsed(column, wanted).isNull())


def missing_ids(ids: Sequence[str]) -> Column:
    """Number of rows in which at least one identifier is missing."""
    missing = F.lit(False)
    for c in ids:
        missing = missing | F.col(c).isNull()
    return F.count_if(missing)


def unparsable_report(raw: DataFrame, types: dict[str, str]) -> DataFrame:
    """One row per text column: how many of its texts cannot be parsed."""
    bad = raw.agg(*[unparsable(c, t).alias(c) for c, t in types.items()])
    return bad.unpivot([], list(types), "column_name", "unparsable")


def missing_id_report(facts: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row: facts in which at least one identifier is missing."""
    return facts.agg(missing_ids(ids).alias("facts_with_missing_id"))


def unknown_keys(facts: DataFrame, key: str, dimension: DataFrame, dimension_key: str) -> DataFrame:
    """Keys used by facts that the dimension does not have, with their fact counts.

    Facts are counted per key before the anti join, so a hot key is one row in it.
    """
    used = facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("facts"))
    known = dimension.select(F.col(dimension_key).alias("_known"))
    return used.join(known, used[key] == known["_known"], "left_anti")


def dimension_errors(df: DataFrame, key: str, name: str) -> list[str]:
    found = dimension_key_report(df, key).first()
    if found["null_keys"] or found["duplicate_keys"]:
        return [f"{name} has missing or duplicate {key} values"]
    return []


TRANSACTION_IDS = ("customer_id", "product_id")


def transaction_faults(types: dict[str, str]) -> list[Column]:
    """Faults that one look at a row shows; they can be counted while the rows are written."""
    return [
        missing_ids(TRANSACTION_IDS).alias("contains missing identifiers"),
        *[unparsable(c, t).alias(f"has unparsable {c}") for c, t in types.items()],
    ]


def transaction_errors(
    faults: dict[str, int], facts: DataFrame, customers: DataFrame, articles: DataFrame
) -> list[str]:
    """All faults, the counted ones and references to customers or articles nobody knows."""
    unknown = None
    for key, dimension, what in (
        ("customer_id", customers, "customer"),
        ("product_id", articles, "article"),
    ):
        row = unknown_keys(facts, key, dimension, key).agg(
            F.lit(f"references an unknown {what}").alias("problem"),
            F.coalesce(F.sum("facts"), F.lit(0)).alias("facts"),
        )
        unknown = row if unknown is None else unknown.unionByName(row)
    found = dict(faults) | {r["problem"]: r["facts"] for r in unknown.collect()}  # two rows
    return [f"transactions {problem} ({rows} rows)" for problem, rows in found.items() if rows]
