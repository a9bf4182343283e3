"""Raw tables to normalised tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType

from basketlens.contracts import (
    ARTICLE_COLUMNS,
    CUSTOMER_COLUMNS,
    MASK,
    TRANSACTION_COLUMNS,
)
from basketlens.functions.columns import image_path, nan_to_null, null_texts_to_null, parsed
from basketlens.operators.quality import require_columns


def normalize_nulls(df: DataFrame) -> DataFrame:
    """One way to say missing: null texts and NaN become null."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, StringType):
            c = null_texts_to_null(c)
        elif isinstance(field.dataType, (DoubleType, FloatType)):
            c = nan_to_null(c)
        out.append(c.alias(field.name))
    return df.select(*out)


def selected(raw: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Prune to the wanted columns, by name, and rename them."""
    require_columns(raw, columns)
    return normalize_nulls(raw.select(*[F.col(a).alias(b) for a, b in columns.items()]))


def normalize_customers(raw: DataFrame, columns: dict[str, str] = CUSTOMER_COLUMNS) -> DataFrame:
    """customer_id, age, club_member_status; a missing age stays missing."""
    df = selected(raw, columns)
    return df.select(
        F.col("customer_id").cast("string").alias("customer_id"),
        nan_to_null(F.col("age").cast("double")).alias("age"),
        F.col("club_member_status").cast("string").alias("club_member_status"),
    )


def normalize_articles(raw: DataFrame, columns: dict[str, str] = ARTICLE_COLUMNS) -> DataFrame:
    """product_id, product_name and the image path that follows from the id."""
    df = selected(raw, columns)
    product_id = F.col("product_id").cast("string")
    return df.select(
        product_id.alias("product_id"),
        F.col("product_name").cast("string").alias("product_name"),
        image_path(product_id).alias("image_path"),
    )


# Types the two parsed columns of a transaction must have.
TRANSACTION_TYPES = {"order_date": "timestamp_ntz", "unit_price": "double"}


def parsed_transactions(renamed: DataFrame, *, strict: bool = True) -> DataFrame:
    """Dates and numbers from texts; a text that is neither stops the job.

    Not ``strict``, it becomes null: for callers that count such texts in the same pass
    and reject the result if there are any.
    """

    def value(name: str) -> Column:
        found = parsed(name, TRANSACTION_TYPES[name])
        if not strict:
            return found
        said = F.concat(F.lit(f"[CAST_INVALID_INPUT] {name} cannot be parsed: "), F.col(name).cast("string"))
        return F.when(found.isNull() & F.col(name).isNotNull(), F.raise_error(said)).otherwise(found)

    return renamed.select(
        F.col("customer_id").cast("string").alias("customer_id"),
        F.col("product_id").cast("string").alias("product_id"),
        value("order_date").alias("order_date"),
        nan_to_null(value("unit_price")).alias("unit_price"),
    )


def normalize_transactions(
    raw: DataFrame, columns: dict[str, str] = TRANSACTION_COLUMNS
) -> DataFrame:
    """customer_id, product_id, order_date, unit_price."""
    return parsed_transactions(selected(raw, columns))


def load_summary(transactions: DataFrame, customers: DataFrame, articles: DataFrame) -> DataFrame:
    """One row with the three row counts."""
    one = transactions.agg(F.count("*").alias("transaction_rows"))
    for df, name in ((customers, "customer_rows"), (articles, "product_rows")):
        one = one.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))  # one row each
    return one


def dataset_inventory(tables: list[tuple[str, str, str, DataFrame]]) -> DataFrame:
    """One row per (name, grain, role, table): rows and columns."""
    inventory = None
    for name, grain, role, df in tables:
        row = df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"),
            F.lit(grain).alias("grain"),
            "row_count",
            F.lit(len(df.columns)).alias("column_count"),
            F.lit(role).alias("role"),
        )
        inventory = row if inventory is None else inventory.unionByName(row)
    return inventory


def masked_preview(transactions: DataFrame, rows: int = 5) -> DataFrame:
    """The first rows by date, product, customer and price, with the identifiers hidden."""
    first = transactions.orderBy("order_date", "product_id", "customer_id", "unit_price").limit(rows)
    return first.withColumns({"customer_id": F.lit(MASK), "product_id": F.lit(MASK)})
