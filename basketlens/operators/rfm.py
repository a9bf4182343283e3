"""Recency, frequency and monetary value per customer, scores and segments."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.contracts import CUSTOMER_BUCKETS
from basketlens.functions.columns import local_time, money, stable_bucket, whole_days_between
from basketlens.functions.scoring import Cut, quarter_score, segment
from basketlens.operators.cells import TASK_VALUES
from basketlens.operators.exact import order_statistics
from basketlens.operators.ranks import percentile_ranks
from basketlens.sources.scratch import written_with_facts

# Decimal places kept when amounts are added; digits beyond them are rounded away.
AMOUNT_SCALE = 12


def visits(
    facts: DataFrame,
    customer_col: str = "customer_id",
    date_col: str = "order_date",
    amount_col: str = "unit_price",
    *,
    date_grain: str = "timestamp",
    amount_scale: int = AMOUNT_SCALE,
) -> DataFrame:
    """Facts added up per customer and date: (customer, order_date, facts, amount).

    Partial sums of several loads add up to the whole (``merged_visits``), and a customer with a third
    of all facts is one row per date, spread over all tasks while it is reduced.
    """
    if date_grain not in ("timestamp", "day"):
        raise ValueError("date_grain must be 'timestamp' or 'day'")
    bought = local_time(date_col)
    if date_grain == "day":
        bought = local_time(F.to_date(bought))
    dated = facts.where(F.col(customer_col).isNotNull()).select(F.col(customer_col), bought.alias("order_date"), money(amount_col, amount_scale).alias("_amount"))
    return dated.groupBy(customer_col, "order_date").agg(F.count(F.lit(1)).alias("facts"), F.sum("_amount").alias("amount"))


def merged_visits(parts: DataFrame, customer_col: str = "customer_id") -> DataFrame:
    """Visits of several loads as those of all."""
    kind = parts.schema["amount"].dataType
    return parts.groupBy(customer_col, "order_date").agg(F.sum("facts").alias("facts"), F.sum("amount").cast(kind).alias("amount"))


def customers_of(visited: DataFrame, customer_col: str = "customer_id") -> DataFrame:
    """One row per customer: last_purchase, frequency (distinct dates), monetary; ``visited`` has a row per customer and date."""
    return visited.groupBy(customer_col).agg(
        F.max("order_date").alias("last_purchase"),
        F.count("order_date").alias("frequency"),
        F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("monetary"),
    )


def purchases_per_customer(
    facts: DataFrame,
    customer_col: str = "customer_id",
    date_col: str = "order_date",
    amount_col: str = "unit_price",
    *,
    date_grain: str = "timestamp",
    amount_scale: int = AMOUNT_SCALE,
) -> DataFrame:
    """``customers_of`` the ``visits`` of the facts."""
    grain = {"date_grain": date_grain, "amount_scale": amount_scale}
    return customers_of(visits(facts, customer_col, date_col, amount_col, **grain), customer_col)


def rfm_base(
    facts: DataFrame,
    customer_col: str = "customer_id",
    date_col: str = "order_date",
    amount_col: str = "unit_price",
    analysis_date: str | dt.date | dt.datetime | None = None,
    *,
    date_grain: str = "timestamp",
    amount_scale: int = AMOUNT_SCALE,
    partition_count: int | None = None,
) -> DataFrame:
    """Recency in whole days, frequency, monetary; the customer table is written once.

    The reference day is ``analysis_date``, else the day after the last purchase.
    """
    customers = purchases_per_customer(
        facts, customer_col, date_col, amount_col, date_grain=date_grain, amount_scale=amount_scale
    )
    return recency_of(customers, customer_col, analysis_date, partition_count=partition_count)


def recency_of(
    customers: DataFrame,
    customer_col: str = "customer_id",
    analysis_date: str | dt.date | dt.datetime | None = None,
    *,
    partition_count: int | None = None,
) -> DataFrame:
    """``rfm_base`` from one row per customer."""
    if partition_count is not None:
        customers = customers.repartition(partition_count, customer_col)
    table, known = written_with_facts(
        customers,
        "customers-rfm",
        F.count(F.lit(1)).alias("customers"),
        F.max("last_purchase").alias("last"),
        F.count_if(F.col("last_purchase").isNull()).alias("undated"),
    )
    if not known.get("customers"):
        raise ValueError("cannot calculate RFM from an empty transaction table")
    if analysis_date is None:
        if known["last"] is None:
            raise ValueError("cannot calculate RFM when no transaction has a date")
        analysis_date = known["last"].date() + dt.timedelta(days=1)
    if known["undated"]:
        undated = table.where(F.col("last_purchase").isNull()).count()
        raise ValueError(f"cannot calculate RFM: {undated} customers have no transaction with a date")
    reference = local_time(F.lit(analysis_date))
    return table.select(
        customer_col,
        whole_days_between(F.col("last_purchase"), reference).alias("recency"),
        "frequency",
        "monetary",
    )


def score_cuts(
    base: DataFrame,
    metrics: dict[str, Column],
    *,
    task_values: int = TASK_VALUES,
) -> dict[str, list[Cut | None]]:
    """Per metric the three values at which the score changes.

    A score is the quarter of the average percentile rank, and rises with the value. So
    three exact order statistics per metric replace a global rank over all customers.
    With k/4 of n rows as the limit, the value at index floor(k*n/4) - 1 is the last one
    that can lie below it; it does itself if its average rank, counted in exact integers,
    is within the limit.
    """
    long = base.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
                    for name, value in metrics.items()
                ]
            )
        ).alias("m")
    ).select("m.metric", "m.value")
    found = order_statistics(
        long,
        "value",
        {f"cut{k}": [lambda n, m, k=k: m.floor(n * k / 4) - 1] for k in (1, 2, 3)},
        by=["metric"],
        few_groups=True,
        task_values=task_values,
    ).collect()  # one row per metric
    cuts: dict[str, list[Cut | None]] = {}
    for row in found:
        cuts[row["metric"]] = [
            None
            if (hit := row[f"cut{k}"][0]) is None
            else Cut(hit["value"], 4 * hit["less"] + 2 * hit["ties"] + 2 <= k * row["n"])
            for k in (1, 2, 3)
        ]
    return cuts


def _metrics() -> dict[str, Column]:
    """What is ranked and scored; a small recency is good."""
    return {"r": -F.col("recency"), "f": F.col("frequency"), "m": F.col("monetary")}


def rfm_ranks(base: DataFrame, **limits: int) -> DataFrame:
    """Adds r_rank, f_rank and m_rank, the average percentile ranks whose quarters are the scores."""
    return percentile_ranks(base, {f"{name}_rank": value for name, value in _metrics().items()}, **limits)


def rfm_scores(base: DataFrame, *, task_values: int = TASK_VALUES) -> DataFrame:
    """Adds r_score, f_score, m_score; the returned plan is a map over the customer table."""
    values = {f"{name}_score": value for name, value in _metrics().items()}
    cuts = score_cuts(base, values, task_values=task_values)
    return base.withColumns(
        {
            name: quarter_score(value.cast("double"), cuts.get(name, []))
            for name, value in values.items()
        }
    )


def rfm(
    facts: DataFrame,
    customer_col: str = "customer_id",
    date_col: str = "order_date",
    amount_col: str = "unit_price",
    analysis_date: str | dt.date | dt.datetime | None = None,
    *,
    date_grain: str = "timestamp",
    amount_scale: int = AMOUNT_SCALE,
    partition_count: int | None = None,
    task_values: int = TASK_VALUES,
) -> DataFrame:
    """Every customer with a purchase: R, F, M, their scores and the segment."""
    base = rfm_base(
        facts,
        customer_col,
        date_col,
        amount_col,
        analysis_date,
        date_grain=date_grain,
        amount_scale=amount_scale,
        partition_count=partition_count,
    )
    return scored(base, task_values=task_values)


def scored(base: DataFrame, *, task_values: int = TASK_VALUES) -> DataFrame:
    """``rfm_base`` with its scores and segments."""
    return rfm_scores(base, task_values=task_values).withColumn(
        "segment", segment("r_score", "f_score", "m_score")
    )


def customer_buckets(
    facts: DataFrame, customer_col: str, buckets: int = CUSTOMER_BUCKETS
) -> DataFrame:
    """Customers and facts per hash bucket; facts are counted per customer before they move."""
    per_customer = facts.groupBy(customer_col).agg(F.count("*").alias("_facts"))
    return per_customer.groupBy(stable_bucket(customer_col, buckets).alias("bucket")).agg(
        F.count("*").alias("customers"), F.sum("_facts").alias("facts")
    )
