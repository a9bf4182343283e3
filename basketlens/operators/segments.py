"""Summaries of scored customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.contracts import INSIGHT_METRICS
from basketlens.functions.columns import correlation, money
from basketlens.operators.quality import require_columns
from basketlens.operators.rfm import AMOUNT_SCALE


def segment_summary(rfm: DataFrame, customer_col: str = "customer_id") -> DataFrame:
    """Customers, mean R/F/M and the share of customers and of money, largest segment first."""
    require_columns(rfm, (customer_col, "recency", "frequency", "monetary", "segment"))
    per_segment = rfm.groupBy("segment").agg(
        F.count("*").alias("customers"),
        F.avg("recency").alias("mean_recency"),
        F.avg("frequency").alias("mean_frequency"),
        # Exact, so that the total does not depend on the order of the customers.
        F.sum(money("monetary", AMOUNT_SCALE)).cast("double").alias("monetary_total"),
    )
    everything = Window.partitionBy()  # at most five rows are left here
    money_total = F.sum("monetary_total").over(everything)
    return per_segment.select(
        "segment",
        "customers",
        "mean_recency",
        "mean_frequency",
        (F.col("monetary_total") / F.col("customers")).alias("mean_monetary"),
        "monetary_total",
        (F.col("customers") / F.sum("customers").over(everything) * 100).alias("customer_share_pct"),
        F.when(money_total == 0, 0.0)
        .otherwise(F.try_divide(F.col("monetary_total"), money_total) * 100)
        .alias("monetary_share_pct"),
    ).orderBy(F.desc("customers"), "segment")


def segment_counts(rfm: DataFrame) -> DataFrame:
    return rfm.groupBy("segment").agg(F.count("*").alias("customers")).orderBy("segment")


def largest_segment(rfm: DataFrame) -> DataFrame:
    """The first name wins when two segments are equally large."""
    counts = rfm.groupBy("segment").agg(F.count("*").alias("customers"))
    return counts.orderBy(F.desc("customers"), "segment").limit(1)


def insight_metrics(summary: DataFrame) -> DataFrame:
    """The insight numbers as (segment, metric, value); a segment nobody is in counts as 0."""
    wanted = summary.sparkSession.createDataFrame(
        [(s, m) for s, metrics in INSIGHT_METRICS.items() for m in metrics],
        "segment string, metric string",
    )
    names = sorted({m for metrics in INSIGHT_METRICS.values() for m in metrics})
    values = summary.unpivot("segment", names, "metric", "value")
    return wanted.join(values, ["segment", "metric"], "left").select(
        "segment", "metric", F.coalesce("value", F.lit(0.0)).alias("value")
    )


def frequency_monetary_correlation(rfm: DataFrame) -> DataFrame:
    return rfm.agg(correlation("frequency", "monetary").alias("correlation"))


def frequency_monetary_bins(rfm: DataFrame, bins: int) -> DataFrame:
    """Counted grid behind a frequency/monetary scatter: its size is bins x bins at most."""
    edge = rfm.agg(
        F.min("frequency"), F.max("frequency"), F.min("monetary"), F.max("monetary")
    ).first()

    def cell(c: str, lo: float, hi: float):
        if lo == hi:
            return F.lit(0)
        share = (F.col(c) - F.lit(lo)) / (F.lit(hi) - F.lit(lo))
        return F.least(F.lit(bins - 1), F.floor(share * bins).cast("int"))

    return (
        rfm.select(
            cell("frequency", edge[0], edge[1]).alias("frequency_bin"),
            cell("monetary", edge[2], edge[3]).alias("monetary_bin"),
        )
        .groupBy("frequency_bin", "monetary_bin")
        .agg(F.count("*").alias("customers"))
    )
