import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketlens.functions.columns import stable_bucket, whole_days_between
from basketlens.functions.scoring import segment
from basketlens.operators import ranks, rfm, segments


def facts(spark, rows):
    return spark.createDataFrame(rows, "customer_id string, order_date string, unit_price double")


def scores(spark, values, **kw):
    base = spark.createDataFrame(
        [(str(i), 1, 1, float(v)) for i, v in enumerate(values)],
        "customer_id string, recency long, frequency long, monetary double",
    )
    rows = rfm.rfm_scores(base, **kw).orderBy(F.col("customer_id").cast("int")).collect()
    return [r["m_score"] for r in rows]


def pandas_scores(values):
    if len(values) == 1:
        return [4]
    ranked = pd.Series(values).rank(method="average", pct=True)
    return [int(np.searchsorted([0.25, 0.5, 0.75], x, side="left")) + 1 for x in ranked]


def test_single_value_scores_best_and_ties_share_a_score(spark):
    assert scores(spark, [10]) == [4]
    assert scores(spark, [10, 10, 20, 30]) == [2, 2, 3, 4]


@pytest.mark.parametrize("n", [2, 3, 4, 5, 7, 8, 101, 1000])
def test_scores_equal_percentile_ranks(spark, n):
    rng = np.random.default_rng(n)
    values = rng.integers(0, max(2, n // 3), size=n)
    assert scores(spark, values) == pandas_scores(values)


def test_scores_of_many_customers_use_narrowed_ranks(spark):
    rng = np.random.default_rng(1)
    values = np.where(np.arange(4000) % 3 == 0, 7.0, rng.exponential(5, size=4000).round(3))
    assert scores(spark, values, task_values=1000) == pandas_scores(values)


def test_customer_metrics(spark):
    df = facts(spark, [("A", "2020-01-01", 10.0), ("A", "2020-01-01", 20.0), ("A", "2020-01-10", 30.0)])
    row = rfm.rfm_base(df, analysis_date="2020-01-11").first()
    assert (row["recency"], row["frequency"], row["monetary"]) == (1, 2, 60.0)


def test_miniature_dataset(spark):
    df = facts(
        spark,
        [
            ("customer-a", "2020-01-01", 0.1),
            ("customer-a", "2020-01-02", 0.2),
            ("customer-b", "2020-01-03", 0.3),
            ("customer-c", "2020-01-04", 0.5),
        ],
    )
    got = {r["customer_id"]: tuple(r)[1:] for r in rfm.rfm(df).collect()}
    assert got == {
        "customer-a": (3, 2, 0.3, 2, 4, 2, "Potential"),
        "customer-b": (2, 1, 0.3, 3, 2, 2, "Potential"),
        "customer-c": (1, 1, 0.5, 4, 2, 4, "New"),
    }


def test_partition_count_does_not_change_the_result(spark):
    rows = [(f"c{i % 7}", f"2020-01-{i % 28 + 1:02d}", float(i)) for i in range(100)]
    one = sorted(map(tuple, rfm.rfm(facts(spark, rows)).collect()))
    two = sorted(map(tuple, rfm.rfm(facts(spark, rows), partition_count=3).collect()))
    assert one == two


def test_other_column_names(spark):
    df = facts(spark, [("A", "2020-01-01", 1.0)]).toDF("who", "at", "paid")
    row = rfm.rfm(df, "who", "at", "paid").first()
    assert row["who"] == "A" and row["segment"] == "VIP"


def test_amounts_all_missing_count_as_zero(spark):
    df = facts(spark, [("A", "2020-01-01", None), ("B", "2020-01-02", 2.0)])
    got = {r["customer_id"]: r["monetary"] for r in rfm.rfm_base(df).collect()}
    assert got == {"A": 0.0, "B": 2.0}


def test_recency_is_rounded_down_and_may_be_negative(spark):
    at = dt.datetime
    rows = [
        (at(2020, 1, 1, 18), at(2020, 1, 2), 0),
        (at(2020, 1, 1), at(2020, 1, 2), 1),
        (at(2020, 1, 2, 6), at(2020, 1, 2), -1),
        (at(2020, 1, 5), at(2020, 1, 2), -3),
    ]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz, want long")
    for row in df.withColumn("got", whole_days_between(F.col("a"), F.col("b"))).collect():
        assert row["got"] == row["want"]


def test_day_grain_counts_days(spark):
    df = facts(spark, [("A", "2020-01-01 10:00:00", 1.0), ("A", "2020-01-01 18:00:00", 1.0)])
    assert rfm.rfm_base(df).first()["frequency"] == 2
    by_day = rfm.rfm_base(df, date_grain="day").first()
    assert (by_day["frequency"], by_day["recency"]) == (1, 1)
    with pytest.raises(ValueError, match="date_grain"):
        rfm.rfm_base(df, date_grain="week")


def test_empty_facts_are_an_error(spark):
    with pytest.raises(ValueError, match="empty transaction table"):
        rfm.rfm(facts(spark, []))
    with pytest.raises(ValueError, match="no transaction has a date"):
        rfm.rfm(facts(spark, [("a", None, 1.0)]))


@pytest.mark.parametrize(
    "triple, name",
    [
        ((4, 4, 4), "VIP"),
        ((4, 3, 1), "Loyal"),
        ((4, 1, 2), "New"),
        ((1, 4, 4), "Churned"),
        ((2, 2, 2), "Potential"),
    ],
)
def test_segment_rules(spark, triple, name):
    assert spark.range(1).select(segment(*map(F.lit, triple)).alias("s")).first()["s"] == name


def test_one_customer_is_in_one_bucket(spark):
    df = facts(spark, [("a", "2020-01-01", 1.0), ("b", "2020-01-01", 1.0), ("a", "2020-01-02", 1.0)])
    placed = df.select("customer_id", stable_bucket("customer_id", 3).alias("b")).distinct()
    assert placed.where("customer_id = 'a'").count() == 1
    counts = rfm.customer_buckets(df, "customer_id", 3).agg(F.sum("customers"), F.sum("facts")).first()
    assert tuple(counts) == (2, 3)


def test_hot_customer(spark):
    """One customer has most of the facts; its partial sums must add up exactly."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("customer_id"),
        F.date_add(F.lit("2020-01-01"), (F.col("id") % 400).cast("int")).alias("order_date"),
        F.lit(0.1).alias("unit_price"),
    )
    hot = rfm.rfm_base(df).where("customer_id = 'hot'").first()
    assert hot["monetary"] == 2000.0 and hot["frequency"] == 400


def test_summary_and_insights(spark):
    rows = [
        ("a", 1, 3, 30.0, "VIP"),
        ("b", 3, 5, 50.0, "VIP"),
        ("c", 9, 1, 20.0, "Churned"),
    ]
    df = spark.createDataFrame(
        rows, "customer_id string, recency long, frequency long, monetary double, segment string"
    )
    summary = segments.segment_summary(df)
    vip, churned = summary.collect()
    assert vip["segment"] == "VIP" and vip["customers"] == 2
    assert vip["monetary_share_pct"] == pytest.approx(80.0)
    assert churned["customer_share_pct"] == pytest.approx(100 / 3)
    insights = {(r["segment"], r["metric"]): r["value"] for r in segments.insight_metrics(summary).collect()}
    assert len(insights) == 9
    assert insights["Churned", "mean_recency"] == 9.0
    assert insights["Loyal", "customer_share_pct"] == 0.0
    assert segments.largest_segment(df).first()["segment"] == "VIP"
    free = segments.segment_summary(df.withColumn("monetary", F.lit(0.0))).first()
    assert free["monetary_share_pct"] == 0.0
    with pytest.raises(ValueError, match="Missing columns"):
        segments.segment_summary(df.drop("segment"))


def test_customers_without_a_date_are_an_error(spark):
    facts = spark.createDataFrame([("a", "2020-01-01", 1.0), ("y", None, 2.0), ("z", None, 9.0)], "customer_id string, order_date string, unit_price double")
    with pytest.raises(ValueError, match="2 customers have no transaction with a date"):
        rfm.rfm(facts)


def test_a_missing_value_has_no_score(spark):
    from basketlens.functions.scoring import Cut, quarter_score

    df = spark.createDataFrame([(None,), (1.0,), (9.0,)], "x double")
    got = df.select(quarter_score(F.col("x"), [Cut(2.0, True), None, None]).alias("s"), quarter_score(F.col("x"), []).alias("t")).collect()
    assert [tuple(r) for r in got] == [(None, None), (1, 4), (4, 4)]


@pytest.mark.parametrize("amount", [float("inf"), float("-inf"), 1e17])
def test_an_amount_that_cannot_be_added_is_an_error(spark, amount):
    facts = spark.createDataFrame([("a", "2020-01-01", amount)], "customer_id string, order_date string, unit_price double")
    with pytest.raises(Exception, match="cannot be added exactly"):
        rfm.purchases_per_customer(facts).collect()


@pytest.mark.parametrize("limits", [{}, {"range_values": 40, "max_broadcast_rows": 5}])
def test_percentile_ranks_equal_pandas(spark, limits):
    """A third of the rows are tied; the rest is dealt over several ranges."""
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"k": range(900), "x": np.where(np.arange(900) % 3 == 0, 1.5, rng.normal(size=900).round(2)), "y": rng.integers(0, 6, 900)})
    frame.loc[::50, "x"] = np.nan
    df = spark.createDataFrame(frame, "k long, x double, y int")
    got = ranks.percentile_ranks(df, {"x_rank": F.col("x"), "y_rank": -F.col("y")}, **limits).orderBy("k").toPandas()
    np.testing.assert_allclose(got["x_rank"], frame.x.rank(pct=True), rtol=1e-12)
    np.testing.assert_allclose(got["y_rank"], (-frame.y).rank(pct=True), rtol=1e-12)
    assert list(got.columns) == ["k", "x", "y", "x_rank", "y_rank"]


def test_ranks_need_no_window_over_all_rows(spark):
    df = spark.range(5000).select((F.col("id") % 701).alias("x"))
    plan = ranks.value_ranks(df, "x", range_values=100)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" in plan
    empty = ranks.percentile_ranks(df.where("x < 0"), {"r": F.col("x")})
    assert empty.columns == ["x", "r"] and empty.count() == 0
