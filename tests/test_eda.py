import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketlens.functions.columns import correlation
from basketlens.operators import cells, eda, outliers


def column(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x double")


def test_iqr_statistics(spark):
    row = outliers.iqr_statistics(column(spark, [1, 2, 3, 4, 100]), "x").first()
    assert row.asDict() == {
        "column": "x",
        "threshold": 1.5,
        "q1": 2.0,
        "q3": 4.0,
        "lower_fence": -1.0,
        "upper_fence": 7.0,
        "outlier_count": 1,
    }


def test_missing_values_are_ignored_and_nothing_is_an_error(spark):
    df = spark.createDataFrame([(None,), (1.0,), (3.0,)], "x double")
    assert outliers.fences(df, "x").median == 2.0
    with pytest.raises(ValueError, match="no values"):
        outliers.fences(df.where("x is null"), "x")


def test_whiskers_are_observed_values(spark):
    row = eda.boxplot_before(column(spark, [1, 2, 3, 4, 100]), "x").first()
    assert (row["whislo"], row["whishi"], row["med"]) == (1.0, 4.0, 3.0)
    after = eda.boxplot_after(column(spark, [1, 2, 3, 4, 100]), "x").first()
    assert (after["q1"], after["med"], after["q3"]) == (1.75, 2.5, 3.25)


def test_fences_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    column(spark, [1, 2, 3, 4, 100]).write.parquet(path)
    df = spark.read.parquet(path)
    outside = df.where(outliers.fences(df, "x").outside("x"))
    plan = outside._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(LessThan(x,-1.0),GreaterThan(x,7.0))]" in plan


def test_numeric_summary(spark):
    row = eda.numeric_summary(column(spark, [0.1, 0.2, 0.3, 0.5]), "x").first()
    want = {
        "count": 4,
        "mean": 0.275,
        "median": 0.25,
        "std": 0.17078251276599332,
        "q1": 0.175,
        "q3": 0.35,
        "min": 0.1,
        "max": 0.5,
    }
    assert row.asDict() == pytest.approx(want)
    assert eda.numeric_summary(column(spark, [3]), "x").first()["std"] == 0.0
    with pytest.raises(Exception, match="at least one value"):
        eda.numeric_summary(column(spark, []), "x").first()


def test_miniature_histogram(spark):
    rows = eda.histogram(column(spark, [0.1, 0.2, 0.3, 0.5]), "x").collect()
    assert len(rows) == 40
    assert {r["bin"]: r["count"] for r in rows if r["count"]} == {0: 1, 10: 1, 19: 1, 39: 1}


@settings(
    max_examples=25,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(
    st.lists(
        st.one_of(
            st.integers(-20, 20).map(lambda i: i / 10),
            st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False).map(lambda x: round(x, 3)),
        ),
        min_size=1,
        max_size=40,
    )
)
def test_histogram_equals_numpy(spark, values):
    counts, edges = np.histogram(values, bins=40)
    rows = sorted(eda.histogram(column(spark, values), "x").collect())
    assert [r["count"] for r in rows] == counts.tolist()
    assert [r["left_edge"] for r in rows] + [rows[-1]["right_edge"]] == edges.tolist()


def test_constant_column(spark):
    rows = eda.histogram(column(spark, [5, 5]), "x").orderBy("bin").collect()
    assert rows[0]["left_edge"] == 4.5 and rows[-1]["right_edge"] == 5.5
    assert rows[20]["count"] == 2
    with pytest.raises(ValueError, match="no values"):
        eda.histogram(column(spark, []), "x")


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 9.0)], "a double, b double")
    assert df.agg(correlation("a", "b").alias("r")).first()["r"] is None


def test_fact_correlation(spark):
    rng = np.random.default_rng(5)
    n = 2000
    # Large offsets would cancel all digits of raw sums of squares.
    facts = pd.DataFrame(
        {"k": np.where(rng.random(n) < 0.5, 0, rng.integers(1, 50, n)), "x": 1e8 + rng.normal(size=n)}
    )
    lookup = pd.DataFrame({"k": np.arange(45), "y": 1e7 + rng.normal(size=45)})
    facts["x"] += 0.3 * (lookup.y.reindex(facts.k).fillna(1e7).to_numpy() - 1e7)
    joined = facts.merge(lookup, on="k")
    got = eda.fact_correlation(
        spark.createDataFrame(facts), "k", "x", spark.createDataFrame(lookup), "k", "y"
    ).first()["correlation"]
    assert got == pytest.approx(np.corrcoef(joined.x, joined.y)[0, 1], abs=1e-6)


def test_fact_correlation_without_spread_is_zero(spark):
    facts = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "k string, x double")
    flat = spark.createDataFrame([("a", 0.1), ("b", 0.1), ("c", 0.1)], "k string, y double")
    assert eda.fact_correlation(facts, "k", "x", flat, "k", "y").first()[0] == 0.0
    unknown = flat.where("k = 'z'")
    assert eda.fact_correlation(facts, "k", "x", unknown, "k", "y").first()[0] == 0.0
    other = spark.createDataFrame([("z", 1.0)], "k string, y double")
    assert eda.fact_correlation(facts, "k", "x", other, "k", "y").first()[0] == 0.0


def test_miniature_price_age(spark):
    facts = spark.createDataFrame(
        [("a", 0.1), ("a", 0.2), ("b", 0.3), ("c", 0.5)], "k string, x double"
    )
    ages = spark.createDataFrame([("a", 25.0), ("b", 25.0), ("c", 45.0)], "k string, y double")
    got = eda.fact_correlation(facts, "k", "x", ages, "k", "y").first()[0]
    assert got == pytest.approx(0.878310, abs=1e-6)


def test_matrix_and_strongest_pair(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame(rng.normal(size=(200, 3)), columns=["a", "b", "c"])
    frame["c"] -= 2 * frame["a"]
    matrix = eda.correlation_matrix(spark.createDataFrame(frame), ["a", "b", "c"])
    want = frame.corr()
    for row in matrix.collect():
        assert row["correlation"] == pytest.approx(want.loc[row["feature_a"], row["feature_b"]])
    best = eda.strongest_pair(matrix, ["a", "b", "c"]).first()
    assert (best["feature_a"], best["feature_b"]) == ("a", "c")


def test_monthly_totals_and_peak(spark):
    rows = [("2020-01-01", 0.1), ("2020-01-31", 1.0), ("2020-03-01", 1.1), (None, 9.0)]
    df = spark.createDataFrame(rows, "order_date string, unit_price double")
    monthly = eda.monthly_totals(df)
    assert [tuple(r) for r in monthly.collect()] == [("2020-01", 1.1), ("2020-03", 1.1)]
    assert eda.peak_month(monthly).first()["order_month"] == "2020-01"


def test_labels(spark):
    row = spark.range(1).select(
        eda.strength_label(F.lit(-0.09)).alias("a"),
        eda.strength_label(F.lit(-0.1)).alias("b"),
        eda.tail_label(F.lit(2.0), F.lit(1.0)).alias("c"),
    ).first()
    assert row["a"].startswith("very weak") and row["b"].startswith("weak")
    assert row["c"] == "right tail possible"


def test_large_columns_take_the_narrowed_path(spark):
    values = np.random.default_rng(9).exponential(size=5000).round(3)
    df = column(spark, values)
    whole = eda.numeric_summary(df, "x").first().asDict()
    narrowed = eda.numeric_summary(df, "x", task_values=500).first().asDict()
    assert whole == pytest.approx(narrowed) and not math.isnan(whole["std"])


def test_fact_correlation_ignores_unused_keys_and_outliers(spark):
    """Keys near 1e9, one attribute that no fact uses, one far fact; the same in every order of the rows."""
    rng = np.random.default_rng(8)
    x = 1e9 + rng.normal(size=500)
    facts = [(i % 100, float(v)) for i, v in enumerate(x)] + [(3, -1e6)]
    ages = [(k, 1e9 + k) for k in range(100)] + [(999, 0.0)]
    want = np.corrcoef([v for _, v in facts], [1e9 + k for k, _ in facts])[0, 1]
    lookup = spark.createDataFrame(ages, "id long, y double")
    for seed in range(3):
        order = np.random.default_rng(seed).permutation(len(facts))
        df = spark.createDataFrame([facts[i] for i in order], "k long, x double").repartition(seed + 1)
        got = eda.fact_correlation(df, "k", "x", lookup, "id", "y").first()[0]
        assert got == pytest.approx(want, abs=1e-9)


def test_fact_correlation_with_an_unused_far_key(spark):
    n = 1999
    facts = spark.createDataFrame([(k, 1e9 + k) for k in range(n)], "k long, x double")
    lookup = spark.createDataFrame([(k, 1e9 + k) for k in range(n)] + [(-1, 0.0)], "id long, y double")
    assert eda.fact_correlation(facts, "k", "x", lookup, "id", "y").first()[0] == pytest.approx(1.0, abs=1e-9)


def sales(spark, n=30_000):
    key = F.col("id")
    return spark.range(n).select(
        F.when(key % 3 == 0, F.lit(1)).otherwise(key % 500).alias("who"),
        F.date_add(F.lit("2020-01-15").cast("date"), (key % 400).cast("int")).alias("day"),
        F.round(F.exp(F.randn(7)) * 20, 2).alias("paid"),
    )


@pytest.mark.parametrize("task_values, most_passes", [(200_000, 3), (2_000, 4)])
def test_description_shares_its_passes(spark, monkeypatch, task_values, most_passes):
    """Summary, histogram, both boxplots, months and keys from three passes over the facts."""
    facts = sales(spark).persist()
    passes = []
    real = cells.split

    def counted(*args):
        passes.append(1)
        return real(*args)

    monkeypatch.setattr(cells, "split", counted)
    monkeypatch.setattr(eda, "split", counted)
    got = eda.describe(facts, "paid", "day", "who", amount_scale=2, task_values=task_values)
    assert 1 + len(passes) <= most_passes
    assert got.summary == eda.numeric_summary(facts, "paid").first().asDict()
    assert got.before == eda.boxplot_before(facts, "paid").first().asDict()
    assert got.after == eda.boxplot_after(facts, "paid").first().asDict()
    paid = np.array([r[0] for r in facts.select("paid").collect()])
    q1, q3 = np.quantile(paid, [0.25, 0.75])
    kept = paid[(paid >= q1 - 1.5 * (q3 - q1)) & (paid <= q3 + 1.5 * (q3 - q1))]
    np.testing.assert_allclose([got.after[k] for k in ("q1", "med", "q3")], np.quantile(kept, [0.25, 0.5, 0.75]), rtol=1e-12)
    bars = eda.histogram(facts, "paid").orderBy("bin").collect()
    assert got.histogram_counts == [b["count"] for b in bars] and got.histogram_edges[:-1] == [b["left_edge"] for b in bars]
    assert got.per_month.collect() == eda.monthly_totals(facts, "day", "paid", amount_scale=2).collect()
    ages = spark.range(450).select(F.col("id").alias("k"), (F.col("id") * 7 % 61).alias("age"))
    direct = eda.fact_correlation(facts, "who", "paid", ages, "k", "age").first()[0]
    assert eda.key_correlations(got.per_key, ages, "k", ["age"]).first()["correlation"] == pytest.approx(direct, rel=1e-9)


def test_many_attributes_in_one_pass(spark):
    facts = sales(spark, 3000)
    lookup = spark.range(400).select(
        F.col("id").alias("k"),
        (F.col("id") % 17).alias("a"),
        F.when(F.col("id") % 5 > 0, F.sin(F.col("id"))).alias("b"),
        F.lit(3).alias("flat"),
        F.lit(None).cast("double").alias("none"),
    )
    lookup = lookup.unionByName(lookup.where("k = 7").withColumn("a", F.lit(900)))  # of two rows the smaller value counts
    rows = {r["attribute"]: r for r in eda.fact_correlations(facts, "who", "paid", lookup, "k", ["a", "b", "flat", "none"]).collect()}
    joined = facts.join(lookup.where("a < 900"), facts["who"] == lookup["k"])
    for name in ("a", "b"):
        want = joined.where(F.col(name).isNotNull()).agg(F.corr("paid", F.col(name).cast("double")), F.count("*")).first()
        assert (rows[name]["correlation"], rows[name]["facts"]) == (pytest.approx(want[0], rel=1e-9), want[1])
    assert rows["a"]["keys"] == 400 and rows["b"]["keys"] == 320
    assert rows["flat"]["correlation"] == rows["none"]["correlation"] == 0.0 and rows["none"]["facts"] == 0
