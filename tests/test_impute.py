import pytest
from pyspark.sql import functions as F

from basketlens.operators import impute, lookups, study
from basketlens.operators.lookups import attach, held


def customers(spark):
    rows = [
        ("a", "ACTIVE", 20.0),
        ("b", "ACTIVE", 30.0),
        ("c", "ACTIVE", None),
        ("d", None, 50.0),
        ("e", None, None),
        ("f", "NEW", None),
    ]
    return spark.createDataFrame(rows, "customer_id string, grp string, age double")


def filled(df):
    return {r["customer_id"]: r["age"] for r in df.collect()}


@pytest.mark.parametrize("strategy, fallback", [("median", 30.0), ("mean", 100 / 3)])
@pytest.mark.parametrize("max_broadcast_rows", [10_000, 1])
def test_fill_by_group_then_by_all(spark, strategy, fallback, max_broadcast_rows):
    df = impute.impute(
        customers(spark), "age", "grp", strategy, max_broadcast_rows=max_broadcast_rows
    )
    got = filled(df)
    assert got["c"] == 25.0  # its group
    assert got["e"] == 50.0  # the null group is a group
    assert got["f"] == pytest.approx(fallback)  # a group that knows nothing
    assert df.columns == ["customer_id", "grp", "age"]
    again = impute.impute(df, "age", "grp", strategy)
    assert filled(again) == got


@pytest.mark.parametrize("max_rows", [40, 10_000])
def test_hot_groups_are_not_shuffled(spark, max_rows):
    """A third of the facts is one group, some have no group, and one group is unknown."""
    facts = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .when(F.col("id") % 50 != 7, (F.col("id") % 50).cast("string"))
        .alias("g"),
        "id",
    )
    groups = facts.groupBy("g").agg(F.count("*").alias("n")).withColumn("twice", F.col("n") * 2)
    groups = groups.where("g <> '11' or g is null")
    lookup = held(groups, ["g"], max_rows)
    assert lookup.small == (max_rows > 40)
    joined = attach(facts, lookup, ["g"], ["twice"], "n", max_rows=max_rows)
    assert joined.columns == ["g", "id", "twice"]
    assert joined.count() == 4000 and joined.select("id").distinct().count() == 4000
    assert joined.where("g = 'hot'").agg(F.min("twice"), F.max("twice")).first() == (2668, 2668)
    assert joined.where("g = '11'").agg(F.count("twice"), F.count("id")).first()[0] == 0
    without = facts.where("g is null").count()
    assert joined.where("g is null").agg(F.min("twice"), F.count("id")).first() == (2 * without, without)


def test_many_groups(spark):
    got = filled(impute.impute(customers(spark), "age", "customer_id", "mean", max_broadcast_rows=2))
    assert got["a"] == 20.0 and got["c"] == pytest.approx(100 / 3)


def test_long_keys_are_not_small(spark, monkeypatch):
    monkeypatch.setattr(lookups, "BROADCAST_BYTES", 500)
    groups = spark.createDataFrame([("x" * 400, 1), ("y" * 400, 2), (None, 3)], "g string, n long")
    assert not held(groups, ["g"]).small
    assert held(groups.withColumn("g", F.left("g", F.lit(1))), ["g"]).small


def test_hot_rows_unknown_to_the_learnt_table_are_not_shuffled(spark):
    """Nine tenths of the rows to fill are one group that ``known`` has never seen."""
    df = spark.range(20_000, numPartitions=4).select(
        F.when(F.col("id") % 10 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("g"),
        F.when(F.col("id") % 10 == 0, F.col("id").cast("double")).alias("x"),
        F.spark_partition_id().alias("home"),
    )
    known = spark.range(0, 20_000, 10).select(F.col("id").cast("string").alias("g"), F.lit(5.0).alias("x"))
    got = impute.impute(df, "x", "g", "mean", known=known, max_broadcast_rows=10)
    assert got.count() == 20_000
    hot = got.where("g = 'hot'")
    assert hot.agg(F.min("x"), F.max("x")).first() == (5.0, 5.0)
    assert hot.where(F.spark_partition_id() % 4 != F.col("home")).count() == 0


def test_unknown_strategy(spark):
    with pytest.raises(ValueError, match="'median' or 'mean'"):
        impute.impute(customers(spark), "age", "grp", "mode")


def test_report(spark):
    df = customers(spark)
    row = impute.impute_report(df, impute.impute(df, "age", "grp"), "age").first()
    assert tuple(row) == (3, 0)


def test_profile_of_groups(spark):
    rows = [("a", v) for v in (1.0, 2.0, 3.0, 10.0)] + [("flat", 1.0)] * 3 + [("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r for r in study.group_profile(df, "x", "g").collect()}
    assert got["a"]["known"] == 4 and got["a"]["median"] == 2.5 and got["a"]["mean_median_gap"] == 1.5
    assert got["a"]["skewness"] == pytest.approx(1.763632614803888)
    assert got["flat"]["skewness"] is None and got["two"]["skewness"] is None


def test_split_keeps_every_known_row_once(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 10 > 0, 1.0).alias("x"))
    train, test = study.holdout_split(df, "id", "x")
    assert train.count() + test.count() == 900
    assert train.join(test, "id").count() == 0
    assert 0.1 < test.count() / 900 < 0.3


def test_policy_and_coverage(spark):
    df = customers(spark)
    coverage = study.group_coverage(df, "age", {"grp": ["grp"]}).first()
    assert coverage["missing_rows"] == 3
    assert coverage["coverage_pct"] == pytest.approx(200 / 3)
    policy = {r["grp"]: r["policy"] for r in study.group_policy(df, "customer_id", "age", "grp").collect()}
    assert policy["NEW"] == "global median"
