import json

import pytest
from pyspark.sql import functions as F

from basketlens import DataAnalyzer
from basketlens.operators import rfm, segments


def analyzer(spark, tmp_path, raw=None, precomputed=None):
    return DataAnalyzer(
        spark,
        str(tmp_path / "store"),
        None if raw is None else str(raw),
        None if precomputed is None else str(precomputed),
    )


def ages(df):
    return {r["customer_id"]: r["age"] for r in df.collect()}


def test_whole_analysis(spark, tmp_path, raw):
    a = analyzer(spark, tmp_path, raw)
    assert a.load_data() == {"transaction_rows": 4, "customer_rows": 3, "product_rows": 3}
    assert a.customers.columns == ["customer_id", "age", "club_member_status"]
    assert ages(a.customers)["customer-b"] is None
    assert a.transactions.columns == ["customer_id", "product_id", "order_date", "unit_price"]

    assert a.handle_missing_values("age", "club_member_status") == {
        "missing_before": 1,
        "missing_after": 0,
    }
    assert ages(a.customers) == {"customer-a": 25.0, "customer-b": 25.0, "customer-c": 45.0}
    assert a.handle_missing_values("age", "club_member_status") == {
        "missing_before": 0,
        "missing_after": 0,
    }

    features = {r["product_id"]: r for r in a.engineer_features().collect()}
    assert len(features) == 3
    assert features["0010000001"]["product_name_length"] == 8
    assert features["0010000001"]["image_mean"] == pytest.approx(51, abs=1)
    assert features["0010000003"]["image_mean"] is None

    assert a.detect_outliers()["outlier_count"] == 0
    scored = a.calculate_rfm()
    assert scored.count() == 3
    assert segments.segment_summary(scored).count() == 2

    eda = a.prepare_eda_artifacts()
    assert eda["price_statistics"]["count"] == 4
    assert eda["price_statistics"]["std"] == pytest.approx(0.170782512766)
    assert len(eda["histogram_edges"]) == 41 and sum(eda["histogram_counts"]) == 4
    assert eda["boxplot_before"]["whishi"] == 0.5 and eda["boxplot_after"]["label"] == "After IQR"
    assert eda["price_age_correlation"] == pytest.approx(0.878310, abs=1e-6)
    monthly = spark.read.parquet(eda["monthly_summary_path"])
    assert [tuple(r) for r in monthly.collect()] == [("2020-01", 1.1)]

    again = analyzer(spark, tmp_path)  # no raw data any more
    assert again.load_data()["transaction_rows"] == 4
    assert again.prepare_eda_artifacts()["histogram_counts"] == eda["histogram_counts"]
    assert again.calculate_rfm().count() == 3
    assert again.detect_outliers()["q1"] == pytest.approx(0.175)
    assert set(again.artifact_status.values()) == {"REUSED"}


def test_results_depend_on_their_parameters(spark, tmp_path, raw):
    a = analyzer(spark, tmp_path, raw)
    a.load_data()
    wide = a.detect_outliers(threshold=3.0)
    assert wide["upper_fence"] > a.detect_outliers()["upper_fence"]
    late = a.calculate_rfm(analysis_date="2021-01-01")
    assert late.agg({"recency": "min"}).first()[0] == 363
    assert a.calculate_rfm().agg({"recency": "min"}).first()[0] == 1


def test_force_computes_again(spark, tmp_path, raw):
    a = analyzer(spark, tmp_path, raw)
    a.load_data()
    a.load_data(force=True)
    assert set(a.artifact_status.values()) == {"COMPUTED"}


def test_steps_need_their_input(spark, tmp_path, raw):
    a = analyzer(spark, tmp_path, raw)
    with pytest.raises(ValueError, match="load_data before"):
        a.handle_missing_values("age", "club_member_status")
    with pytest.raises(ValueError, match="load_data before"):
        a.prepare_eda_artifacts()
    with pytest.raises(ValueError, match="load_data first"):
        a.detect_outliers()
    a.load_data()
    with pytest.raises(ValueError, match="handle_missing_values first"):
        a.prepare_eda_artifacts()
    with pytest.raises(ValueError, match="'median' or 'mean'"):
        a.handle_missing_values("age", "club_member_status", "mode")


def test_column_without_any_value(spark, tmp_path, raw):
    path = raw / "customers.csv"
    path.write_text(path.read_text().replace("25.0", "").replace("45.0", ""))
    a = analyzer(spark, tmp_path, raw)
    a.load_data()
    with pytest.raises(ValueError, match="could not impute all missing values"):
        a.handle_missing_values("age", "club_member_status")
    assert set(ages(a.customers).values()) == {None}


def test_rebuilding_needs_raw_data(spark, tmp_path):
    with pytest.raises(ValueError, match="no raw dataset"):
        analyzer(spark, tmp_path).engineer_features(force=True)


def test_features_are_reused_without_articles(spark, tmp_path):
    pre = tmp_path / "pre"
    pre.mkdir()
    (pre / "product_features.csv").write_text(
        "product_id,image_path,product_name_length,image_mean,image_std\n"
        "0010000001,images/001/0010000001.jpg,8,0.2,0.0\n"
    )
    a = analyzer(spark, tmp_path, precomputed=pre)
    assert a.engineer_features().first()["product_id"] == "0010000001"
    assert a.artifact_status["product_features"] == "REUSED"


def test_precomputed_iqr_must_match(spark, tmp_path, raw):
    pre = tmp_path / "pre" / "aggregates"
    pre.mkdir(parents=True)
    stored = {"column": "unit_price", "threshold": 1.5, "q1": 1.0, "q3": 2.0,
              "lower_fence": 0.0, "upper_fence": 3.0, "outlier_count": 9}
    (pre / "iqr_unit_price.json").write_text(json.dumps(stored, indent=2))
    a = analyzer(spark, tmp_path, raw, tmp_path / "pre")
    a.load_data()
    assert a.detect_outliers()["outlier_count"] == 9
    assert a.detect_outliers(threshold=3.0)["outlier_count"] == 0
    assert any("parameters do not match" in m for m in a.store.messages)


@pytest.mark.parametrize(
    "name, old, new, message",
    [
        ("transactions_train.csv", "2020-01-04,customer-c", "2020-01-04,customer-z", "unknown customer"),
        ("transactions_train.csv", "0010000003", "0010000009", "unknown article"),
        ("transactions_train.csv", "2020-01-04,customer-c", "2020-01-04,", "missing identifiers"),
        ("transactions_train.csv", "2020-01-04", "someday", "unparsable order_date"),
        ("customers.csv", "customer-b", "customer-a", "missing or duplicate customer_id"),
        ("articles.csv", "0010000002", "", "missing or duplicate product_id"),
        ("articles.csv", "prod_name", "name", "Missing columns"),
    ],
)
def test_faulty_raw_data_stores_nothing(spark, tmp_path, raw, name, old, new, message):
    path = raw / name
    path.write_text(path.read_text().replace(old, new))
    a = analyzer(spark, tmp_path, raw)
    with pytest.raises(ValueError, match=message):
        a.load_data()
    assert "transactions" not in a.artifact_status


def test_results_follow_new_raw_files(spark, raw, tmp_path):
    a = DataAnalyzer(spark, str(tmp_path / "store"), str(raw))
    a.load_data()
    assert a.calculate_rfm().count() == 3
    before = a.detect_outliers()
    (raw / "transactions_train.csv").write_text(
        "t_dat,customer_id,article_id,price,sales_channel_id\n"
        "20200105,customer-a,0010000001,5.0,1\n"
        "2020-01-06,customer-b,0010000001,7.0,1\n"
    )
    a.load_data(force=True)
    assert a.calculate_rfm().count() == 2
    assert a.detect_outliers() != before and a.detect_outliers()["q1"] == pytest.approx(5.5)


def test_filled_customers_are_loaded_again(spark, raw, tmp_path):
    a = DataAnalyzer(spark, str(tmp_path / "store"), str(raw))
    a.load_data()
    report = a.handle_missing_values("age", "club_member_status")
    assert report["missing_before"] == 1 and report["missing_after"] == 0
    b = DataAnalyzer(spark, str(tmp_path / "store"), str(raw))
    b.load_data()
    ages = {r["customer_id"]: r["age"] for r in b.customers.collect()}
    assert ages == {"customer-a": 25.0, "customer-b": 25.0, "customer-c": 45.0}
    b.prepare_eda_artifacts()
    b.store.prune()
    c = DataAnalyzer(spark, str(tmp_path / "store"), str(raw))
    c.load_data()
    assert c.customers.where("age is null").count() == 0
    assert len([p for p in (tmp_path / "store" / "customers").glob("*/*") if p.is_dir()]) == 1


def months(raw, names):
    """The facts file as a folder with a file per month."""
    whole = raw / "transactions_train.csv"
    if whole.is_file():
        whole.unlink()
    whole.mkdir(exist_ok=True)
    for name, lines in names.items():
        (whole / name).write_text("t_dat,customer_id,article_id,price,sales_channel_id\n" + "".join(f"{line}\n" for line in lines))


JANUARY = ["2020-01-01,customer-a,0010000001,0.1,1", "2020-01-02,customer-b,0010000002,0.2,1"]
FEBRUARY = ["2020-02-03,customer-a,0010000001,0.4,2", "2020-01-02,customer-b,0010000003,0.5,2"]


def test_new_raw_files_are_added(spark, tmp_path, raw, monkeypatch):
    months(raw, {"jan.csv": JANUARY})
    a = analyzer(spark, tmp_path, raw)
    assert a.load_data()["transaction_rows"] == 2
    first = {r["customer_id"]: r["monetary"] for r in a.calculate_rfm().collect()}
    assert first == {"customer-a": 0.1, "customer-b": 0.2}

    months(raw, {"feb.csv": FEBRUARY})
    read = []
    real = DataAnalyzer._read
    monkeypatch.setattr(DataAnalyzer, "_read", lambda self, name, files=None: read.append((name, files)) or real(self, name, files))
    b = analyzer(spark, tmp_path, raw)
    assert b.load_data()["transaction_rows"] == 2 and not read  # stored tables are used as they are
    assert b.load_data(refresh=True)["transaction_rows"] == 4
    assert [(n, [f.rsplit("/", 1)[-1] for f in files]) for n, files in read] == [("transactions_train.csv", ["feb.csv"])]
    assert b.artifact_status["transactions"] == "CONTINUED"
    visits = {(r["customer_id"], str(r["order_date"])[:10]): (r["facts"], float(r["amount"])) for r in b.visits().collect()}
    assert visits == {("customer-a", "2020-01-01"): (1, 0.1), ("customer-a", "2020-02-03"): (1, 0.4), ("customer-b", "2020-01-02"): (2, 0.7)}
    scored = {r["customer_id"]: (r["recency"], r["frequency"], r["monetary"]) for r in b.calculate_rfm().collect()}
    assert scored == {"customer-a": (1, 2, 0.5), "customer-b": (33, 1, 0.7)}

    assert b.load_data(refresh=True)["transaction_rows"] == 4 and len(read) == 1  # nothing new
    b.store.prune()
    assert analyzer(spark, tmp_path).load_data()["transaction_rows"] == 4  # what the newest version continues is kept
    months(raw, {"jan.csv": JANUARY[:1]})
    assert b.load_data(refresh=True)["transaction_rows"] == 3 and read[-1][1] is None  # a changed file: all are read again
    months(raw, {"mar.csv": ["2020-03-01,stranger,0010000001,0.4,2"]})
    with pytest.raises(ValueError, match="unknown"):
        b.load_data(refresh=True)
    assert analyzer(spark, tmp_path).load_data()["transaction_rows"] == 3


def test_stored_visits_are_grouped_without_a_shuffle(spark, tmp_path, raw):
    a = analyzer(spark, tmp_path, raw)
    a.load_data()
    for visited in (a.visits(), analyzer(spark, tmp_path, raw).visits()):
        plan = rfm.customers_of(visited)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
    days = rfm.merged_visits(a.visits().withColumn("order_date", F.to_date("order_date")))
    assert "Exchange" not in rfm.customers_of(days)._jdf.queryExecution().executedPlan().toString()
    assert sorted(a.calculate_rfm(date_grain="day").collect()) == sorted(a.calculate_rfm().collect())
