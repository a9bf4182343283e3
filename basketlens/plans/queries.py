"""The registered queries: every operator on the given tables, under one name each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.contracts import TableContract
from basketlens.operators import (
    eda,
    features,
    impute,
    load,
    outliers,
    quality,
    rfm,
    segments,
    study,
)
from basketlens.plans import views
from basketlens.sources.buckets import default_buckets, write_bucketed
from basketlens.sources.packed import decoding_report, read_packed
from basketlens.sources.scratch import reserve

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MONEY_SCALE = 2  # the given amounts are in cents
FEATURES = ("image_mean", "image_std", "product_name_length")
HOLDOUT = {
    "global median": ((), "median"),
    "lang median": (("lang",), "median"),
    "source median": (("source",), "median"),
    "lang and source median": (("lang", "source"), "median"),
}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Engines differ in the last bits of a double; results are compared rounded."""
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({name: F.round(name, digits) for name in doubles})


def _rfm(facts: DataFrame, **kw) -> DataFrame:
    return rfm.rfm(facts, amount_scale=MONEY_SCALE, **kw)


# Loading ------------------------------------------------------------------------------


@query
def normalize_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("age"),
        F.when(F.col("c_custkey") % 13 == 0, F.lit("n/a"))
        .when(F.col("c_custkey") % 17 == 0, F.lit("NONE"))
        .otherwise(F.col("c_mktsegment"))
        .alias("club_member_status"),
        F.col("c_name").alias("fashion_news_frequency"),
    )
    return load.normalize_customers(raw)


@query
def normalize_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load.normalize_articles(views.raw_articles(spark, sf_dir))


@query
def normalize_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.tx_line(spark, sf_dir).select(
        F.date_format(F.col("order_date").cast("date"), "yyyy-MM-dd").alias("t_dat"),
        "customer_id",
        F.col("product_id").alias("article_id"),
        F.col("unit_price").cast("string").alias("price"),
    )
    return load.normalize_transactions(raw)


@query
def na_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts by row number over a real column; NONE, Null and a blank stay texts."""
    texts = ["NA", "None", "NONE", "", "null", "Null", "nan", "#N/A N/A", "-1.#IND", " "]
    key = F.col("p_partkey")
    cell = F.get(F.lit(texts), F.pmod(key, F.lit(20)).cast("int"))
    return load.normalize_nulls(
        views.table(spark, sf_dir, "part").select(
            "p_partkey",
            F.coalesce(cell, F.col("p_brand")).alias("brand"),
            F.when(key % 9 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice")).alias("price"),
        )
    )


@query
def load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load.load_summary(
        views.table(spark, sf_dir, "lineitem"),
        views.table(spark, sf_dir, "customer"),
        views.table(spark, sf_dir, "part"),
    )


@query
def dataset_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = load.normalize_articles(views.raw_articles(spark, sf_dir))
    stats = features.array_stats(views.vec(spark, sf_dir), "product_id", "embedding")
    return load.dataset_inventory(
        [
            ("transactions", "one order line", "rfm and time series", views.tx_line(spark, sf_dir)),
            ("customers", "one customer", "attributes", views.cust_gap(spark, sf_dir)),
            ("articles", "one product", "text", articles),
            (
                "product_features",
                "one product",
                "text and array statistics",
                features.product_features(articles, stats, "product_id"),
            ),
        ]
    )


@query
def masked_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load.masked_preview(views.tx_line(spark, sf_dir))


@query
def preview_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.table(spark, sf_dir, "lineitem")
    return rounded(
        eda.column_profile(lines, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), 4
    )


# Checks -------------------------------------------------------------------------------


@query
def dq_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    def stored(name: str) -> DataFrame:
        return views.table(spark, sf_dir, name)

    return quality.contract_report(
        [
            (stored("orders"), TableContract("orders", ("o_orderkey", "o_custkey", "o_totalprice"))),
            (stored("customer"), TableContract("customer", ("c_custkey", "age", "club_member_status"))),
            (stored("part"), TableContract("part", ("p_partkey", "p_name"), ("p_type", "p_container"))),
            (
                stored("events").where(F.col("event_type") == "no such event"),
                TableContract("events", ("event_id", "ts")),
            ),
        ]
    )


@query
def dq_dimension_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer names cut short, so that keys repeat, and some left out."""
    customers = views.table(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 23 != 0, F.substring("c_name", 10, 8)).alias("customer_id")
    )
    return quality.dimension_key_report(customers, "customer_id")


@query
def dq_unparsable(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = load.selected(views.raw_transactions(spark, sf_dir), load.TRANSACTION_COLUMNS)
    return quality.unparsable_report(raw, load.TRANSACTION_TYPES)


@query
def dq_missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = load.selected(views.raw_transactions(spark, sf_dir), load.TRANSACTION_COLUMNS)
    return quality.missing_id_report(raw, ("customer_id", "product_id"))


@query
def dq_unknown_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.unknown_keys(
        views.tx_order(spark, sf_dir), "customer_id", views.cust_part(spark, sf_dir), "c_custkey"
    )


@query
def dq_unknown_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("product_id"))
    return quality.unknown_keys(
        lines, "product_id", views.table(spark, sf_dir, "embeddings"), "vec_id"
    )


# Imputation ---------------------------------------------------------------------------


@query
def impute_group_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(impute.impute(views.cust_gap(spark, sf_dir), "x", "grp", "median"))


@query
def impute_group_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(impute.impute(views.cust_gap(spark, sf_dir), "x", "grp", "mean"), 4)


@query
def impute_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = views.cust_gap(spark, sf_dir)
    return impute.impute_report(gap, impute.impute(gap, "x", "grp", "median"), "x")


@query
def missing_rate_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        study.missing_rates(views.doc_gap(spark, sf_dir), ["lang", "source", "quality", "toxic"])
    )


@query
def group_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(study.group_profile(views.cust_gap(spark, sf_dir), "x", "grp"), 4)


@query
def holdout_imputer_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").withColumn("n", F.col("n_chars").cast("double"))
    errors = study.holdout_errors(docs, "doc_id", "n", HOLDOUT)
    return rounded(study.with_improvement(errors, "global median"), 4)


@query
def holdout_mean_vs_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = views.table(spark, sf_dir, "customer")
    return rounded(
        study.holdout_errors(
            customers,
            "c_custkey",
            "c_acctbal",
            {
                "group mean": (("c_mktsegment",), "mean"),
                "group median": (("c_mktsegment",), "median"),
            },
        ),
        4,
    )


@query
def impute_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    docs = views.doc_gap(spark, sf_dir).withColumns(
        {
            "lang": F.when(key % 5 != 0, F.col("lang")),
            "source": F.when(key % 7 != 0, F.col("source")),
        }
    )
    return rounded(
        study.group_coverage(
            docs,
            "quality",
            {"lang": ["lang"], "source": ["source"], "lang and source": ["lang", "source"]},
        )
    )


@query
def group_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        study.group_policy(views.cust_gap(spark, sf_dir), "customer_id", "x", "grp")
    )


# Product features ---------------------------------------------------------------------


@query
def product_name_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = load.normalize_articles(views.raw_articles(spark, sf_dir))
    return features.text_features(articles).select("product_id", "product_name_length")


@query
def image_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.image_stats(views.image_frames(spark, sf_dir), "vec_id"))


@query
def packed_image_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel statistics of image files that are packed into a table; those that cannot be decoded have none."""
    images = read_packed(views.packed_images(spark, sf_dir), "vec_id")
    return rounded(features.image_stats(images, "image_path").withColumnRenamed("image_path", "vec_id"))


@query
def packed_image_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_packed(views.packed_images(spark, sf_dir), "vec_id")
    # Whether a worker has a JPEG decoder or not, these bytes are only the start of one.
    jpeg = F.when(F.col("image.reason").isin("no JPEG decoder", "JPEG"), F.lit("JPEG")).otherwise(F.col("image.reason"))
    return decoding_report(found.withColumn("image", F.col("image").withField("reason", jpeg)))


@query
def array_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.array_stats(views.vec(spark, sf_dir), "product_id", "embedding"))


def _product_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = load.normalize_articles(views.raw_articles(spark, sf_dir))
    stats = features.array_stats(views.vec(spark, sf_dir), "product_id", "embedding")
    return features.product_features(articles, stats, "product_id")


@query
def product_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_product_features(spark, sf_dir))


# Outliers -----------------------------------------------------------------------------


@query
def iqr_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(outliers.iqr_statistics(views.tx_event(spark, sf_dir)))


@query
def iqr_statistics_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.table(spark, sf_dir, "lineitem")
    return rounded(outliers.iqr_statistics(lines, "l_extendedprice", 3.0))


@query
def iqr_inliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = views.tx_event(spark, sf_dir)
    return outliers.inliers(facts, "unit_price", outliers.fences(facts, "unit_price"))


@query
def distinct_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = views.tx_event(spark, sf_dir)
    return outliers.distinct_outliers(facts, "unit_price", outliers.fences(facts, "unit_price"))


# Descriptive statistics ---------------------------------------------------------------


@query
def numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eda.numeric_summary(views.tx_event(spark, sf_dir), "unit_price"))


@query
def price_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eda.histogram(views.tx_event(spark, sf_dir), "unit_price"))


@query
def boxplot_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eda.boxplot_before(views.tx_event(spark, sf_dir), "unit_price"))


@query
def boxplot_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eda.boxplot_after(views.tx_event(spark, sf_dir), "unit_price"))


def _corr_price_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = impute.impute(views.cust_gap(spark, sf_dir), "x", "grp", "median")
    return eda.fact_correlation(
        views.tx_order(spark, sf_dir), "customer_id", "unit_price", filled, "customer_id", "x"
    )


@query
def corr_price_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_corr_price_age(spark, sf_dir))


def _corr_price_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = views.table(spark, sf_dir, "embeddings")
    return eda.fact_correlation(
        views.table(spark, sf_dir, "lineitem"),
        "l_partkey",
        "l_extendedprice",
        features.array_stats(vectors, "vec_id", "embedding"),
        "vec_id",
        "image_mean",
    )


@query
def corr_price_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_corr_price_feature(spark, sf_dir))


@query
def corr_price_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price against every feature of a product, from one pass over the order lines."""
    found = eda.fact_correlations(
        views.table(spark, sf_dir, "lineitem"),
        "l_partkey",
        "l_extendedprice",
        views.part_features(spark, sf_dir),
        "p_partkey",
        ["p_size", "p_retailprice", "name_length", "image_mean", "image_std"],
    )
    return rounded(found)


@query
def corr_image_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        eda.column_correlation(_product_features(spark, sf_dir), "image_mean", "product_name_length")
    )


@query
def feature_corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eda.correlation_matrix(_product_features(spark, sf_dir), FEATURES))


@query
def strongest_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = eda.correlation_matrix(_product_features(spark, sf_dir), FEATURES)
    return rounded(eda.strongest_pair(matrix, FEATURES))


@query
def monthly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eda.monthly_totals(views.tx_order(spark, sf_dir), amount_scale=MONEY_SCALE), 2)


@query
def peak_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = eda.monthly_totals(views.tx_order(spark, sf_dir), amount_scale=MONEY_SCALE)
    return rounded(eda.peak_month(monthly), 2)


@query
def correlation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts next to the numbers they come from."""
    summary = eda.numeric_summary(views.tx_event(spark, sf_dir), "unit_price")
    age = _corr_price_age(spark, sf_dir).withColumnRenamed("correlation", "price_age")
    image = _corr_price_feature(spark, sf_dir).withColumnRenamed("correlation", "price_image")
    one = summary.crossJoin(F.broadcast(age)).crossJoin(F.broadcast(image))  # one row each
    return one.select(
        eda.tail_label(F.col("mean"), F.col("median")).alias("price_tail"),
        eda.strength_label(F.col("price_age")).alias("price_age_strength"),
        eda.strength_label(F.col("price_image")).alias("price_image_strength"),
    )


@query
def corr_freq_monetary(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = rfm.purchases_per_customer(views.tx_order(spark, sf_dir), amount_scale=MONEY_SCALE)
    return rounded(segments.frequency_monetary_correlation(customers))


@query
def freq_monetary_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = rfm.purchases_per_customer(views.tx_order(spark, sf_dir), amount_scale=MONEY_SCALE)
    return segments.frequency_monetary_bins(customers, 20)


# Recency, frequency, monetary ---------------------------------------------------------


@query
def rfm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rfm.rfm_base(views.tx_order(spark, sf_dir), amount_scale=MONEY_SCALE), 2)


@query
def rfm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = rfm.rfm_base(views.tx_order(spark, sf_dir), amount_scale=MONEY_SCALE)
    return rfm.rfm_scores(base).select("customer_id", "r_score", "f_score", "m_score")


@query
def rfm_percentile_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = rfm.rfm_base(views.tx_order(spark, sf_dir), amount_scale=MONEY_SCALE)
    return rounded(rfm.rfm_ranks(base).select("customer_id", "r_rank", "f_rank", "m_rank"), 9)


@query
def rfm_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_rfm(views.tx_order(spark, sf_dir)), 2)


@query
def rfm_asof_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference date inside the data: later buyers get a negative recency."""
    return rounded(_rfm(views.tx_order(spark, sf_dir), analysis_date="1999-06-30"), 2)


@query
def rfm_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_rfm(views.tx_line_totals(spark, sf_dir)), 2)


@query
def rfm_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_rfm(views.tx_event(spark, sf_dir)), 2)


@query
def rfm_bucketed_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RFM from visits that are stored in buckets of customers: the groupings by customer shuffle nothing."""
    visited = rfm.visits(views.tx_order(spark, sf_dir), amount_scale=MONEY_SCALE)
    stored = write_bucketed(visited, reserve(spark, "visits"), "customer_id", default_buckets(spark))
    base = rfm.recency_of(rfm.customers_of(stored))
    return rounded(rfm.scored(base), 2)


@query
def rfm_some_undated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_rfm(views.tx_event_some_undated(spark, sf_dir)), 2)


@query
def rfm_daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_rfm(views.tx_event(spark, sf_dir), date_grain="day"), 2)


@query
def customer_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rfm.customer_buckets(views.tx_order(spark, sf_dir), "customer_id", 64)


@query
def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(segments.segment_summary(_rfm(views.tx_order(spark, sf_dir))), 4)


@query
def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segment_counts(_rfm(views.tx_order(spark, sf_dir)))


@query
def largest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.largest_segment(_rfm(views.tx_order(spark, sf_dir)))


@query
def insight_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = segments.segment_summary(_rfm(views.tx_order(spark, sf_dir)))
    return rounded(segments.insight_metrics(summary), 4)
