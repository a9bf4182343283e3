"""Table contracts and policy values.

The names and numbers in this file are fixed values: stored tables, reports and
scores are only comparable with existing results when they are equal to these.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

# File names of a raw dataset folder.
RAW_TRANSACTIONS_FILE = "transactions_train.csv"
RAW_CUSTOMERS_FILE = "customers.csv"
RAW_ARTICLES_FILE = "articles.csv"
IMAGE_FOLDER = "images"

# Texts that count as a missing value in a raw CSV file. Case matters:
# "NONE" is an ordinary text and stays one.
NULL_TEXTS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Raw column -> normalised column.
TRANSACTION_COLUMNS = {
    "customer_id": "customer_id",
    "article_id": "product_id",
    "t_dat": "order_date",
    "price": "unit_price",
}
CUSTOMER_COLUMNS = {
    "customer_id": "customer_id",
    "age": "age",
    "club_member_status": "club_member_status",
}
ARTICLE_COLUMNS = {
    "article_id": "product_id",
    "prod_name": "product_name",
}

# Analysis policies.
IMPUTE_STRATEGIES = ("median", "mean")
IQR_THRESHOLD = 1.5
HISTOGRAM_BINS = 40
CUSTOMER_BUCKETS = 64
WEAK_CORRELATION = 0.1
MASK = "<masked>"
SEGMENTS = ("VIP", "Loyal", "New", "Churned", "Potential")

# The insight numbers shown per segment.
INSIGHT_METRICS = {
    "VIP": ("customer_share_pct", "monetary_share_pct", "mean_frequency"),
    "Churned": ("customer_share_pct", "mean_recency", "mean_frequency"),
    "Loyal": ("customer_share_pct", "monetary_share_pct", "mean_frequency"),
}


@dataclass(frozen=True)
class TableContract:
    """Columns a stored table must have, and obsolete columns it must not have.

    ``types`` says how the columns of a text copy are read.
    """

    name: str
    required: tuple[str, ...]
    forbidden: tuple[str, ...] = ()
    types: Mapping[str, str] = field(default_factory=dict)


def _typed(name: str, types: Mapping[str, str], forbidden: tuple[str, ...] = ()) -> TableContract:
    return TableContract(name, tuple(types), forbidden, types)


TRANSACTIONS = _typed(
    "transactions",
    {
        "customer_id": "string",
        "product_id": "string",
        "order_date": "timestamp_ntz",
        "unit_price": "double",
    },
    ("sales_channel_id",),
)
CUSTOMERS = _typed(
    "customers",
    {"customer_id": "string", "age": "double", "club_member_status": "string"},
    ("fashion_news_frequency", "age_was_missing"),
)
ARTICLES = _typed(
    "articles",
    {"product_id": "string", "product_name": "string", "image_path": "string"},
    ("category",),
)
PRODUCT_FEATURES = _typed(
    "product_features",
    {
        "product_id": "string",
        "image_path": "string",
        "product_name_length": "int",
        "image_mean": "double",
        "image_std": "double",
    },
    ("image_status",),
)
VISITS = _typed(
    "visits",
    {"customer_id": "string", "order_date": "timestamp_ntz", "facts": "bigint", "amount": "decimal(38,12)"},
)
MONTHLY_SUMMARY = _typed("monthly_summary", {"order_month": "string", "monetary": "double"})
EDA_SUMMARY = TableContract(
    "eda_summary",
    (
        "price_statistics",
        "histogram_edges",
        "histogram_counts",
        "boxplot_before",
        "boxplot_after",
        "price_age_correlation",
        "image_text_correlation",
    ),
)


def iqr_contract(column: str) -> TableContract:
    return TableContract(
        f"iqr_{column}",
        ("column", "threshold", "q1", "q3", "lower_fence", "upper_fence", "outlier_count"),
    )


def rfm_contract(customer_col: str) -> TableContract:
    """The score table carries whatever the customer column was called in the facts."""
    return _typed(
        "rfm",
        {
            customer_col: "string",
            "recency": "bigint",
            "frequency": "bigint",
            "monetary": "double",
            "r_score": "int",
            "f_score": "int",
            "m_score": "int",
            "segment": "string",
        },
    )
