"""The public facade: a whole analysis from raw files to scored customers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from basketlens import contracts
from basketlens.operators import eda, features, impute, load, outliers, quality, rfm
from basketlens.operators.cells import TASK_VALUES
from basketlens.sources.buckets import default_buckets
from basketlens.sources.raw import raw_files, read_csv, read_images, require_closed_quotes
from basketlens.sources.scratch import scope
from basketlens.sources.store import TableStore


class DataAnalyzer:
    """Loads, cleans and describes transactions, customers and articles.

    Results are stored under ``store_root`` and reused unless ``force`` is given.
    ``raw_root`` holds the raw files, ``precomputed_root`` results of earlier runs.
    """

    def __init__(
        self,
        spark: SparkSession,
        store_root: str,
        raw_root: str | None = None,
        precomputed_root: str | None = None,
        *,
        amount_scale: int = rfm.AMOUNT_SCALE,
        task_values: int = TASK_VALUES,
        visit_buckets: int | None = None,
    ) -> None:
        self.spark = spark
        self.raw_root = None if raw_root is None else str(raw_root).rstrip("/")
        self.store = TableStore(spark, store_root, precomputed_root)
        self.amount_scale = amount_scale
        self.task_values = task_values
        self.visit_buckets = visit_buckets or default_buckets(spark)
        self.customers: DataFrame | None = None
        self.articles: DataFrame | None = None
        self.transactions: DataFrame | None = None

    @property
    def artifact_status(self) -> dict[str, str]:
        return self.store.status

    # Loading --------------------------------------------------------------------------

    def load_data(self, *, force: bool = False, refresh: bool = False) -> dict[str, int]:
        """Load, check and store the three tables; missing ages stay missing.

        Stored tables are used as they are. ``refresh`` compares the raw transaction files with those the
        stored table was read from: files that came since are read and added, and if one has changed or gone
        all are read again. ``force`` reads everything again.
        """
        self.customers = self.store.load_or_compute(
            contracts.CUSTOMERS,
            lambda: load.normalize_customers(self._read(contracts.RAW_CUSTOMERS_FILE)),
            force=force,
            check=self._unique_key("customer_id", contracts.RAW_CUSTOMERS_FILE),
        )
        self.articles = self._load_articles(force=force)
        self.transactions = self._load_transactions(force=force, refresh=refresh)
        return load.load_summary(self.transactions, self.customers, self.articles).first().asDict()

    def _load_transactions(self, *, force: bool, refresh: bool) -> DataFrame:
        stored = None if force else self.store.find(contracts.TRANSACTIONS)
        if stored is not None and not refresh:
            return stored
        files = raw_files(self.spark, self._raw(contracts.RAW_TRANSACTIONS_FILE))
        known = None if stored is None else self.store.sources(contracts.TRANSACTIONS.name)
        if known == files:
            return stored
        added = [f for f in files if known and f not in known]
        grown = bool(known) and len(added) + len(known) == len(files)
        faults = Observation()
        return self.store.put(
            contracts.TRANSACTIONS,
            self._read_transactions(faults, [path for path, _, _ in added] if grown else None),
            check=lambda facts: self._raise(
                quality.transaction_errors(faults.get, facts, self.customers, self.articles)
            ),
            continues=self.store.paths[contracts.TRANSACTIONS.name] if grown else None,
            sources=files,
        )

    def _raw(self, name: str) -> str:
        if self.raw_root is None:
            raise ValueError(
                "a stored result is missing or invalid and there is no raw dataset to rebuild it from"
            )
        return f"{self.raw_root}/{name}"

    def _read(self, name: str, files: list[str] | None = None) -> DataFrame:
        """Customers and articles may hold quoted line ends; transactions stay splittable."""
        path = files or self._raw(name)
        facts = name == contracts.RAW_TRANSACTIONS_FILE
        if facts:
            require_closed_quotes(self.spark, path)
        return read_csv(self.spark, path, multi_line=not facts)

    def _versions(self, *names: str) -> dict[str, str | None]:
        """Versions of the source tables, which results computed from them are keyed by."""
        if "transactions" in names and self.transactions is None:
            self.transactions = self.store.find(contracts.TRANSACTIONS)
        return {f"{name}_version": self.store.version(name) for name in names}

    def _load_articles(self, *, force: bool = False) -> DataFrame:
        return self.store.load_or_compute(
            contracts.ARTICLES,
            lambda: load.normalize_articles(self._read(contracts.RAW_ARTICLES_FILE)),
            force=force,
            check=self._unique_key("product_id", contracts.RAW_ARTICLES_FILE),
        )

    def _read_transactions(self, faults: Observation, files: list[str] | None = None) -> DataFrame:
        """The raw file is parsed once: faults are counted while the table is written."""
        renamed = load.selected(
            self._read(contracts.RAW_TRANSACTIONS_FILE, files), contracts.TRANSACTION_COLUMNS
        )
        counted = renamed.observe(faults, *quality.transaction_faults(load.TRANSACTION_TYPES))
        return load.parsed_transactions(counted, strict=False)

    def _unique_key(self, key: str, name: str) -> Callable[[DataFrame], None]:
        return lambda df: self._raise(quality.dimension_errors(df, key, name))

    @staticmethod
    def _raise(errors: list[str]) -> None:
        if errors:
            raise ValueError("; ".join(errors))

    def _facts(self) -> DataFrame:
        if self.transactions is None:
            self.transactions = self.store.find(contracts.TRANSACTIONS)
        if self.transactions is None:
            raise ValueError("call load_data first")
        return self.transactions

    def visits(self, *, force: bool = False) -> DataFrame:
        """Transactions added up per customer and date, stored in buckets of customers.

        After a load that only added files, the visits of these are added to the stored ones.
        """
        self._facts()
        scale = {"scale": self.amount_scale}
        params = scale | self._versions("transactions")

        def build() -> DataFrame:
            path = self.store.paths[contracts.TRANSACTIONS.name]
            parts = self.store.facts(path).get("parts") if self.store.owns(path) else None
            before = parts and self.store.find(contracts.VISITS, scale | {"transactions_version": parts[-1]}, plain=False)
            if before:
                added = rfm.visits(self.spark.read.parquet(path), amount_scale=self.amount_scale)
                return rfm.merged_visits(before.unionByName(added))
            return rfm.visits(self._facts(), amount_scale=self.amount_scale)

        return self.store.load_or_compute(
            contracts.VISITS, build, params, force=force, plain=False, buckets=("customer_id", self.visit_buckets)
        )

    # Cleaning and features ------------------------------------------------------------

    def handle_missing_values(
        self, column: str, group_column: str, strategy: str = "median"
    ) -> dict[str, int]:
        """Fill a customer column from its group, else from all customers, and store the table."""
        if self.customers is None:
            raise ValueError("call load_data before handle_missing_values")
        with scope(self.spark):
            filled = impute.impute(
                self.customers,
                column,
                group_column,
                strategy,
                output="_filled",
                task_values=self.task_values,
            )
            counts = Observation()
            counted = filled.observe(
                counts,
                F.count_if(F.col(column).isNull()).alias("missing_before"),
                F.count_if(F.col("_filled").isNull()).alias("missing_after"),
            )
            kept = [F.col("_filled").alias(c) if c == column else F.col(c) for c in self.customers.columns]

            def complete(written: DataFrame) -> None:
                if left := written.where(F.col(column).isNull()).count():
                    raise ValueError(f"could not impute all missing values in {column}: {left} remain")

            # A newer version of the table itself: whoever loads the customers sees the filled values.
            self.customers = self.store.put(contracts.CUSTOMERS, counted.select(*kept), check=complete)
        return dict(counts.get)

    def engineer_features(self, *, force: bool = False) -> DataFrame:
        """Name length, pixel mean and pixel std of every article."""
        return self.store.load_or_compute(
            contracts.PRODUCT_FEATURES, self._build_features, self._versions("articles"), force=force
        )

    def _build_features(self) -> DataFrame:
        images = self._raw(contracts.IMAGE_FOLDER)
        if self.articles is None:
            self.articles = self._load_articles()
        if self.store.exists(images):
            stats = features.image_stats(read_images(self.spark, self.raw_root), "image_path")
        else:
            stats = self.spark.createDataFrame(
                [], "image_path string, image_mean double, image_std double"
            )
        return features.product_features(self.articles, stats)

    # Analysis -------------------------------------------------------------------------

    def detect_outliers(
        self,
        column: str = "unit_price",
        threshold: float = contracts.IQR_THRESHOLD,
        *,
        force: bool = False,
    ) -> dict[str, float | int]:
        """Exact quartiles, fences and outlier count of a numeric transaction column."""
        result = self.store.load_or_compute(
            contracts.iqr_contract(column),
            lambda: outliers.iqr_statistics(
                self._facts(), column, threshold, task_values=self.task_values
            ),
            {"column": column, "threshold": float(threshold), **self._versions("transactions")},
            force=force,
            accept=lambda df: not df.where(
                (F.col("column") == column) & (F.col("threshold") == float(threshold))
            ).isEmpty(),
        ).first()
        return {k: v for k, v in result.asDict().items() if k not in ("column", "threshold")}

    def calculate_rfm(
        self,
        customer_col: str = "customer_id",
        date_col: str = "order_date",
        amount_col: str = "unit_price",
        analysis_date: str | dt.date | dt.datetime | None = None,
        partition_count: int | None = None,
        *,
        date_grain: str = "timestamp",
        force: bool = False,
    ) -> DataFrame:
        """Scores and segment of every customer with a transaction.

        ``partition_count`` fixes the number of customer partitions; left out, Spark
        sizes them by their data.
        """
        params = {
            "customer": customer_col,
            "date": date_col,
            "amount": amount_col,
            "analysis_date": analysis_date,
            "grain": date_grain,
            "scale": self.amount_scale,
            **self._versions("transactions"),
        }
        usual = (customer_col, date_col, amount_col) == ("customer_id", "order_date", "unit_price")

        def build() -> DataFrame:
            if usual:  # the stored visits are dealt by customer: no shuffle
                visited = self.visits()
                if date_grain == "day":
                    visited = rfm.merged_visits(visited.withColumn("order_date", F.to_date("order_date").cast("timestamp_ntz")))
                customers = rfm.customers_of(visited)
            else:
                grain = {"date_grain": date_grain, "amount_scale": self.amount_scale}
                customers = rfm.purchases_per_customer(self._facts(), customer_col, date_col, amount_col, **grain)
            base = rfm.recency_of(customers, customer_col, analysis_date, partition_count=partition_count)
            return rfm.scored(base, task_values=self.task_values)

        if date_grain not in ("timestamp", "day"):
            raise ValueError("date_grain must be 'timestamp' or 'day'")
        return self.store.load_or_compute(
            contracts.rfm_contract(customer_col),
            build,
            params,
            force=force,
            # A file without parameters can only stand for the default ones.
            plain=usual and analysis_date is None and date_grain == "timestamp",
        )

    def prepare_eda_artifacts(self, *, force: bool = False) -> dict[str, object]:
        """Everything the report draws, so that drawing never scans the transactions again."""
        params = {"scale": self.amount_scale, **self._versions("transactions", "customers", "articles")}
        if not force:
            summary = self.store.find(contracts.EDA_SUMMARY, params)
            monthly = self.store.find(contracts.MONTHLY_SUMMARY, params)
            if summary is not None and monthly is not None:
                return self._eda_result(summary)
        if self.customers is None:
            raise ValueError("call load_data before prepare_eda_artifacts")
        if not self.customers.where(F.col("age").isNull()).isEmpty():
            raise ValueError("call handle_missing_values first; customer age still has missing values")
        built, monthly = self._build_eda(self.engineer_features(force=force))
        self.store.put(contracts.MONTHLY_SUMMARY, monthly, params)
        return self._eda_result(self.store.put(contracts.EDA_SUMMARY, built, params))

    def _build_eda(self, product_features: DataFrame) -> tuple[DataFrame, DataFrame]:
        """One row of numbers, and the totals per month; all from the passes of one description of the price."""
        found = eda.describe(
            self._facts(), "unit_price", "order_date", "customer_id",
            amount_scale=self.amount_scale, task_values=self.task_values,
        )
        age = eda.key_correlations(found.per_key, self.customers, "customer_id", ["age"])
        text = eda.column_correlation(product_features, "image_mean", "product_name_length")
        box = f"struct<{eda.BOX.replace(' ', ':').replace(',:', ',')}>"
        summary = f"struct<{eda.SUMMARY.replace(' ', ':').replace(',:', ',')}>"
        row = (found.summary, found.histogram_edges, found.histogram_counts, found.before, found.after)
        one = self.spark.createDataFrame(
            [row],
            f"price_statistics {summary}, histogram_edges array<double>, histogram_counts array<long>, "
            f"boxplot_before {box}, boxplot_after {box}",
        )
        for part in (
            age.select(F.col("correlation").alias("price_age_correlation")),
            text.select(F.col("correlation").alias("image_text_correlation")),
        ):
            one = one.crossJoin(F.broadcast(part))  # one row each
        return one, found.per_month

    def _eda_result(self, summary: DataFrame) -> dict[str, object]:
        result = summary.first().asDict(recursive=True)
        result["monthly_summary_path"] = self.store.paths["monthly_summary"]
        return result
