"""Customer analytics on Spark: loading, imputation, features, outliers, EDA and RFM."""

from basketlens.plans.analyzer import DataAnalyzer

__all__ = ["DataAnalyzer"]
