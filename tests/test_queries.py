"""Every registered query against its SQL on an independent engine."""

import importlib
import inspect

import pytest

import __spark_entry__ as entry
from basketlens.plans.oracles import ORACLES
from basketlens.plans.queries import QUERIES
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql_engine():
    return connect(SF)


def test_every_analytics_query_has_sql():
    """Of the corpus queries only some can be told in SQL; their own tests hold them against brute force."""
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, sql_engine, name):
    ok, note = compare(spark, sql_engine, SF, name)
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_golden_segments(spark):
    rows = entry.queries()["segment_counts"](spark, "/root/testdata/sf0.01").collect()
    assert {r["segment"]: r["customers"] for r in rows} == {
        "Potential": 526,
        "Loyal": 397,
        "Churned": 373,
        "New": 121,
        "VIP": 83,
    }


LARGE_TABLE_LIMITS = {"task_values": 300, "max_broadcast_rows": 2}


@pytest.fixture()
def every_table_is_large(spark, monkeypatch):
    """Lower the limits below the test tables, so that the ways for large tables are taken."""
    for name in ("cells", "eda", "exact", "impute", "lookups", "outliers", "rfm", "study"):
        module = importlib.import_module(f"basketlens.operators.{name}")
        for _, fn in inspect.getmembers(module, inspect.isfunction):
            for limit, value in LARGE_TABLE_LIMITS.items():
                if limit in (fn.__kwdefaults__ or {}):
                    monkeypatch.setitem(fn.__kwdefaults__, limit, value)
                elif limit in inspect.signature(fn).parameters and fn.__defaults__:
                    names = list(inspect.signature(fn).parameters)[-len(fn.__defaults__) :]
                    changed = tuple(value if n == limit else d for n, d in zip(names, fn.__defaults__, strict=True))
                    monkeypatch.setattr(fn, "__defaults__", changed)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(
    "name",
    [
        "impute_group_median",
        "group_profile",
        "holdout_mean_vs_median",
        "iqr_statistics",
        "boxplot_after",
        "numeric_summary",
        "preview_profile",
        "corr_price_age",
        "rfm_segments",
    ],
)
def test_query_on_large_tables(spark, sql_engine, every_table_is_large, name):
    ok, note = compare(spark, sql_engine, SF, name)
    assert ok, note
