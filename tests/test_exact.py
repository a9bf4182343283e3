import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketlens.operators.cells import Cells, Range, profile, settled
from basketlens.operators.exact import exact_quantiles, group_statistics, order_statistics, quantile_indices

PROBS = [0.0, 0.25, 0.5, 0.75, 1.0]


def columns(kind: str, n: int = 3000) -> np.ndarray:
    rng = np.random.default_rng(7)
    if kind == "heavy tail":
        return np.exp(rng.normal(size=n) * 3).round(4)
    if kind == "hot value":  # a third of all rows are one value
        return np.where(np.arange(n) % 3 == 0, 5.0, rng.normal(size=n).round(3))
    if kind == "constant":
        return np.full(n, 2.5)
    return np.arange(n, dtype=float)[::-1]


@pytest.mark.parametrize("kind", ["heavy tail", "hot value", "constant", "distinct"])
@pytest.mark.parametrize("limits", [{}, {"task_values": 150}])
def test_quantiles_equal_numpy(spark, kind, limits):
    values = columns(kind)
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    row = exact_quantiles(df, "v", PROBS, **limits).first()
    assert row["n"] == len(values)
    np.testing.assert_allclose(row["q"], np.quantile(values, PROBS), rtol=1e-12)


@pytest.mark.parametrize(
    "limits",
    [
        {},
        {"task_values": 100},
        {"task_values": 100, "max_broadcast_rows": 2},
    ],
)
def test_grouped_quantiles_equal_numpy(spark, limits):
    rng = np.random.default_rng(3)
    n = 3000
    # One group has half of the rows, one is the null group, one knows no value, one is tiny.
    group = rng.choice(["hot", "b", "c", None], size=n, p=[0.5, 0.2, 0.2, 0.1])
    frame = pd.DataFrame({"g": group, "v": rng.exponential(size=n).round(2)})
    frame.loc[::11, "v"] = np.nan
    frame = pd.concat(
        [frame, pd.DataFrame({"g": ["empty", "empty", "tiny", "tiny"], "v": [np.nan, np.nan, 1.0, 4.0]})]
    )
    df = spark.createDataFrame(frame, "g string, v double").withColumn(
        "v", F.when(~F.isnan("v"), F.col("v"))
    )
    rows = exact_quantiles(
        df, "v", [0.25, 0.5], ["g"], **limits
    ).collect()
    assert len(rows) == 6
    for row in rows:
        mine = frame[frame.g.isna() if row["g"] is None else frame.g == row["g"]].v.dropna()
        assert row["n"] == len(mine)
        if len(mine) == 0:
            assert row["high"] is None
            assert row["q"] is None or row["q"] == [None, None]
        else:
            assert (row["low"], row["high"]) == (mine.min(), mine.max())
            assert row["mean"] == pytest.approx(mine.mean()) and row["m2"] == pytest.approx(((mine - mine.mean()) ** 2).sum())
            assert row["m3"] == pytest.approx(((mine - mine.mean()) ** 3).sum())
            np.testing.assert_allclose(row["q"], np.quantile(mine, [0.25, 0.5]), rtol=1e-12)


def test_order_statistics_count_smaller_and_equal_values(spark):
    df = spark.createDataFrame([(v,) for v in (10, 10, 20, 30, None)], "v int")
    first = {
        "x": [lambda n, m: 0 * n + 1, lambda n, m: 0 * n + 2],
        "none": [lambda n, m: 0 * n - 1],
    }
    row = order_statistics(df, "v", first).first()
    assert row["n"] == 4
    assert row["x"][0].asDict() == {"value": 10, "less": 0, "ties": 2}
    assert row["x"][1].asDict() == {"value": 20, "less": 2, "ties": 1}
    assert row["none"][0] is None


def test_empty_input_has_no_quantiles(spark):
    df = spark.createDataFrame([], "v double")
    row = exact_quantiles(df, "v", [0.5]).first()
    assert row["n"] == 0


@pytest.mark.parametrize("task_values", [200_000, 5])
@pytest.mark.parametrize("max_broadcast_rows", [10_000, 2])
def test_groupings_share_their_passes(spark, task_values, max_broadcast_rows):
    rng = np.random.default_rng(9)
    frame = pd.DataFrame({"a": rng.choice(["x", "y", None], 900), "b": rng.integers(0, 4, 900), "v": rng.normal(size=900).round(1)})
    df = spark.createDataFrame(frame, "a string, b int, v double")
    sets = [["a", "b"], ["a"], ["b"], []]
    limits = {"task_values": task_values, "max_broadcast_rows": max_broadcast_rows}
    state = group_statistics(df, "v", ["a", "b"], quantile_indices([0.5]), sets, **limits)
    assert state.small == (max_broadcast_rows > 2)
    got = {(r["_set"], r["a"], r["b"]): r for r in state.df.collect()}
    assert len(got) == 12 + 3 + 4 + 1
    for (i, a, b), r in got.items():
        mine = frame
        if "a" in sets[i]:
            mine = mine[mine.a.isna() if a is None else mine.a == a]
        if "b" in sets[i]:
            mine = mine[mine.b == b]
        values = np.sort(mine.v)
        low, high = values[(len(values) - 1) // 2], values[len(values) // 2]
        assert r["n"] == len(values) and (r["_r0"]["low"], r["_r1"]["low"]) == (low, high) and r["_r0"]["low"] == r["_r0"]["high"]
        assert (r["_r0"]["less"], r["_r0"]["rows"]) == ((values < low).sum(), (values == low).sum())


@pytest.mark.parametrize("task_values", [200_000, 3])
def test_extreme_values(spark, task_values):
    values = [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, 1.7e308, float("inf"), float("-inf"), 1.0, 1.0 + 2**-52, -1.0, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known = np.sort([v for v in values if v is not None and v == v])
    seen = profile(df, "v")
    assert (seen.n, seen.missing) == (12, 2)
    got, _ = settled(seen.cells, df, "v", lambda c: [c.kth(i).low for i in range(12)], task_values)
    assert got == known.tolist()
    ranks = {f"k{i}": [lambda n, m, i=i: 0 * n + i] for i in range(12)}
    row = order_statistics(df, "v", ranks, task_values=task_values).first()
    assert [row[f"k{i}"][0]["value"] for i in range(12)] == known.tolist()


def test_cells_answer_with_ranges_that_hold_the_truth():
    rng = np.random.default_rng(2)
    values = np.sort(rng.normal(size=500).round(2))
    cuts = np.flatnonzero(np.append(True, np.diff(np.floor(values * 3)) > 0))
    parts = np.split(values, cuts[1:])
    cells = Cells(np.array([p[0] for p in parts]), np.array([p[-1] for p in parts]), np.array([len(p) for p in parts]))
    for x in (-5.0, -1.0, -0.5, 0.0, 0.37, 1.9, 5.0):
        at = Range(x, x)
        assert cells.below(at).low <= (values < x).sum() <= cells.below(at).high
        assert cells.above(at).low <= (values > x).sum() <= cells.above(at).high
        if x <= values[-1]:
            assert cells.first_from(at).low <= values[values >= x][0] <= cells.first_from(at).high
        if x >= values[0]:
            assert cells.last_to(at).low <= values[values <= x][-1] <= cells.last_to(at).high
    for k in (0, 17, 250, 499):
        assert cells.kth(k).low <= values[k] <= cells.kth(k).high
    assert cells.open


def test_later_passes_read_few_rows(spark):
    """What is open after a pass is a small part of the rows."""
    n = 20_000
    df = spark.range(n).select(((F.col("id") * 7919) % n).cast("double").alias("v"))
    seen = profile(df, "v")
    seen.cells.kth(n // 2)
    assert sum(seen.cells.rows[i] for i in seen.cells.open) < n / 40
    found = order_statistics(df, "v", {"m": [lambda n, m: m.floor(n / 2)]}, task_values=200)
    assert found.first()["m"][0]["value"] == n // 2
