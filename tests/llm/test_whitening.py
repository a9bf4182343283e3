import numpy as np
import pytest

from basketlens.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, component string, x int"


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA).repartition(3)
    return w.whiten(df, **more).collect()


def whole(vector):
    return [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in vector]


def slow(rows):
    """Model and deviations from the covariance matrix in full."""
    kept = [r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    fit = np.array(sorted({tuple(whole(r[1])) for r in kept}))
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    apart = (fit - np.array(sums) // n) - (np.array(sums) % n) / n
    e, vectors = np.linalg.eigh(apart.T @ apart / n)
    deviation = {r[0]: sum((n * c - s) ** 2 for c, s in zip(whole(r[1]), sums)) for r in kept}
    centred = {r[0]: np.array([(n * c - s) / n for c, s in zip(whole(r[1]), sums)]) for r in kept}
    return n, e[::-1], vectors[:, ::-1].T, deviation, centred


def cloud(n, size, seed=2):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(size, size)) * np.geomspace(1, 0.05, size)
    rows = [(i, np.float32(rng.normal(size=size) @ mix.T + 3).tolist()) for i in range(n)]
    return rows + [(n + i, rows[0][1]) for i in range(n // 3)]


@pytest.mark.parametrize("size", [3, 16, 24])
def test_equals_the_eigenvectors_of_the_covariance(spark, size):
    rows = cloud(400, size)
    n, e, vectors, deviation, centred = slow(rows)
    got = run(spark, rows)
    assert len(got) == len(rows) * min(16, size)
    signs = {}
    for r in got:
        k = r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation[r["vec_id"]]
        assert r["explained"] == pytest.approx(e[k] / e.sum(), rel=1e-9)
        want = centred[r["vec_id"]] @ vectors[k] / np.sqrt(e[k])
        sign = signs.setdefault(k, np.sign(want) * np.sign(r["whitened"]))
        assert r["whitened"] == pytest.approx(sign * want, rel=1e-6, abs=1e-8)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_ill_conditioned_columns_still_whiten(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=500) * 1000
    rows = [(i, [float(base[i]), float(base[i] + rng.normal() / 20), float(rng.normal())]) for i in range(500)]
    _, e, _, _, _ = slow(rows)
    got = run(spark, rows)
    assert got[0]["identity_error"] < 1e-4
    share = {r["component"]: r["explained"] for r in got}
    assert [share[k] for k in (1, 2, 3)] == pytest.approx((e / e.sum()).tolist(), rel=1e-4)


def test_directions_without_spread(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(a), 2.0, float(a), float(b)]) for i, (a, b) in enumerate(rng.normal(size=(60, 2)))]
    got = run(spark, rows)
    assert len(got) == 240 and got[0]["identity_error"] < 1e-9
    assert {r["component"] for r in got if r["whitened"] is None} == {3, 4}
    assert {r["explained"] for r in got if r["component"] > 2} == {0.0}


def test_edges(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (2, [None]), (3, [float("nan")]), (4, [])]) == []
    got = run(spark, [(None, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [float("inf"), 0.0])])
    assert len(got) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(1, 0, None, None, None)}
    two = run(spark, [(1, [0.0]), (2, [1.0]), (3, [0.0, 1.0]), (4, [1.0, 3.0])])
    assert {r["vec_id"]: abs(r["whitened"]) for r in two if r["component"] == 1} == pytest.approx(dict.fromkeys((1, 2, 3, 4), 1.0))
    assert len(two) == 6 and {r["n"] for r in two} == {2}


def test_deviations_are_exact_or_null():
    centre = w.Centre.of(10**9, [10**18 + 5, -7])
    x = np.array([[10**9, 0], [10**9 + 2, 1], [10**9 + 10, 3]])
    want = [sum((10**9 * int(c) - s) ** 2 for c, s in zip(row, [10**18 + 5, -7])) for row in x]
    assert centre.deviations(x) == [v if v < 2**63 else None for v in want] and None in centre.deviations(x)


def test_triangular_solve():
    rng = np.random.default_rng(1)
    r, a = np.triu(rng.normal(size=(6, 6))) + 3 * np.eye(6), rng.normal(size=(9, 6))
    assert np.allclose(w.solved(a, r) @ r, a)
