import random

import numpy as np
import pytest

from basketlens.llm import embeddings as e
from basketlens.llm.components import components


def slow(rows, threshold=e.THRESHOLD):
    """n_links and component of every row by all pairs."""
    good = []
    for i, (vec_id, v, label) in enumerate(rows):
        fine = vec_id is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if fine:
            good.append((i, np.array(v, float) / np.linalg.norm(np.array(v, float)), label))
    links = {i: set() for i in range(len(rows))}
    for a, x, la in good:
        for b, y, lb in good:
            if a != b and la == lb and len(x) == len(y) and x @ y >= threshold:
                links[a].add(b)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None))
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    return e.near_vectors(df, **more).collect()


def cloud(rng, n, size=16, family=12):
    rows, centre = [], None
    for i in range(n):
        if i % family == 0:
            centre = rng.normal(size=size)
        v = centre + rng.normal(size=size) * 0.04 * np.linalg.norm(centre) / np.sqrt(size) * rng.choice([0, 1, 3, 8])
        rows.append((i * 3 % 1009, np.float32(v).tolist(), int(rng.integers(0, 3)) if i % 5 else 0))
    return rows


@pytest.mark.parametrize("more", [{}, {"block": 7}])
def test_counts_and_components_equal_brute_force(spark, more):
    rows = cloud(np.random.default_rng(4), 500)
    want = {rows[i][0]: v for i, v in slow(rows).items()}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in run(spark, rows, **more)}
    total = sum(n for n, _ in want.values())
    assert sum(n for n, _ in got.values()) >= 0.9 * total > 0
    assert all(got[k][0] <= want[k][0] for k in want)
    assert sum(got[k] == want[k] for k in want) >= 0.97 * len(want)


def test_candidates_share_pivots_in_like_ranks_and_come_once():
    rng = np.random.default_rng(9)
    a, b = (np.array([rng.permutation(12)[:4] for _ in range(60)], np.int32) for _ in range(2))
    for shared, shift in ((1, 9.0), (2, 9.0), (2, 1.0), (3, 0.5)):
        found = []
        for pivot in range(12):
            found += list(zip(*e.candidates(a[(a == pivot).any(1)], b[(b == pivot).any(1)], pivot, shared, shift)))
            rows = np.flatnonzero((a == pivot).any(1)), np.flatnonzero((b == pivot).any(1))
            found = [x if len(x) == 3 else (int(rows[0][x[0]]), int(rows[1][x[1]]), pivot) for x in found]
        want = []
        for i, x in enumerate(a.tolist()):
            for j, y in enumerate(b.tolist()):
                both = set(x) & set(y)
                if len(both) >= shared and sum(abs(x.index(p) - y.index(p)) for p in both) <= shift * len(both):
                    want.append((i, j, min(both)))
        assert sorted(found) == want


@pytest.mark.parametrize("n", [800, 3000])
def test_recall_and_candidates_by_size(spark, n, monkeypatch):
    """Random families in 64 dimensions: recall of links, and the pairs that are verified by vector."""
    rng = np.random.default_rng(n)
    centre = rng.normal(size=(n // 4, 64))
    x = np.repeat(centre, 4, axis=0) + rng.normal(size=(n // 4 * 4, 64)) * 0.12
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = int(((u @ u.T) >= e.THRESHOLD).sum()) - len(u)
    got = run(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    assert want > n and sum(r["n_links"] for r in got) >= 0.95 * want
    pivots = e.choose_pivots(spark.createDataFrame([(v.tolist(), i) for i, v in enumerate(x)], "vector array<double>, hash long"), e.number_of_pivots(n))[64]
    near = e.nearest_pivots(u, pivots, e.NEAREST)
    assert (np.diff(np.take_along_axis(u @ pivots.T, near, axis=1), axis=1) <= 0).all()
    lists = np.bincount(near.ravel(), minlength=len(pivots))
    assert len(pivots) >= min(n // 4, e.number_of_pivots(n)) and lists.max() <= 14 * e.NEAREST * len(u) / len(pivots)


def test_vectors_that_share_an_id_stay_apart(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (2, [1.0, 0.01, 0.0], 0), (3, [0.0, 1.0, 0.01], 0), (4, [0.0, 0.0, 1.0], 0)]
    want = sorted((rows[i][0], *v) for i, v in slow(rows).items())
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in run(spark, rows)) == want == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]
    more = [(5, [1.0, 0.0, 0.0], 0), (2, [0.0, 0.0, 1.0], 0)]  # an id of one component on a vector of another
    want = sorted((r[0], *v) for r, v in zip(rows + more, slow(rows + more).values()))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in run(spark, rows + more)) == want


def test_edges(spark):
    one, two = [1.0, 0.0], [0.0, 1.0]
    rows = [
        (1, one, 0), (2, one, 0), (2, one, 0), (3, one, 1), (4, one, None), (5, None, 0), (6, [], 0), (7, [0.0, 0.0], 0), (8, [None, 1.0], 0),
        (9, [float("nan"), 1.0], 0), (10, [float("inf"), 1.0], 0), (11, [2.0, 0.0], 0), (12, two, 0), (13, [1.0, 0.0, 0.0], 0), (None, one, 0), (14, [1e-30, 0.0], 0),
    ]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in run(spark, rows))
    linked = {1, 2, 11, 14}
    want = [(i, 4 if i in linked else 0, 1 if i in linked else i or None, (i == 1 or i not in linked) if i else None) for i in sorted(r[0] or 0 for r in rows)]
    assert got == want
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert e.near_vectors(empty).count() == 0


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(2)
    pairs = {
        "path": [(i, i + 1) for i in range(300)],
        "star": [(7, i) for i in range(500)],
        "random": [(rng.randint(-150, 150), rng.randint(-150, 150)) for _ in range(140)],
        "none": [(5, 5), (None, 1)],
    }[shape]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()}
    least = {}
    edges = [(a, b) for a, b in pairs if a is not None and a != b]
    for a, b in edges:
        least.setdefault(a, a), least.setdefault(b, b)
    for _ in range(400):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert got == least
