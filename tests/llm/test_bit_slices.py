import numpy as np
import pytest

from basketlens.llm import bit_slices as b

SCHEMA = "vec_id long, embedding array<float>, score string, rank int, copies int"


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, b.top_products(df, **more).collect()), key=repr)


def slow(rows, k=5, every=50):
    kept = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for at, (q, x) in enumerate(kept):
        if q is None or q % every:
            continue
        scored = [(-sum(a * c for a, c in zip(x, y)), i is None, i or 0) for other, (i, y) in enumerate(kept) if other != at and len(x) == len(y)]
        out += [(q, rank, None if unnamed else i, -score) for rank, (score, unnamed, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def cloud(n, size=12, seed=1, scale=0.1):
    rng = np.random.default_rng(seed)
    rows = [(int(i) - 100, np.float32(rng.normal(size=size) * scale).tolist()) for i in rng.permutation(n)]
    return rows + [(n + i, rows[i % 3][1]) for i in range(n // 3)]


@pytest.mark.parametrize("more", [{}, {"block": 40}, {"block": 64, "chunk": 2}])
@pytest.mark.parametrize("scale", [0.01, 0.1, 30])
def test_equals_brute_force(spark, more, scale):
    rows = cloud(400, scale=scale)
    assert run(spark, rows, **more) == slow(rows)


def test_edges(spark):
    odd = [(0, None), (50, [1.0, None]), (100, [float("nan"), 0.0]), (None, [0.5, 0.5]), (None, [0.5, 0.5]), (150, [float("inf"), 1.0])]
    rows = odd + [(200, [0.5, 0.5]), (200, [0.5, 0.5]), (200, [0.1, -0.2]), (7, [0.0, 0.0]), (7, [0.0, 0.0]), (0, [0.0, 0.0]), (1, [1.0]), (250, [2.0])]
    assert run(spark, rows) == slow(rows)
    assert run(spark, rows, block=2, chunk=1) == slow(rows)
    assert run(spark, [(0, [1.0])]) == [] and run(spark, []) == [] and run(spark, [(3, [1.0]), (4, [1.0])]) == []
    assert run(spark, [(0, []), (1, [])]) == [(0, 1, 1, 0)]


def test_a_third_are_copies_of_a_query(spark):
    rows = cloud(60, 4) + [(0, [0.5, 0.5, 0.5, 0.5])] * 40
    assert run(spark, rows, block=16) == slow(rows)


def test_products_too_large_are_an_error(spark):
    with pytest.raises(Exception, match="do not fit a long"):
        run(spark, [(0, [4e9, 1.0]), (1, [4e9, 1.0])])


def block_of(x):
    shift, planes = b.quantised(x)
    ids = np.ma.masked_array(np.arange(len(x)), np.zeros(len(x), bool))
    return b.Block.of(ids, np.ones(len(x), np.int64), x, shift, planes)


def test_slices_add_up_to_products():
    rng = np.random.default_rng(4)
    x, query = rng.integers(-20, 20, (130, 9)), rng.integers(-300, 300, 9)
    block = block_of(x)
    slices = b.sum_slices(block, query)
    sums = sum(np.isin(np.arange(192), b.members(s)).astype(int) << i for i, s in enumerate(slices))[:130]
    assert block.shift == 0 and len(set((sums - x @ query).tolist())) == 1
    for k in (1, 5, 130):
        assert b.kth_largest(slices, block.every, k) == sorted(sums)[-k]
        assert set(b.members(b.at_least(slices, block.every, sorted(sums)[-k]))) == set(np.flatnonzero(sums >= sorted(sums)[-k]))
    assert b.kth_largest(slices, block.every, 131) is None


def test_boundary_is_small_and_holds_the_best():
    rng = np.random.default_rng(5)
    x = rng.integers(-130, 130, (8000, 64))
    block = block_of(x)
    for query in x[:20]:
        rows = b.boundary(block, query, block.every, 5)
        assert set(np.argsort(-(x @ query), kind="stable")[:5]) <= set(rows) and len(rows) < 2500


def test_signed_digits():
    values = np.array([0, 1, -1, 7, -7, 255, -256, 12345])
    place, power, negative = b.digits(values)
    back = np.zeros(len(values), np.int64)
    np.add.at(back, place, np.where(negative, -1, 1) << power)
    assert back.tolist() == values.tolist()
