import hashlib

import numpy as np
import pytest

from basketlens.llm import vector_codes as v

SCHEMA = "vec_id long, embedding array<float>, label int, x string, code int, size int"


def slow(rows):
    """The codes by comparing every part with every entry."""
    kept = [r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    if not kept:
        return [], None
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [int(np.floor(256 * float(c))) for c in r[1]]))
    x = np.array([[int(np.floor(256 * float(np.float32(c)))) for c in r[1]] for r in kept])
    width = -(-x.shape[1] // 16)
    parts = np.pad(x, ((0, 0), (0, 16 * width - x.shape[1]))).reshape(len(x), 16, width)
    books = parts[:64].copy()
    for last in (False, False, True):
        far = ((parts[:, None] - books[None]) ** 2).sum(axis=3)
        codes = far.argmin(axis=1)
        if last:
            break
        for p in range(16):
            for e in range(len(books)):
                own = parts[codes[:, p] == e, p]
                if len(own):
                    books[e, p] = own.sum(axis=0) // len(own)
    error = far.min(axis=1).sum(axis=1)
    by_label = {}
    for r, e in zip(kept, error):
        by_label[r[2]] = by_label.get(r[2], 0) + int(e)
    sha = hashlib.sha256(",".join(str(c) for c in books.transpose(1, 0, 2).ravel()).encode()).hexdigest()
    return [(r[0], "".join(f"{c:02x}" for c in code), int(e), by_label[r[2]], sha) for r, code, e in zip(kept, codes, error)], sha


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    return [tuple(r) for r in v.compress(df).collect()]


def key(row):
    return (row[0] is None, row[0] or 0, *row[1:4])


def cloud(n, size=32, seed=1, scale=0.2):
    rng = np.random.default_rng(seed)
    rows = [(int(i), np.float32(rng.normal(size=size) * scale).tolist(), int(rng.integers(0, 4)) if i % 7 else None) for i in rng.permutation(n)]
    return rows + [(n + i, rows[0][1], 3) for i in range(n // 3)]  # a third are copies


@pytest.mark.parametrize("size", [16, 32, 24])
def test_equals_brute_force(spark, size):
    rows = cloud(300, size)
    assert sorted(run(spark, rows), key=key) == sorted(slow(rows)[0], key=key)


def test_edges(spark):
    odd = [(1, None, 0), (2, [0.5] * 15 + [None], 0), (3, [float("nan")] * 16, None), (None, [0.25] * 16, None), (4, [float("inf")] + [0.0] * 15, 1)]
    rows = odd + [(5, [0.1] * 16, None), (5, [0.1] * 16, None), (5, [-0.3] * 16, 2), (6, [0.7] * 16, 2)]
    got = run(spark, rows)
    assert sorted(got, key=key) == sorted(slow(rows)[0], key=key) and len(got) == 5
    assert {r[2] for r in got} == {0}  # fewer vectors than entries: each is its own


def test_empty_and_unusable_tables(spark):
    assert run(spark, [(1, None, 0)]) == []
    assert v.compress(spark.createDataFrame([], SCHEMA)).collect() == []


def test_lengths_have_books_of_their_own(spark):
    short, long = cloud(90, 16), [(i + 1000, v_, label) for i, v_, label in cloud(80, 32)]
    got = run(spark, short + long + [(5000, [], 9)])
    for part in (short, long):
        want = {r[:3] for r in slow(part)[0]}
        assert want <= {r[:3] for r in got}
    assert (5000, "00" * 16, 0, 0) in {r[:4] for r in got}


def test_components_too_large_are_an_error(spark):
    with pytest.raises(Exception, match="2\\*\\*40"):
        run(spark, [(1, [3e38] * 16, 0)])
    with pytest.raises(Exception, match="do not fit a long"):
        run(spark, [(1, [4e9] * 16, 0), (2, [-4e9] * 16, 0)])


@pytest.mark.parametrize("count", [1, 2, 63, 64])
@pytest.mark.parametrize("spread", [1, 5, 1000])
def test_nearest_entry_is_exact(count, spread):
    rng = np.random.default_rng(count * spread)
    entries, x = rng.integers(-spread, spread + 1, (count, 4)), rng.integers(-3 * spread, 3 * spread + 1, (4000, 4))
    far = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    code, distance = v.Slices.of(entries).nearest(x)
    assert (code == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()


def test_masks_hold_the_entries_in_the_box():
    rng = np.random.default_rng(3)
    entries, x, radius = rng.integers(-9, 9, (64, 3)), rng.integers(-12, 12, (50, 3)), rng.integers(0, 9, 50)
    inside = (np.abs(x[:, None] - entries[None]) <= radius[:, None, None]).all(axis=2)
    want = [sum(1 << int(e) for e in np.flatnonzero(row)) for row in inside]
    assert v.Slices.of(entries).within(x, radius).tolist() == want
