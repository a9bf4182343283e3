import os
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from basketlens.llm import jaccard_join as j
from basketlens.llm.shingles import shingle_set
from basketlens.sources.scratch import reserve, written

WORDS = [f"w{i}" for i in range(3000)]


def slow_set(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow(rows):
    sets = [slow_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        members = [rows[k][0] for k in range(len(rows)) if find(k) == find(i) and rows[k][0] is not None]
        out.append((doc_id, len(sets[i]), min(members, default=None)))
    return sorted(out, key=str)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.6:
            words[at] = rng.choice(WORDS)
        elif kind < 0.8:
            words.insert(at, rng.choice(WORDS))
        else:
            del words[at]
    return words


def corpus(rng, n):
    shared = [rng.choice(WORDS) for _ in range(60)]
    rows = []
    while len(rows) < n:
        base = [rng.choice(WORDS) for _ in range(rng.choice((5, 8, 12, 30, 90, 300)))]
        if rng.random() < 0.4:
            base[2:2] = shared
        for _ in range(rng.choice((1, 1, 2, 5, 14))):
            rows.append(edited(rng, base, rng.randint(0, max(1, len(base) // 30))))
    return [(i, " ".join(w)) for i, w in enumerate(rows[:n])]


@pytest.mark.parametrize("small, block, common", [(8, 1000, 3), (2, 4, 2), (8, 1000, 10**9)])
def test_classes_equal_brute_force(spark, monkeypatch, small, block, common):
    monkeypatch.setattr(j, "SMALL_GROUP", small)
    monkeypatch.setattr(j, "BLOCK", block)
    rows = corpus(random.Random(small + block), 350)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    if common > 10:
        monkeypatch.setattr(j, "common_shingles", lambda docs: np.zeros(0, np.uint64))
    got = j.jaccard_classes(df).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == slow(rows)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(9)
    for n in (4, 5, 7, 9, 13, 20, 40, 77, 150, 400, 1500):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            most = int(Fraction(2 * n, 9))
            take = rng.integers(0, most // 2 + 1)
            b = np.unique(np.r_[rng.permutation(a)[take:], rng.integers(0, 1 << 63, rng.integers(0, most // 2 + 1)).astype(np.uint64)])
            both = len(np.intersect1d(a, b))
            if 5 * both < 4 * (len(a) + len(b) - both) or np.array_equal(a, b):
                continue
            common = rng.permutation(np.r_[a, b])[: rng.integers(0, n)]
            common = np.unique(common)
            assert np.intersect1d(j.signatures(a, common), j.signatures(b, common)).size, (n, len(a), len(b), both)


def test_edges(spark):
    long = " ".join(f"x{i}" for i in range(20_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A"), (6, "a b c d"), (7, "A\x0bb  C\rd"), (8, "a b c d e"), (9, "é a"), (9, "é a"),
        (None, "a"), (None, "solo text of its own here"), (20, long), (21, long + " y"), (22, "e a b c d"), (None, None),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in j.jaccard_classes(df).collect()), key=str)
    want = [(d, n, None if n == 0 and d is None else c) for d, n, c in slow(rows)]
    assert got == want
    assert j.jaccard_classes(df.limit(0)).count() == 0


def test_shingles_of_bytes_are_those_of_text():
    for text in ("Ä b c d e f g", "a b c", "x " * 50, "one two three four five six seven one two three four five"):
        assert len(shingle_set(text)) == len(slow_set(text))


def near_copies(rng, texts, copies):
    """Texts of 200 words, each with near copies that differ by one word."""
    rows = []
    for _ in range(texts):
        base = [rng.choice(WORDS) for _ in range(200)]
        for _ in range(copies):
            words = list(base)
            words[rng.randrange(200)] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(words)))
    return rows


def test_signatures_of_one_family_are_dropped_and_leave_the_disk(spark, monkeypatch):
    tables = {}

    def spied(df, name):
        tables[name] = found = written(df, name)
        tables[f"{name} rows"] = found.count()
        return found

    monkeypatch.setattr(j, "written", spied)
    folder = reserve(spark, "x").rpartition("/")[0]
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = near_copies(random.Random(3), 30, 12)
    got = j.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert tables["shared-signatures rows"] <= len(rows)  # each of a family's signatures was a row for each copy
    assert not [x for x in set(os.listdir(folder)) - before if x.startswith("shingle-signatures")]
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str) == slow(rows)


def test_families_beyond_the_limits_of_tables_sent_to_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(j, "MOVED_ROWS", 20)
    monkeypatch.setattr(j, "BROADCAST_ROWS", 50)
    monkeypatch.setattr(j, "SLICES", 3)
    rng = random.Random(8)
    rows = near_copies(rng, 12, 12) + [(i + 1000, t) for i, t in corpus(rng, 120)]
    rows += [(i + 5000, t) for i, t in rows[::5]]
    got = j.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == slow(rows)


def test_blocks_hold_each_signature_of_each_row(monkeypatch):
    monkeypatch.setattr(j, "BLOCK_SIGNATURES", 500)
    monkeypatch.setattr(j, "LEAST_BLOCK", 1)
    rng = np.random.default_rng(4)
    row = np.sort(np.r_[rng.choice(200_000, 150, replace=False), (1 << 33) + rng.choice(70_000, 50, replace=False)])
    sigs = [np.unique(rng.integers(0, 400, rng.integers(0, 40))).astype(np.uint64) << np.uint64(16) for _ in row]
    whole = pa.record_batch({"row": pa.array(row), "signatures": pa.array([j.packed(s) for s in sigs], pa.binary())})
    batches = [whole.slice(i, 30) for i in range(0, len(row), 30)]
    moved = (row[1::4], row[0::4][: len(row[1::4])])
    family = dict(zip(row.tolist(), row.tolist(), strict=True)) | dict(zip(*map(np.ndarray.tolist, moved), strict=True))
    groups = {}
    for r, own in zip(row.tolist(), sigs, strict=True):
        for s in own.tolist():
            groups.setdefault(s, set()).add(family[r])
    want = sorted(sorted(g) for g in groups.values() if len(g) > 1)
    buckets = {}
    for batch in j.dealt_blocks(iter(batches), 7):
        for bucket, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            buckets.setdefault(bucket, []).append(block)
    found = [group for blocks in buckets.values() for group in j.met_groups(blocks, moved).to_pylist()]
    assert len(buckets) == 7 and sorted(found) == want


def test_texts_thaw_as_they_were():
    for text in ("", "a", "Ä b\n" * 1000, "\x00 \u2028"):
        assert j.thawed(j.frozen(text)) == text
