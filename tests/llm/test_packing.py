import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from basketlens.llm import packing as p


def bins(slots):
    held = defaultdict(list)
    for length, _, times, sequence, offset in slots:
        for i in range(times):
            held[sequence + i].append((offset, length))
    return held


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_whole_gapless_and_tight(seed):
    rng = random.Random(seed)
    lengths = [min(64, max(1, int(rng.lognormvariate(2.5, 1)))) for _ in range(rng.choice((1, 7, 400)))]
    counts = Counter(lengths)
    slots = p.plan(counts, 64)
    used = Counter()
    for length, first, times, _, _ in slots:
        assert first == used[length]
        used[length] += times
    assert used == counts
    held = bins(slots)
    for places in held.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= 64
    bound = -(-sum(lengths) // 64)
    assert len(held) <= bound + max(2, bound // 50) or len(held) <= best(lengths)


def best(lengths):
    """Sequences that best fit decreasing needs, piece by piece."""
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        gap = min(fits) if fits else 64
        if fits:
            gaps.remove(gap)
        gaps.append(gap - x)
    return len(gaps)


@pytest.mark.parametrize("lengths, want", [([60, 4], 1), ([50, 10, 4], 1), ([40, 10, 8, 6], 1), ([33, 33], 2), ([32, 32, 16, 16, 16, 16], 2), ([64] * 5, 5)])
def test_exact_complements(lengths, want):
    assert len(bins(p.plan(Counter(lengths), 64))) == want


def test_bulk_best_fit_is_that_of_single_pieces():
    rng = random.Random(3)
    for _ in range(40):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(1, 60))]
        counts = np.bincount(lengths, minlength=64)
        assert sum(t for _, t in p.best_fit(counts, 64)) == best(lengths)


def test_pack_places_every_piece_once(spark):
    rows = [(i % 97, 1 + (i * i) % 50, "s") for i in range(3000)] + [(None, 7, None)] * 40
    pieces = spark.createDataFrame(rows, "doc_id long, length long, offset string")
    got = p.pack(pieces, capacity=50).collect()
    assert Counter((r["doc_id"], r["length"]) for r in got) == Counter((a, b) for a, b, _ in rows)
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= 50
    assert p.pack(pieces.limit(0), capacity=50).count() == 0


def test_pieces_are_those_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    texts = ["", None, "Hello  world\n\n", "<|endoftext|> ü \U0001f600", "ab " * 3000, "a" * 5000, "x\r\n\t y'll 12345"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = p.token_pieces(docs, p.vocabulary(), capacity=100).collect()
    model = Tokenizer.from_file(p.vocabulary())
    for i, text in enumerate(texts):
        own = sorted((r["piece"], r["start"], r["length"], bytes(r["ids"]), r["ids_crc32"]) for r in found if r["doc_id"] == i)
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert b"".join(x[3] for x in own) == ids.tobytes()
        assert [x[0] for x in own] == list(range(len(own)))
        assert all(x[2] == 100 for x in own[1:]) and all(x[4] == zlib.crc32(x[3]) for x in own)
        assert [x[1] for x in own] == np.cumsum([0, *(x[2] for x in own[:-1])]).tolist()


def test_sums_are_indexed_while_lengths_run_out():
    """Single, pair and triple sums equal those of the lengths left, counted as sets with repetition."""
    rng = np.random.default_rng(5)
    counts = np.where(rng.random(25) < 0.5, rng.integers(1, 4, 25), 0)
    counts[0] = 0
    sums = p.Sums(counts)
    while True:
        left = np.flatnonzero(sums.n).tolist()
        for size, table in ((2, sums.pairs), (3, sums.triples)):
            made = Counter(map(sum, itertools.combinations_with_replacement(left, size)))
            assert {i: n for i, n in enumerate(table.tolist()) if n} == made
        if not left:
            break
        sums.take(int(rng.choice(left)), 1)
