import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from basketlens.llm import pitman_yor as p


def tokens(text):
    return (text or "").encode().lower().split() + [b"\0end"]


def slow(rows):
    out = {i: zlib.crc32((str(i) if i is not None else "").encode()) % 10 == 0 for i, _ in rows}
    count = Counter()
    for i, t in rows:
        if not out[i]:
            count.update(tokens(t))
    n, v = sum(count.values()), len(count)
    base = [sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)) for _, t in rows]
    return [(i, out[i], len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, b) for (i, t), b in zip(rows, base, strict=True)]


def corpus(seed, n=400):
    """Texts of a chain: the next word depends on the last."""
    rng = random.Random(seed)
    follow = {i: [rng.randrange(60) for _ in range(4)] for i in range(60)}
    rows = []
    for i in range(n):
        at, words = rng.randrange(60), []
        for _ in range(rng.randint(0, 60)):
            at = rng.choice(follow[at]) if rng.random() < 0.9 else rng.randrange(60)
            words.append(f"W{at}" if rng.random() < 0.98 else f"rare{rng.randrange(10**6)}")
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("most", [1, 7, 10**6])
def test_sums_are_combined_whole(most):
    import pandas as pd

    rng = np.random.default_rng(3)
    frames = [
        pd.DataFrame({"key": rng.permutation(20)[:n], "score": rng.random(n), "base_score": rng.random(n), "n_tokens": rng.integers(0, 1 << 40, n), "n_known": rng.integers(0, 9, n)})
        for n in rng.integers(0, 20, 12)
    ]
    every, got = pd.concat(frames), pd.concat(list(p.combined(iter(frames), most)))
    pd.testing.assert_frame_equal(every.groupby("key").sum(), got.groupby("key").sum(), check_dtype=False)
    assert len(got) <= len(every) and (most < 100 or len(got) == 20)


@pytest.mark.parametrize("chunk, bucket", [(10**6, 3 * 10**6), (300, 500)])
def test_base_columns_equal_brute_force(spark, monkeypatch, chunk, bucket):
    monkeypatch.setattr(p, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(p, "BUCKET_TOKENS", bucket)
    rows = [*corpus(1), (None, "w1 w2"), (1000, None), (1001, "X" * 100_000), (1002, "w1 " * 30_000)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double").repartition(3)
    got = {r["doc_id"]: r for r in p.score_texts(df).collect()}
    assert len(got) == len(rows)
    for i, out, n, known, train, base in slow(rows):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out, n, known, train)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0


def test_held_out_perplexity_beats_single_words(spark):
    rows = corpus(2, 900)
    got = [r for r in p.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["held_out"]]
    n = sum(r["n_tokens"] for r in got)
    model, base = (10 ** (-sum(r[c] for r in got) / n) for c in ("score", "base_score"))
    assert model < 0.6 * base


def test_parent_probabilities_sum_to_one():
    """Over all known words and one unknown, given a seating."""
    rng = np.random.default_rng(5)
    tables = rng.integers(1, 60, 200)
    everything = p.All(9999, len(tables), float(tables.sum()), 300.0)
    for _ in range(4):
        parent = p.draw_parent(rng, tables, np.minimum(tables, 1), everything.parent, everything.base)
        everything.parent = float(parent.sum())
        assert everything.of_word(tables, parent).sum() + everything.of_word(0, 0) == pytest.approx(1)


def test_counts_are_packed_whole():
    for counts in ([1, 5], [1, 300], [70_000, 0], [1, 5 << 32], [0], []):
        assert p.unpacked(p.packed(np.array(counts, np.int64)), len(counts)).tolist() == counts


def test_unsettled_sampling_is_reported(spark, monkeypatch):
    monkeypatch.setattr(p, "MOST_BURN_IN", 1)
    docs = spark.createDataFrame(corpus(4, 100), "doc_id long, text string")
    with pytest.warns(UserWarning, match="not settled after 1 sweeps"):
        p.score_texts(docs)


def test_tokens_stay_in_their_buckets(spark):
    """The plan that scores the texts shuffles messages, not the table of tokens."""
    docs = spark.createDataFrame(corpus(3, 200), "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(doc_id, text) as key", "false as held_out")
    often = p.frequent_words(docs)
    each, _ = p.scored(p.units(p.token_blocks(docs, often, 8), 8), often, 8, 1)
    plan = each._jdf.queryExecution().executedPlan().toString()
    below = plan.partition("FlatMapCoGroupsInPandas")[2]
    scan = next(line for line in below.splitlines() if "FileScan parquet" in line and "bucket#" in line)
    assert "spark_catalog.default.basketlens_" in scan and "Bucketed: true" in scan
    assert "Exchange" not in below[: below.index(scan)]


def test_repeated_rows_and_empty_table(spark):
    rows = [(3, "w1 w2 w3"), (3, "w1 w2 w3"), (5, "w1"), (7, "w9 w1 w2")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_tokens"], r["base_score"]) for r in p.score_texts(df).collect())
    want = sorted((i, n, b) for i, _, n, _, _, b in slow(rows))
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want])
    assert p.score_texts(df.limit(0)).count() == 0
    only = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    held = p.score_texts(spark.createDataFrame([(i, "a b") for i in only], "doc_id long, text string")).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in held)


def held_ids():
    return (i for i in range(10**6, 10**8) if zlib.crc32(str(i).encode()) % 10 == 0)


def test_scores_of_all_texts_sum_to_one(spark):
    """Every text of known words and an unknown one: the sum over all lengths, from texts of two words at most."""
    rng, ids = random.Random(8), held_ids()
    train = [(i, " ".join(f"w{min(rng.randrange(12), rng.randrange(12))}" for _ in range(rng.randint(1, 30)))) for i in range(400)]
    words = [f"w{i}" for i in range(12)] + ["unknown"]
    asked = [()] + [(w,) for w in words] + [(u, w) for u in words for w in words]
    rows = [(next(ids), " ".join(t)) for t in asked]
    got = {r["doc_id"]: 10 ** r["score"] for r in p.score_texts(spark.createDataFrame(train + rows, "doc_id long, text string"), samples=1).collect()}
    chance = {t: got[i] for t, (i, _) in zip(asked, rows, strict=True)}
    one = np.array([chance[w,] for w in words])
    step = np.array([[chance[u, w] for w in words] for u in words]) / one  # P(u | start) P(w | u) / P(w | start)
    total = chance[()] + np.linalg.solve(np.eye(len(words)) - step, one).sum()
    assert total == pytest.approx(1, rel=1e-5)


def test_number_of_tables_follows_its_exact_conditional(monkeypatch):
    c, above, of_word, parent, everything = 6, 3, 4, 2, 50.0
    log = []
    for t in range(1, c + 1):
        new = math.prod((p.STRENGTH + p.DISCOUNT * (above + j)) / (p.PARENT_STRENGTH + everything - 1 + j) for j in range(t))
        half = lambda n, k: math.comb(2 * n - k - 1, n - 1) * 4.0 ** (k - n) * math.gamma(n) / math.gamma(k)
        log.append(p.stirling()[c, t] + math.log(new * half(of_word + t, parent)))
    want = np.exp(log) / np.exp(log).sum()
    n = 20_000
    full = lambda x: np.full(n, x)
    rng = np.random.default_rng(4)
    got = p.draw_cells(rng, full(c), full(1), full(above + 1), full(of_word + 1), full(parent), everything)
    assert np.bincount(got, minlength=c + 1)[1:] / n == pytest.approx(want, abs=0.015)
    sizes, seen = np.array([c]), []
    for _ in range(n // 2):
        sizes = p.reseat(rng, sizes, above, of_word, parent, everything - 1)
        assert sizes.sum() == c
        seen.append(len(sizes))
    assert np.bincount(seen, minlength=c + 1)[1:] / len(seen) == pytest.approx(want, abs=0.03)
    base, others = 0.01, 40.0
    log = [math.log(half(5, k) * math.prod((p.PARENT_STRENGTH + p.PARENT_DISCOUNT * (others + j)) * base for j in range(k))) for k in range(1, 6)]
    got = p.draw_parent(rng, full(5), full(3), others + 3, base)
    assert np.bincount(got, minlength=6)[1:] / n == pytest.approx(np.exp(log) / np.exp(log).sum(), abs=0.015)


def test_rare_words_are_contexts_whatever_the_size(spark):
    """Each of 400 words occurs four times in 400,000 tokens, always before its own word."""
    rng, ids = random.Random(6), held_ids()
    train = [(10 * i + 1, " ".join(f"w{rng.randrange(50)}" for _ in range(4000))) for i in range(110)]
    train += [(10**5 + i, f"rare{i % 400} w{i % 50}") for i in range(1600)]
    asked = [(next(ids), f"rare{i} w{(i + d) % 50}") for i in range(0, 400, 10) for d in (0, 7)]
    got = {r["doc_id"]: r["score"] for r in p.score_texts(spark.createDataFrame(train + asked, "doc_id long, text string")).collect()}
    gain = [got[right] - got[wrong] for (right, _), (wrong, _) in zip(asked[::2], asked[1::2], strict=True)]
    assert np.median(gain) > math.log10(5)


def test_ends_of_texts_are_spread_over_the_buckets(spark):
    rows = [(i, f"w{i % 300} w{i % 7}", False) for i in range(3000)]
    docs = spark.createDataFrame(rows, "key long, text string, held_out boolean")
    end = p.word_hashes([p.END])[0]
    blocks = p.token_blocks(docs, p.frequent_words(docs), 16).collect()
    assert len({r["bucket"] for r in blocks if end in np.frombuffer(r["word"], np.uint64)}) > 3


def test_blocks_name_rare_contexts_and_texts_once(spark):
    """Blocks, the disk's largest share, take few bytes a token; a rare word before many frequent ones is named in one bucket."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(40)}" if j % 3 else f"rare{rng.randrange(3000)}" for j in range(90)), False) for i in range(1200)]
    docs = spark.createDataFrame(rows, "key long, text string, held_out boolean").repartition(2)
    frequent = np.sort(np.array([p.word_hashes([f"w{i}".encode()])[0] for i in range(40)] + [p.word_hashes([p.END])[0]]))
    blocks = p.token_blocks(docs, frequent, 32).collect()
    rare = set(p.word_hashes([f"rare{i}".encode() for i in range(3000)]).tolist())
    buckets = [{r["bucket"] for r in blocks if c in np.frombuffer(r["contexts"], np.uint64)} for c in list(rare)[:50]]
    assert max(map(len, buckets)) <= 1
    assert sum(len(x) for r in blocks for x in r[1:]) < 10 * 1200 * 91


def test_texts_are_told_apart_whatever_chunk_they_are_in(spark, monkeypatch):
    monkeypatch.setattr(p, "CHUNK_TOKENS", 50)
    rows = [(7 * i, f"a{i} b{i % 9} c", i % 4 == 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "key long, text string, held_out boolean").repartition(3)
    table = p.units(p.token_blocks(docs, np.zeros(0, np.uint64), 8), 8)
    key = {r["text"]: r["key"] for r in p.text_keys(table).collect()}
    assert sorted(key.values()) == [r[0] for r in rows]
    got = Counter()
    for r in p.only_units(table).toPandas().itertuples(index=False):
        words, _, word, _, _, size, text, texts = p.unpack(r)
        for w, t in zip(np.repeat(word, size), text, strict=True):
            got[key[int(texts[t])], int(words[w])] += 1
    want = Counter((k, int(h)) for k, t, _ in rows for h in p.word_hashes([*t.encode().split(), p.END]))
    assert got == want


def test_words_are_split_as_everywhere():
    import pyarrow as pa

    from basketlens.llm.shingles import word_list

    texts = ["", " \t", "A b\x0bC\x0cd\r\n", "x\x1cy z\x85 É é \x00q ", "one", "  Two  three"]
    words, lengths = p.split_words(pa.array(texts))
    assert [len(word_list(t)) for t in texts] == lengths.tolist()
    assert words.to_pylist() == [w for t in texts for w in word_list(t)]


def test_counts_are_squeezed_whole():
    for counts in ([1, 5], [1, 300], [70_000, 0], [1, 5 << 32], [0], []):
        assert p.unsqueezed(p.squeezed(np.array(counts, np.int64))).tolist() == counts


def test_long_and_empty_texts_make_slices_whole():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"text": x}) for x in (["a " * 50, "", "b"], [""] * 9, ["c d " * 4] * 5)]
    got = [(b.column("text").to_pylist(), n) for b, n in p.slices(iter(batches), 6)]
    assert [t for x, _ in got for t in x] == [t for b in batches for t in b.column("text").to_pylist()]
    assert [n for _, n in got] == np.cumsum([0, *[len(x) for x, _ in got][:-1]]).tolist()
