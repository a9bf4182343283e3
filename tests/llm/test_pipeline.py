import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as c
from basketlens.llm import packing, secret_scan
from basketlens.sources.scratch import reserve
from tests.llm.test_jaccard_join import slow as slow_classes

WORDS = [a + b + d for a in "bcdfgklm" for b in "aeiou" for d in ("rin", "tal", "mos", "ven", "dus", "ker")]


def prose(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    items = [(i, " ".join(prose(rng, 25))) for i in range(6)]
    texts, kinds = [], []
    for i in range(420):
        words, kind = prose(rng, rng.randint(30, 120)), i % 7
        if kind == 1:
            words = [rng.choice(WORDS)] * 60
        elif kind == 2 and texts:
            words = texts[rng.randrange(len(texts))].split(" ")
            words[len(words) // 2] = "changed"
        elif kind == 3:
            words[10:10] = rng.choice(items)[1].split()
        elif kind == 4:
            words[5:5] = ["token", "=", "0a" * 20, "user=bob", "pwd=tiger99"]
        texts.append(" ".join(words))
        kinds.append(kind)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(1000, None, "en", "s", None), (1001, "", None, None, 0), (0, texts[0], "en", "s", len(texts[0])), (None, "a text without an id " + " ".join(prose(rng, 20)), "en", "s", 1)]
    labels = [(i, 0 if k == 1 else 1, 0) for i, k in enumerate(kinds) if i % 2 and (k != 2 or i > 300)]
    folder = tmp_path_factory.mktemp("sf")
    for name, data, schema in (
        ("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", items, "item_id long, text string"),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder), kinds, dict(items)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_every_stage_does_what_brute_force_does(spark, corpus):
    folder, kinds, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns

    kept = c.written(c.quality(spark, docs, folder), "t1")
    ids = {i for i, _ in pairs(kept)}
    junk = [i for i, k in enumerate(kinds) if k == 1]
    clean = [i for i, k in enumerate(kinds) if k in (0, 5, 6)]
    assert sum(i in ids for i in junk) <= 0.1 * len(junk) and sum(i in ids for i in clean) >= 0.97 * len(clean)

    once = c.written(c.deduplicate(spark, kept, folder), "t2")
    rows = pairs(kept)
    want = sorted({(d, t) for (d, t), (_, n, first) in zip(sorted(rows, key=str), align(rows), strict=True) if first == d or d is None}, key=str)
    assert sorted(pairs(once), key=str) == want

    clear = c.written(c.decontaminate(spark, once, folder), "t3")
    assert sorted(pairs(clear), key=str) == [(d, t) for d, t in want if not any(x in (t or "") for x in items.values())]

    safe = c.written(c.secrets(spark, clear, folder), "t4")
    before, after = dict(pairs(clear)), {r["doc_id"]: r for r in safe.collect()}
    assert set(before) == set(after) and safe.columns == columns == clear.columns == once.columns == kept.columns
    for doc_id, text in before.items():
        got = after[doc_id]["text"]
        if secret_scan.base_spans(text or ""):
            assert got.count("[SECRET]") == 3 and "0a0a" not in got and "tiger99" not in got and "bob" not in got
            assert after[doc_id]["n_chars"] == len(got)
        else:
            assert got == text

    packed = c.packing(spark, safe, folder).collect()
    check_packing(packed, {d: r["text"] for d, r in after.items()})
    last = c.run(spark, folder)
    key = lambda r: (r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, last.collect())) == sorted(map(key, packed))


def align(rows):
    """Brute-force classes in the order of the sorted rows."""
    classes = defaultdict(list)
    for doc_id, n, first in slow_classes(sorted(rows, key=str)):
        classes[str(doc_id)].append((doc_id, n, first))
    return [classes[str(d)].pop() for d, _ in sorted(rows, key=str)]


def check_packing(rows, texts):
    model = Tokenizer.from_file(packing.vocabulary())
    total, held, pieces = 0, defaultdict(list), defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for doc_id, text in texts.items():
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        own = sorted(pieces.pop(doc_id), key=lambda r: r["piece"])
        assert sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    assert not pieces
    for places in held.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= 2048
    assert len(held) <= -(-total // 2048) + 1


def test_classes_are_told_apart_by_their_texts_not_their_ids(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abc"}
    near = {k: t + " more" for k, t in text.items()}
    rows = [(5, text["a"]), (5, text["b"]), (6, near["b"]), (None, text["c"]), (None, near["c"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {(r["doc_id"], r["text"]) for r in c.deduplicate(spark, docs, "").collect()}
    assert {(5, text["a"]), (5, text["b"])} <= kept and len(kept) == 3
    assert kept - {(5, text["a"]), (5, text["b"])} <= {(None, text["c"]), (None, near["c"])}


def test_deduplicating_leaves_no_signatures_on_the_disk(spark, corpus):
    folder = reserve(spark, "x").rpartition("/")[0]
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    once = c.deduplicate(spark, docs, corpus[0])
    left = {x.rpartition("-")[0] for x in set(os.listdir(folder)) - before}
    assert "classes" in left and "shingle-signatures" not in left
    assert 0 < once.count() < docs.count()
