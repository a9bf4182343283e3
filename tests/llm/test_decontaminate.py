import random

from basketlens.llm import decontaminate as d
from basketlens.llm import tables

WORDS = [f"w{i}" for i in range(400)]


def passage(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def slow(doc, item):
    """Tokens that agree in the best-scoring run, over all diagonals; by all runs."""
    best = 0
    for diagonal in range(-len(item), len(doc)):
        same = [doc[i + diagonal] == w for i, w in enumerate(item) if 0 <= i + diagonal < len(doc)]
        top = (0, 0)
        for i in range(len(same)):
            score = matched = 0
            for x in same[i:]:
                score, matched = score + (1 if x else d.MISMATCH), matched + x
                top = max(top, (score, matched))
        best = max(best, top[1])
    return best


def leaks(spark, docs, items):
    a = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    return {(r["doc_id"], r["item_id"]): r for r in d.find_leaks(a, b).collect()}


def test_substituted_passages_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(5)
    items = [(i, passage(rng, rng.randint(14, 60))) for i in range(12)]
    docs, planted = [], {}
    for k in range(120):
        doc = passage(rng, rng.randint(0, 80))
        if k % 2:
            i, item = rng.choice(items)
            copy = [w if j % 7 != k % 7 or k % 4 == 1 else "other" for j, w in enumerate(item)]
            at = rng.randint(0, len(doc))
            doc[at:at] = copy
            planted[k] = i
        docs.append((k, doc))
    got = leaks(spark, [(k, "  ".join(w).upper(), "x") for k, w in docs], [(i, " ".join(w), "y") for i, w in items])
    assert {k: i for k, i in got} == planted
    for k, doc in docs[:30]:
        for i, item in items:
            most = slow(doc, item)
            assert ((k, i) in got) == (most >= d.LEAST_TOKENS)
            if (k, i) in got:
                r = got[k, i]
                assert r["matched"] == most
                run = range(r["length"])
                assert sum(doc[r["doc_start"] + j] == item[r["item_start"] + j] for j in run) == most


def test_every_mask_position_can_be_substituted_alone(spark):
    item = [f"t{i}" for i in range(14)]
    docs = [(j, " ".join("zz" if i == j else w for i, w in enumerate(item)), None) for j in range(14)]
    assert set(leaks(spark, docs, [(1, " ".join(item), None)])) == {(j, 1) for j in range(14)}


def test_edges(spark):
    text = " ".join(f"t{i}" for i in range(20))
    docs = [(1, None, None), (2, "", None), (3, text, None), (3, text, None), (None, text, None), (4, "t0 t1 t2", None)]
    items = [(1, text, None), (1, text, None), (2, None, None), (3, "t0 t1 t2", None), (None, text + " more", None)]
    assert set(leaks(spark, docs, items)) == {(3, 1), (3, None), (None, 1), (None, None)}
    assert not leaks(spark, docs[:0] or [(9, "", None)], items)
    a = spark.createDataFrame([], "doc_id long, text string")
    assert d.find_leaks(a, a.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_the_other_join_gives_the_same(spark, monkeypatch):
    text = " ".join(f"t{i}" for i in range(30))
    docs = [(i, f"a{i} {text} b{i}", None) for i in range(20)]
    first = leaks(spark, docs, [(1, text, None)])
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 0)
    assert leaks(spark, docs, [(1, text, None)]) == first and len(first) == 20


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = d.find_leaks(docs, docs.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_short_items_and_every_fourth_token(spark):
    docs, items, want = [], [], set()
    for n in range(9, 15):
        item = [f"n{n}t{i}" for i in range(n)]
        items.append((n, " ".join(item), None))
        for j in range(-1, n):  # whole, then each token replaced
            docs.append((100 * n + j + 1, "a b " + " ".join("zz" if i == j else w for i, w in enumerate(item)) + " c", None))
            want.add((docs[-1][0], n))
        docs.append((100 * n + 50, " ".join(item[: n * 2 // 3]), None))
    long = [f"x{i}" for i in range(40)]
    items.append((1, " ".join(long), None))
    for r in range(4):
        docs.append((r, " ".join(f"y{i}" if i % 4 == r else w for i, w in enumerate(long)), None))
        want.add((r, 1))
    assert set(leaks(spark, docs, items)) == want
