import math
import random

import numpy as np

from basketlens.llm import quality as q

GOOD = "the of and with house tree river stone light cloud green quiet morning window garden letter winter music".split()


def text(rng, n):
    return " ".join(rng.choice(GOOD) + rng.choice(["", "s", "ing", "er"]) for _ in range(n)).capitalize() + "."


def corpus(seed, n=600):
    """(doc_id, text, bad): clean prose, prose with insults, and three kinds of junk."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        own = text(rng, rng.randint(20, 80))
        kind = rng.random()
        if kind < 0.12:
            words = own.split()
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["blorg", "fnarl", "zwick"]))
            own = " ".join(words)
        elif kind < 0.18:
            own = " ".join([rng.choice(GOOD)] * 60)
        elif kind < 0.24:
            own = " ".join(w + "$$$" for w in own.split())
        elif kind < 0.30:
            own = own.upper() + "!!"
        rows.append((i, own, int(kind < 0.30), int(kind < 0.12)))
    return rows


def frames(spark, rows, labelled=0.5):
    docs = spark.createDataFrame([(i, t, "x") for i, t, *_ in rows], "doc_id long, text string, accepted string")
    some = [(i, 1 if toxic or not bad else 0, toxic) for i, _, bad, toxic in rows if i % 100 < labelled * 100]
    return docs, spark.createDataFrame(some, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows = corpus(1)
    docs, labels = frames(spark, rows)
    got = {r["doc_id"]: r["accepted"] for r in q.classify(docs, labels).collect()}
    unseen = [(i, bad) for i, _, bad, _ in rows if i % 100 >= 50]
    caught = [not got[i] for i, bad in unseen if bad]
    spared = [got[i] for i, bad in unseen if not bad]
    assert sum(caught) >= 0.9 * len(caught) and sum(spared) >= 0.97 * len(spared)


def test_toxic_words_are_found_once_per_family(spark):
    rows = corpus(2)
    docs, labels = frames(spark, rows)
    words = q.toxic_words(docs, labels)
    assert {"blorg", "fnarl", "zwick"} <= set(words)
    copies = [(1000 + k, "family only uniqueword in here " + "same " * k, 1, 1) for k in range(40)]
    docs, labels = frames(spark, rows + copies, 1.0)
    assert "uniqueword" not in q.toxic_words(docs, labels)


def test_expectation_maximisation_finds_the_rates():
    rng = np.random.default_rng(3)
    n = 40_000
    bad = rng.random(n) < 0.2
    names = len(q.LABELLERS)
    cast = np.full((n, names), q.NONE)
    for j in range(names - 1):
        right, fires = 0.95 - 0.03 * j, 0.3 + 0.05 * j
        says = np.where(rng.random(n) < right, bad, ~bad)
        cast[:, j] = np.where(rng.random(n) < fires, np.where(says, q.BAD, q.GOOD), q.NONE)
    cast[:, -1] = np.where(rng.random(n) < 0.2, np.where(bad, q.BAD, q.GOOD), q.NONE)
    code = cast @ (3 ** np.arange(names - 1, -1, -1))
    values, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    posterior = q.expectation_maximisation(dict(zip(values.tolist(), counts.tolist(), strict=True)))
    judged = np.array([posterior[c] for c in values.tolist()])[inverse]
    assert ((judged > 0.5) == bad).mean() > 0.93
    assert abs(judged.mean() - 0.2) < 0.03
    assert q.expectation_maximisation({}) == {}


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "plain words of a text"), (3, "a " * 100_000), (3, "a " * 100_000), (4, "\x00 |||")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, bad_score double")
    labels = spark.createDataFrame([(1, None, None), (None, 0, 1), (3, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = q.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["bad_score"] <= 1 for r in got)
    assert len({r["bad_score"] for r in got if r["doc_id"] == 3}) == 1
    assert q.classify(docs.limit(0), labels).count() == 0
    assert q.classify(docs, labels.limit(0)).count() == len(rows)


def slow_posteriors(cast):
    """P(bad) of every document by expectation-maximisation over single documents, in plain Python."""
    names = len(q.LABELLERS)
    bad = []
    for own in cast:
        says_bad = own[-1] == q.BAD if own[-1] != q.NONE else q.BAD in own
        bad.append(0.95 if says_bad else 0.05)
    for _ in range(q.EM_STEPS):
        classes = []
        for weights in (bad, [1 - b for b in bad]):
            total = sum(weights)
            rates = [[(sum(w for w, own in zip(weights, cast, strict=True) if own[j] == v) + 0.5) / (total + 1.5) for v in range(3)] for j in range(names)]
            classes.append((total + 1, rates))
        right = q.LABEL_RIGHT
        classes[0][1][-1], classes[1][1][-1] = [right, 1, 1 - right], [1 - right, 1, right]
        new = []
        for own in cast:
            a, b = (math.log(prior) + sum(math.log(rates[j][v]) for j, v in enumerate(own)) for prior, rates in classes)
            new.append(1 / (1 + math.exp(-max(-50, min(50, a - b)))))
        bad = new
    return bad


def slow_scorer(rows):
    """Logistic regression by AdaGrad, one weight at a time."""
    weights, seen, bias, bias_seen = {}, {}, 0.0, 1e-2
    order = np.random.default_rng(7)
    for _ in range(q.EPOCHS):
        for i in order.permutation(len(rows)):
            buckets, values, target = rows[i]
            z = bias + sum(weights.get(b, 0.0) * v for b, v in zip(buckets, values, strict=True))
            error = 1 / (1 + math.exp(-z)) - target
            for b, v in zip(buckets, values, strict=True):
                seen[b] = seen.get(b, 1e-2) + (error * v) ** 2
                weights[b] = weights.get(b, 0.0) - 0.3 * error * v / math.sqrt(seen[b])
            bias_seen += error**2
            bias -= 0.3 * error / math.sqrt(bias_seen)
    return lambda buckets, values: 1 / (1 + math.exp(-bias - sum(weights.get(b, 0.0) * v for b, v in zip(buckets, values, strict=True))))


def test_scores_equal_those_of_single_documents(spark):
    """The whole way over vote patterns, joins and samples gives what plain loops over the documents give."""
    rows = corpus(4, 150)
    docs, labels = frames(spark, rows)
    got = {r["doc_id"]: r["bad_score"] for r in q.classify(docs, labels).collect()}
    lexicon = q.toxic_words(docs, labels)
    labelled = {r["doc_id"]: q.BAD if r["quality"] == 0 or r["toxic"] == 1 else q.GOOD for r in labels.collect()}
    key = {r["doc_id"]: r["key"] for r in docs.select("doc_id", q.row_key(docs).alias("key")).collect()}
    cast, features = {}, {}
    for i, own, *_ in rows:
        words, s = q.statistics(own, lexicon)
        code = q.votes(s)
        cast[i] = [code // 3**j % 3 for j in range(len(q.LABELLERS) - 2, -1, -1)] + [labelled.get(i, q.NONE)]
        features[i] = [x.tolist() for x in q.features(words, s)]
        # distinct buckets: the plain update of one weight at a time is the same step
        merged = {}
        for b, v in zip(*features[i], strict=True):
            assert merged.setdefault(b, v) == v
        features[i] = (list(merged), list(merged.values()))
    posterior = dict(zip(cast, slow_posteriors(list(cast.values())), strict=True))
    score = slow_scorer([(*features[i], posterior[i]) for i in sorted(cast, key=key.get)])
    assert len(got) == len(rows)
    assert max(abs(got[i] - score(*features[i])) for i in got) < 1e-4
