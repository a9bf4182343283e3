"""Quality classifier: a weak-label model and a hashed linear scorer.

1. Heuristic labellers vote bad, good or nothing on every document; one knows words that mark
   toxic documents, one knows the given labels. Votes are a small integer per document.
2. Expectation-maximisation over the counts of vote patterns (at most 3^labellers of them, over
   all documents) estimates how often each labeller votes what in each class, and with that the
   posterior of every pattern.
3. A logistic regression on hashed words and bucketed statistics is trained on a sample of
   ``TRAIN_DOCS`` documents with their posteriors, and scores every document.

The texts never move: they are scanned for votes, for the sample and for the scores. What moves
is one integer per document that is joined with its label. The word list, the patterns, the
sample and the weights have fixed bounds.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm.tables import table
from basketlens.sources.scratch import written

BUCKETS = 1 << 18
LEXICON_DOCS = 10_000  # labelled documents that the word list is taken from
LEXICON_WORDS = 2_000
LEXICON_Z = 3.0
MARKED_AT = 0.5  # sum of the log odds of marked words
TRAIN_DOCS = 8_000
EPOCHS = 6
REJECT_AT = 0.5  # probability of bad
EM_STEPS = 60
#: The labels are right this often; the other rates are estimated.
LABEL_RIGHT = 0.999

BAD, NONE, GOOD = 0, 1, 2
LABELLERS = ("repeats", "lines", "symbols", "cells", "shouts", "variety", "lexicon", "fluent", "labels")
SYMBOLS = "$&*#%|~^<>{}\\"
STEP_AT = {"marked": 20 * MARKED_AT, "repeats": 0.4, "symbols": 0.2, "cells": 0.5}  # largest step of a statistic
WORD = re.compile(r"[^\W\d_]+")
STATS = ("repeats", "lines", "symbols", "cells", "shouts", "variety", "length", "marked")


@dataclass(frozen=True)
class Scorer:
    """Everything that a worker needs to score a text."""

    lexicon: dict[str, float]
    weights: np.ndarray
    bias: float


def statistics(text: str, lexicon: dict[str, float]) -> tuple[list[str], dict[str, float]]:
    """The words of the text, and shares that the labellers look at."""
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    marked = sum(map(lexicon.get, WORD.findall(text.lower()), repeat(0.0))) if lexicon else 0.0
    return words, {
        "repeats": sum(map(str.__eq__, words[1:], words)) / n,
        "lines": 1 - len(set(lines)) / len(lines) if len(lines) > 3 else 0.0,
        "symbols": sum(map(text.count, SYMBOLS)) / max(1, len(text)),
        "cells": text.count("|") / n,
        "shouts": (sum(w.isupper() and len(w) > 2 for w in words) + text.count("!!")) / n,
        "variety": len(set(words)) / n,
        "length": float(len(words)),
        "marked": marked,
    }


def votes(s: dict[str, float]) -> int:
    """The votes of all labellers but the labels, in base 3."""
    clean = s["repeats"] < 0.02 and s["symbols"] < 0.01 and s["shouts"] < 0.1 and s["lines"] < 0.3
    cast = (
        BAD if s["repeats"] > 0.1 else NONE,
        BAD if s["lines"] > 0.5 else NONE,
        BAD if s["symbols"] > 0.03 else NONE,
        BAD if s["cells"] > 0.15 else NONE,
        BAD if s["shouts"] > 0.25 else NONE,
        BAD if s["variety"] < 0.25 and s["length"] < 2000 and s["length"] > 20 else NONE,
        BAD if s["marked"] >= MARKED_AT else NONE,
        GOOD if clean and s["length"] >= 3 and s["marked"] < MARKED_AT else NONE,
    )
    code = 0
    for vote in cast:
        code = code * 3 + vote
    return code


def features(words: list[str], s: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: distinct words with a common small value, and steps of each statistic."""
    own = {zlib.crc32(w.lower().encode("utf-8", "replace")) % BUCKETS for w in set(words)}
    steps = []
    for name in STATS:
        x = s[name]
        level = int(np.log2(x + 1)) if name == "length" else int(min(1.0, x / STEP_AT.get(name, 1.0)) * 20)
        upto = range(1, level + 1) if name != "length" else [level]
        steps += [zlib.crc32(f"\x00{name}:{i}".encode()) % BUCKETS for i in upto]
    buckets = np.fromiter((*own, *steps), dtype=np.int32, count=len(own) + len(steps))
    values = np.full(len(buckets), 0.3 / np.sqrt(max(1, len(own))), dtype=np.float32)
    values[len(own) :] = 1.0
    return buckets, values


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression for P(bad) on soft labels, by AdaGrad in a fixed order."""
    weights, seen = np.zeros(BUCKETS, np.float64), np.full(BUCKETS, 1e-2)
    bias, bias_seen = 0.0, 1e-2
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            buckets, values, target = rows[i]
            error = 1 / (1 + np.exp(-(weights[buckets] @ values + bias))) - target
            step = error * values
            seen[buckets] += step * step
            weights[buckets] -= rate * step / np.sqrt(seen[buckets])
            bias_seen += error * error
            bias -= rate * error / np.sqrt(bias_seen)
    return weights.astype(np.float32), float(bias)


def expectation_maximisation(patterns: dict[int, int], n_labellers: int = len(LABELLERS), steps: int = EM_STEPS) -> dict[int, float]:
    """P(bad) of every vote pattern, given how many documents have it.

    Classes start from the votes themselves (bad where any labeller says so). Votes are taken
    as independent given the class; the last labeller's rates are fixed.
    """
    if not patterns:
        return {}
    codes = np.array(sorted(patterns))
    counts = np.array([patterns[c] for c in codes], dtype=float)
    cast = np.array([[c // 3 ** (n_labellers - 1 - j) % 3 for j in range(n_labellers)] for c in codes.tolist()])
    bad = np.where(cast[:, -1] != NONE, cast[:, -1] == BAD, (cast == BAD).any(axis=1)).astype(float) * 0.9 + 0.05
    one_hot = cast[:, :, None] == np.arange(3)
    for _ in range(steps):
        log_odds = np.zeros(len(codes))
        for sign, q in ((1, bad), (-1, 1 - bad)):
            mass = counts * q
            log_odds += sign * np.log(mass.sum() + 1)
            rates = (np.einsum("p,pjv->jv", mass, one_hot) + 0.5) / (mass.sum() + 1.5)
            rates[-1] = [LABEL_RIGHT, 1, 1 - LABEL_RIGHT] if sign > 0 else [1 - LABEL_RIGHT, 1, LABEL_RIGHT]
            log_odds += sign * np.einsum("jv,pjv->p", np.log(rates), one_hot)
        bad = 1 / (1 + np.exp(-np.clip(log_odds, -50, 50)))
    return dict(zip(codes.tolist(), bad.tolist(), strict=True))


def label_votes(labels: DataFrame) -> DataFrame:
    """(doc_id, label_vote): bad if any row says low quality or toxic; nothing where a label is missing."""
    worst = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic")
    )
    vote = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), BAD).when((F.col("quality") == 1) & (F.col("toxic") == 0), GOOD)
    return worst.select("doc_id", "toxic", F.coalesce(vote, F.lit(NONE)).alias("label_vote"))


def toxic_words(docs: DataFrame, labels: DataFrame) -> dict[str, float]:
    """Words that stand in toxic texts in more than half of all cases, with a margin of ``LEXICON_Z`` deviations.

    Each has the log odds of the lower bound of its share, so that a word known from few cases counts little.

    A case is a family of texts: those with the same smallest hash of a word pair, so that near
    copies of one text do not count as so many. Taken from the ``LEXICON_DOCS`` labelled documents with the smallest hashes.
    """
    some = label_votes(labels).where(F.col("toxic").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LEXICON_DOCS)

    def cases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(words: list[str], families: list[int], toxic: list[float]) -> pd.DataFrame:
            return pd.DataFrame({"word": pd.Series(words, dtype=object), "family": families, "toxic": toxic})

        for batch in batches:
            words, families, toxic = [], [], []
            for text, is_toxic in zip(batch["text"], batch["toxic"], strict=True):
                own = WORD.findall((text or "").lower())
                family = min((zlib.crc32(f"{a} {b}".encode("utf-8", "replace")) for a, b in pairwise(own)), default=0)
                distinct = {w for w in own if len(w) > 1}
                words += distinct
                families += [family] * len(distinct)
                toxic += [float(is_toxic)] * len(distinct)
                if len(words) > 100_000:
                    yield frame(words, families, toxic)
                    words, families, toxic = [], [], []
            yield frame(words, families, toxic)

    texts = docs.join(F.broadcast(some), "doc_id").select("text", "toxic")
    each = texts.mapInPandas(cases, "word string, family long, toxic double")
    cases_of = each.groupBy("word", "family").agg(F.max("toxic").alias("toxic"))
    n, zz = F.col("n"), LEXICON_Z**2
    p = F.col("k") / n
    low = (p + zz / (2 * n) - LEXICON_Z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)
    marks = cases_of.groupBy("word").agg(F.sum("toxic").alias("k"), F.count(F.lit(1)).alias("n")).withColumn("low", low)
    chosen = marks.where("low >= 0.5").orderBy(F.desc("low"), "word").limit(LEXICON_WORDS).collect()
    return {r["word"]: math.log(r["low"] / (1 - r["low"])) for r in chosen}


def row_key(docs: DataFrame) -> Column:
    return F.xxhash64("doc_id", "text")


def vote_table(docs: DataFrame, labels: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """(doc_id, key, pattern): the votes of all labellers on each row."""

    @F.pandas_udf("int")
    def cast(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([votes(statistics(t, lexicon)[1]) for t in batch], dtype="int32")

    own = docs.select("doc_id", row_key(docs).alias("key"), cast(F.coalesce("text", F.lit(""))).alias("own"))
    own = own.join(label_votes(labels).drop("toxic"), "doc_id", "left")
    return own.select("doc_id", "key", (F.col("own") * 3 + F.coalesce("label_vote", F.lit(NONE))).alias("pattern"))


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Fit the word list, the label model and the scorer. ``docs`` has doc_id and text."""
    lexicon = toxic_words(docs, labels)
    cast = written(vote_table(docs, labels, lexicon), "quality-votes")
    counts = {r["pattern"]: r["count"] for r in cast.groupBy("pattern").count().collect()}
    posterior = expectation_maximisation(counts)
    chosen = cast.dropDuplicates(["key"]).orderBy(F.xxhash64("key"), "key").limit(TRAIN_DOCS).select("key", "pattern")

    @F.pandas_udf("buckets binary, values binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [features(*statistics(t, lexicon)) for t in batch]
            yield pd.DataFrame([(b.tobytes(), v.tobytes()) for b, v in found], columns=["buckets", "values"])

    texts = docs.withColumn("key", row_key(docs)).join(F.broadcast(chosen), "key").dropDuplicates(["key"])
    sample = texts.select("key", "pattern", packed(F.coalesce("text", F.lit(""))).alias("f")).select("key", "pattern", "f.*").collect()
    rows = [
        (np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["values"], np.float32), posterior[r["pattern"]])
        for r in sorted(sample, key=lambda r: r["key"])
    ]
    return Scorer(lexicon, *fit(rows))


def bad_probability(text: Column, scorer: Scorer, spark: SparkSession) -> Column:
    held = spark.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = held.value
        for batch in batches:
            out = []
            for text in batch:
                buckets, values = features(*statistics(text, s.lexicon))
                out.append(float(s.weights[buckets] @ values + s.bias))
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -50, 50))), dtype="float64")

    return scored(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, reject_at: float = REJECT_AT) -> DataFrame:
    """``docs`` with ``bad_score`` (probability of bad) and ``accepted``.

    Null is an empty text. Without labels the other labellers decide; without documents the
    result is empty. Repeated rows get equal scores; columns named like a result are replaced.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("bad_score", "accepted")]
    scorer = train(docs.select("doc_id", "text"), labels)
    scored = docs.select(*kept, bad_probability(F.col("text"), scorer, docs.sparkSession).alias("bad_score"))
    return scored.withColumn("accepted", F.col("bad_score") < reject_at)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "bad_score", "accepted")
