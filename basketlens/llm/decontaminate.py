"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A seed is the hash of the tokens that a fixed mask keeps in a window; the positions it ignores
may hold other tokens. Seeds of all windows of the benchmark are joined with those of all
windows of the documents. Each hit gives a diagonal (document position less item position), and
the best-scoring run along it is verified token by token: equal tokens score 1, others -2, so a
run that scores above 0 has more than two thirds of its tokens equal.

Documents are scanned for seeds where they lie. The benchmark's seeds are broadcast after their
number was seen to be at most ``BROADCAST_ROWS``; beyond that Spark picks a join by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm.tables import ascii_lower, few, table
from basketlens.sources.scratch import written

#: Kept positions of the windows: six of nine tokens each. Every position is ignored by one mask, and the last
#: ignores two that lie four apart.
MASKS = ("110110110", "101101011", "011011101")
LEAST_TOKENS = 12
LEAST_SHARE = (7, 9)  # of an item's tokens, for items too short for ``LEAST_TOKENS``
MISMATCH = -2


def words(text: Column) -> Column:
    """Lower-cased (A-Z) tokens between white space."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def seeds(hashes: Column) -> Column:
    """For each window an array of one hash per mask; none for texts shorter than a mask."""
    span = len(MASKS[0])

    def of_window(at: Column) -> Column:
        return F.array(
            *[
                F.xxhash64(F.lit(number), *[F.get(hashes, at + i) for i, keep in enumerate(mask) if keep == "1"])
                for number, mask in enumerate(MASKS)
            ]
        )

    windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - span), of_window)
    return F.when(F.size(hashes) >= span, windows)


def seed_rows(tokens: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, seed) of every window and mask of ``tokens.words``."""
    hashed = tokens.select(*keys, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    each = hashed.select(*keys, F.posexplode(seeds(F.col("h"))).alias("pos", "of_window"))
    return each.select(*keys, "pos", F.explode("of_window").alias("seed"))


def best_run(doc_words: Column, item_words: Column, diagonal: Column) -> Column:
    """Struct of the best-scoring run along a diagonal: start in the item, length, matched; the longest of equals."""
    low = F.greatest(F.lit(0), -diagonal)
    high = F.least(F.size(item_words), F.size(doc_words) - diagonal)
    zero = F.lit(0)
    start = F.struct(
        zero.alias("score"), low.alias("from"), zero.alias("matched"),
        zero.alias("best"), low.alias("best_from"), zero.alias("best_length"), zero.alias("best_matched"),
    )

    def step(s: Column, at: Column) -> Column:
        same = F.get(item_words, at) == F.get(doc_words, at + diagonal)
        fresh = s["score"] < 0
        score = F.when(fresh, 0).otherwise(s["score"]) + F.when(same, 1).otherwise(MISMATCH)
        begin = F.when(fresh, at).otherwise(s["from"])
        matched = F.when(fresh, 0).otherwise(s["matched"]) + same.cast("int")
        better = (score >= s["best"]) & (score > 0)
        return F.struct(
            score.alias("score"), begin.alias("from"), matched.alias("matched"),
            F.when(better, score).otherwise(s["best"]).alias("best"),
            F.when(better, begin).otherwise(s["best_from"]).alias("best_from"),
            F.when(better, at - begin + 1).otherwise(s["best_length"]).alias("best_length"),
            F.when(better, matched).otherwise(s["best_matched"]).alias("best_matched"),
        )

    return F.when(high > low, F.aggregate(F.sequence(low, high - 1), start, step))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, least_tokens: int = LEAST_TOKENS, doc_id: str = "doc_id", item_id: str = "item_id"
) -> DataFrame:
    """(doc_id, text_key, item_id, doc_start, item_start, length, matched): the best overlap of each pair.

    A pair counts if ``least_tokens`` tokens, or seven ninths of the item's tokens if that is less, agree
    in its best-scoring run; of equal runs the longest counts. Texts and items shorter than a mask (nine tokens),
    null ones included, overlap with nothing. Repeated rows of ``docs`` count once, told
    apart by id and ``text_key`` (a hash of the text); null ids are ids. Only id and text are
    read, whatever else the tables hold.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col("text"), F.xxhash64("text").alias("text_key"))
    items = benchmark.select(F.col(item_id).alias("item_id"), words(F.col("text")).alias("words")).distinct()
    items = items.withColumn("item_key", F.xxhash64("item_id", "words"))
    tokens = docs.select("doc_id", "text_key", words(F.col("text")).alias("words"))
    wanted = written(
        seed_rows(items, "item_id", "item_key").select("item_id", "item_key", F.col("pos").alias("item_pos"), "seed").distinct(), "benchmark-seeds"
    )
    hits = seed_rows(tokens, "doc_id", "text_key").join(few(wanted), "seed")
    hits = hits.select("doc_id", "text_key", "item_id", "item_key", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
    hits = written(hits, "benchmark-hits")

    asked = few(written(hits.select("doc_id", "text_key").distinct(), "benchmark-hit-documents"))
    there = docs.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "text").join(
        asked, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("text_key"))
    )
    there = there.groupBy("doc_id", "text_key").agg(F.first("text").alias("text"))
    texts = there.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), words(F.col("text")).alias("doc_words"))
    item_words = items.select(F.col("item_key").alias("i"), F.col("words").alias("item_words"))
    both = hits.join(texts, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("text_key"))).join(
        item_words, F.col("i") == F.col("item_key")
    )
    part, of = LEAST_SHARE
    needed = F.least(F.lit(least_tokens), F.ceil(F.size("item_words") * part / of).cast("int"))
    run = both.select(
        "doc_id", "text_key", "item_id", "diagonal", needed.alias("needed"), best_run(F.col("doc_words"), F.col("item_words"), F.col("diagonal")).alias("r")
    ).where(F.col("r.best_matched") >= F.col("needed"))
    overlap = F.struct(
        F.col("r.best_matched").alias("matched"),
        (-F.col("r.best_length")).alias("less"),
        (-F.col("r.best_from")).alias("before"),
        (-F.col("diagonal")).alias("left"),
    )
    best = run.groupBy("doc_id", "text_key", "item_id").agg(F.max(overlap).alias("o"))
    return best.select(
        "doc_id",
        "text_key",
        "item_id",
        (-F.col("o.before") - F.col("o.left")).alias("doc_start"),
        (-F.col("o.before")).alias("item_start"),
        (-F.col("o.less")).alias("length"),
        F.col("o.matched").alias("matched"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "doc_start", "item_start", "length", "matched")
