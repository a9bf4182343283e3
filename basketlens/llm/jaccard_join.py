"""Exact Jaccard self-join of word-shingle sets by PartEnum signatures.

Sets whose Jaccard similarity is at least t and whose sizes are a and b differ in at most
(a + b)(1 - t)/(1 + t) elements. Sizes are cut into overlapping bands; in a band with at most k
differences the feature domain is split into N > k partitions. Two similar sets agree on at
least N - k partitions, so each set may leave N - k - 1 of them out and still share
a signature (the content of one partition) with every partner, provided all sets rank
contents alike: partitions with the most rare shingles come first. Which shingles
are common is learned from a sample; that steers only the ranking, never what is found.

1. One scan gives for each text its set's hash (the node), size, signatures and a histogram.
2. A few signatures of each node find families: near copies whose histograms are close. That
   only saves work: what it misses the next step finds.
3. All signatures are dealt into buckets as packed blocks. Those that only one family
   has are dropped there. Small groups of families give pairs, of which those whose histograms
   already differ by too much are dropped. Large groups give a star.
4. Components of these candidates are the units of exact comparison. The texts of a unit go
   once to one task, or block by block where a unit is large; a unit leaves
   only a spanning forest of its links.
5. Components of the links are the classes.

Tables and shuffles leave the disks as soon as nothing reads them again.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketlens.llm.components import components, roots
from basketlens.llm.shingles import mix, shingle_set
from basketlens.llm.tables import arrow_rows, memory_returned, parts_for, table
from basketlens.sources.buckets import default_buckets
from basketlens.sources.scratch import drop_table, shuffles_dropped, written, written_with_facts

SIMILARITY = Fraction(4, 5)
GROWTH = 1.6  # of the lower bounds of the bands
PARTITIONS = 1.5  # per signature
COMMON_SAMPLE = 4_000  # documents that common shingles are learned from, about
COMMON_SHARE = 64  # of these one at least, so that a shingle of some hundred documents is common in any corpus
COMMON_AT = 3  # of them hold a common shingle
SMALL_GROUP = 8
BINS = 256
BLOCK = 1_000
BROADCAST_ROWS = 1_000_000
SLICES = 16
BATCH_ROWS = 1_000
FEW = 4  # signatures that find families
SIG_BYTES = 6  # of a signature are stored; what agrees by chance gives a candidate more
BUCKET_SIGNATURES = 1_000_000
BLOCK_SIGNATURES = 100_000  # in the blocks made at once, for each bucket a block: their size bounds what Arrow holds outside the heap
LEAST_BLOCK = 100
BLOCKS_AT_ONCE = 250
BLOCK_ROWS = 1 << 16
MOVED_ROWS = 4_000_000

BASE = "n_shingles long, node long, signatures binary, few array<long>, bins binary"


# --- signatures ---------------------------------------------------------------------------


@cache
def bands(similarity: Fraction, most: int) -> tuple[tuple[int, int, int, int], ...]:
    """(lowest size, highest size, differences, partitions) of the bands up to size ``most``.

    Each pair of similar sets, unless they are equal, has both sizes in one band.
    """
    found, low = [], 1
    while low <= most:
        above = max(low + 1, int(np.ceil(low * GROWTH)))
        a = above - 1
        b = int(a / similarity)
        k = int((a + b) * (1 - similarity) / (1 + similarity))
        if k:
            found.append((low, b, k, int((k + 1) * PARTITIONS) + 4))
        low = above
    return tuple(found)


def signatures(own: np.ndarray, common: np.ndarray, similarity: Fraction = SIMILARITY) -> np.ndarray:
    """The signatures of a set of shingle hashes in all bands of its size."""
    n = len(own)
    out = []
    rare = ~np.isin(own, common, assume_unique=True) if len(common) else np.ones(n, bool)
    for number, (low, high, k, parts) in enumerate(bands(similarity, n)):
        if not low <= n <= high:
            continue
        seed = np.uint64((number + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        mixed = mix(own ^ seed)
        at = (mixed % np.uint64(parts)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        content = np.zeros(parts, np.uint64)
        begins = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
        content[at[order][begins]] = np.add.reduceat(mix(mixed[order]), begins)
        size = np.bincount(at, minlength=parts)
        weight = np.bincount(at, weights=rare, minlength=parts) * (n + 1) + size
        content = mix(content ^ (np.arange(parts, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ seed)
        kept = np.lexsort((content, weight))[parts - k - 1 :]
        out.append(content[kept])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def histogram(own: np.ndarray) -> bytes:
    counts = np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=BINS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def common_shingles(docs: DataFrame, sample: int = COMMON_SAMPLE, at: int = COMMON_AT) -> np.ndarray:
    """Shingles of at least ``at`` texts of a sample: texts whose hash falls in one of so many classes that about ``sample`` remain, or a ``COMMON_SHARE``-th."""
    classes = max(1, min(docs.count() // sample, COMMON_SHARE))
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(classes)) == 0)
    some = some.groupBy(F.xxhash64("text").alias("k")).agg(F.first("text").alias("text"))

    @F.pandas_udf("array<long>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingle_set(t).view(np.int64) for t in batch], dtype=object)

    each = some.select(F.explode(sets("text")).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at)
    found = each.orderBy(F.desc("n"), "s").limit(200_000).toPandas()["s"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def packed(sigs: np.ndarray) -> bytes:
    """The upper ``SIG_BYTES`` bytes of each signature."""
    return sigs.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - SIG_BYTES :].tobytes()


def unpacked(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw) // SIG_BYTES, 8), np.uint8)
    wide[:, :SIG_BYTES] = raw.reshape(-1, SIG_BYTES)
    return wide.reshape(-1).view("<u8")


def signature_table(docs: DataFrame, common: np.ndarray, similarity: Fraction) -> DataFrame:
    """row, (doc_id, text_key) and the columns of ``BASE``; signatures once for each node and task."""
    held = docs.sparkSession.sparkContext.broadcast(common)

    @F.pandas_udf(BASE)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memory_returned()
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for text in batch:
                own = shingle_set(text)
                if not len(own):
                    rows.append((0, None, None, None, None))
                    continue
                node = xxhash.xxh64_intdigest(own.tobytes(), seed=len(own)) - (1 << 63)
                if node in seen:
                    rows.append((len(own), node, None, None, None))
                    continue
                if len(seen) < 1_000_000:
                    seen.add(node)
                sigs = signatures(own, held.value, similarity)
                rows.append((len(own), node, packed(sigs), np.sort(sigs)[:FEW].view(np.int64), histogram(own)))
            out = pd.DataFrame(rows, columns=["n_shingles", "node", "signatures", "few", "bins"], dtype=object)
            yield out.assign(n_shingles=out["n_shingles"].astype("int64"), node=out["node"].astype("Int64"))

    key = F.xxhash64("text").alias("text_key")
    each = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", key, scanned("text").alias("s"))
    return each.select("row", "doc_id", "text_key", "s.*")


# --- candidates ---------------------------------------------------------------------------


def may_be_similar(pairs: DataFrame, similarity: Fraction) -> DataFrame:
    """``pairs`` (a, b, sizes and histograms) without those that differ in too many elements by their histograms alone."""
    num, den = (1 - similarity).as_integer_ratio(), (1 + similarity).as_integer_ratio()

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        left = np.frombuffer(b"".join(x), np.uint8).reshape(len(x), BINS).astype(np.int16)
        right = np.frombuffer(b"".join(y), np.uint8).reshape(len(y), BINS).astype(np.int16)
        apart = np.abs(left - right).sum(axis=1, dtype=np.int64)
        return pd.Series(apart * num[1] * den[0] <= (a + b).to_numpy() * num[0] * den[1])

    return pairs.where(near("bins_a", "bins_b", "n_a", "n_b"))


def family_edges(nodes: DataFrame, similarity: Fraction) -> DataFrame:
    """Edges (a, b) of nodes that share one of a few signatures and have close histograms."""
    each = nodes.select(F.explode("few").alias("sig"), "node")
    of_sig = Window.partitionBy("sig")
    met = each.withColumn("low", F.min("node").over(of_sig)).withColumn("high", F.max("node").over(of_sig)).where("low < high")
    sized = met.select("sig", "node", "low").distinct().withColumn("size", F.count(F.lit(1)).over(of_sig))
    sized = written(sized, "few-signatures")
    small = sized.where(F.col("size") <= SMALL_GROUP).groupBy("sig").agg(F.sort_array(F.collect_list("node")).alias("m"))
    pair = F.flatten(
        F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, SMALL_GROUP), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    )
    # Groups that hold the same nodes give the same pairs: they are told once.
    pairs = small.select("m").distinct().select(F.explode(pair).alias("p")).select("p.*")
    stars = sized.where((F.col("size") > SMALL_GROUP) & (F.col("low") < F.col("node")))
    pairs = pairs.unionByName(stars.select(F.col("low").alias("a"), F.col("node").alias("b"))).distinct()
    named = lambda end: nodes.select(F.col("node").alias(end), F.col("n_shingles").alias(f"n_{end}"), F.col("bins").alias(f"bins_{end}"))
    return may_be_similar(pairs.join(named("a"), "a").join(named("b"), "b"), similarity).select("a", "b")


def block_rows(rows: list[np.ndarray], raw: list[np.ndarray], sizes: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """(bucket, block) of the signatures of rows of one range: a block is the range's start, the rows within it, the signatures."""
    row, raw = np.concatenate(rows), np.concatenate(raw)
    bucket = (unpacked(raw) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    within = np.repeat((row % BLOCK_ROWS).astype("<u2"), np.concatenate(sizes))[order]
    raw, bucket = raw.reshape(-1, SIG_BYTES)[order], bucket[order]
    cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(bucket) > 0]), len(bucket)]
    start = (row[:1] // BLOCK_ROWS * BLOCK_ROWS).astype("<i8").tobytes()
    blocks = [start + within[i:j].tobytes() + raw[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.record_batch({"bucket": pa.array(bucket[cuts[:-1]], pa.int32()), "block": pa.array(blocks, pa.binary())})


def dealt_blocks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks of all signatures, each of rows from one range of ``BLOCK_ROWS`` numbers."""
    memory_returned()
    held: tuple[list, list, list] = ([], [], [])
    count, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch["signatures"].cast(pa.binary())
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8)
        row = batch["row"].to_numpy()
        place = row // BLOCK_ROWS
        cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(place) != 0]), len(row)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if count and (place[i] != last or count >= max(BLOCK_SIGNATURES, LEAST_BLOCK * buckets)):
                yield block_rows(*held, buckets)
                held, count = ([], [], []), 0
            last = place[i]
            for kept, own in zip(held, (row[i:j], data[ends[i] : ends[j]].copy(), np.diff(ends[i : j + 1]) // SIG_BYTES), strict=True):
                kept.append(own)
            count += (ends[j] - ends[i]) // SIG_BYTES
    if count:
        yield block_rows(*held, buckets)


def met_groups(blocks: list[bytes], moved: tuple[np.ndarray, np.ndarray]) -> pa.ListArray:
    """Of each signature in a bucket that two families or more have, their first rows, sorted; ``moved``: rows and the first rows of their families."""
    sigs, rows = [], []
    for block in blocks:
        n = (len(block) - 8) // (2 + SIG_BYTES)
        rows.append(np.frombuffer(block, "<i8", 1) + np.frombuffer(block, "<u2", n, 8).astype(np.int64))
        sigs.append(unpacked(np.frombuffer(block, np.uint8, -1, 8 + 2 * n)))
    sig, row = np.concatenate(sigs), np.concatenate(rows)

    def shared() -> np.ndarray:
        new = np.r_[True, sig[1:] != sig[:-1]]
        return ~(new & np.r_[new[1:], True])

    order = np.argsort(sig, kind="stable")
    sig, row = sig[order], row[order]
    keep = shared()
    sig, row = sig[keep], row[keep]
    if len(moved[0]) and len(row):
        at = np.minimum(np.searchsorted(moved[0], row), len(moved[0]) - 1)
        row = np.where(moved[0][at] == row, moved[1][at], row)
    order = np.lexsort((row, sig))
    sig, row = sig[order], row[order]
    once = np.r_[True, (sig[1:] != sig[:-1]) | (row[1:] != row[:-1])][: len(sig)]
    sig, row = sig[once], row[once]
    if len(sig):
        keep = shared()
        sig, row = sig[keep], row[keep]
    begins = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]][: len(sig)])
    return pa.ListArray.from_arrays(pa.array(np.r_[begins, len(sig)].astype(np.int32)), pa.array(row))


def shared_signatures(base: DataFrame, moved: DataFrame, n_signatures: int) -> DataFrame:
    """A row m for each signature that families share: their first rows, sorted; ``moved`` (row, first) tells the other rows' families."""
    spark = base.sparkSession
    buckets = parts_for(n_signatures, BUCKET_SIGNATURES, 4 * default_buckets(spark))
    # Of a longer table some is enough: families that are not known here meet as their rows.
    known = moved.limit(MOVED_ROWS).toArrow().sort_by("row")
    held = spark.sparkContext.broadcast((known["row"].to_numpy(), known["first"].to_numpy()))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            return pa.record_batch({"m": met_groups(blocks, held.value)})

        memory_returned()
        blocks: list[bytes] = []
        last = None
        for batch in batches:
            for bucket, block in zip(batch["bucket"].to_pylist(), batch["block"].to_pylist(), strict=True):
                if bucket != last and blocks:
                    yield told()
                    blocks = []
                last = bucket
                blocks.append(block)
        if blocks:
            yield told()

    each = base.where(F.length("signatures") > 0).select("row", "signatures")
    dealt = each.mapInArrow(lambda b: dealt_blocks(b, buckets), "bucket int, block binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(met, "m array<long>")


def spans(members: DataFrame) -> DataFrame:
    """(first, n, least, most) of families: the largest size and the bounds of the histograms of their nodes; members: first, n_shingles, bins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, n, least, most = None, 0, None, None
        for batch in batches:
            out = []
            for first, size, bins in zip(batch["first"], batch["n_shingles"], batch["bins"], strict=True):
                own = np.frombuffer(bins, np.uint8)
                if first == last:
                    n, least, most = max(n, size), np.minimum(least, own), np.maximum(most, own)
                    continue
                if last is not None:
                    out.append((last, n, least.tobytes(), most.tobytes()))
                last, n, least, most = first, size, own, own
            yield pd.DataFrame(out, columns=["first", "n", "least", "most"])
        if last is not None:
            yield pd.DataFrame([(last, n, least.tobytes(), most.tobytes())], columns=["first", "n", "least", "most"])

    dealt = members.select("first", "n_shingles", "bins").repartition("first").sortWithinPartitions("first")
    return dealt.mapInPandas(run, "first long, n long, least binary, most binary")


def close_families(pairs: DataFrame, members: DataFrame, similarity: Fraction) -> DataFrame:
    """``pairs`` (a, b) of families without those of whose nodes any two differ in too many elements by the histograms' bounds."""
    num, den = (1 - similarity).as_integer_ratio(), (1 + similarity).as_integer_ratio()
    asked = pairs.select(F.col("a").alias("first")).union(pairs.select("b")).distinct()
    spanned = written(spans(members.join(asked, "first", "left_semi")), "family-spans")

    @F.pandas_udf("boolean")
    def near(la: pd.Series, ma: pd.Series, lb: pd.Series, mb: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        least_a, most_a, least_b, most_b = (np.frombuffer(b"".join(x), np.uint8).reshape(len(x), BINS).astype(np.int16) for x in (la, ma, lb, mb))
        apart = np.maximum(0, np.maximum(least_a - most_b, least_b - most_a)).sum(axis=1, dtype=np.int64)
        return pd.Series(apart * num[1] * den[0] <= (a + b).to_numpy() * num[0] * den[1])

    named = lambda end: spanned.toDF(end, f"n_{end}", f"least_{end}", f"most_{end}")
    both = pairs.join(named("a"), "a").join(named("b"), "b")
    return both.where(near("least_a", "most_a", "least_b", "most_b", "n_a", "n_b")).select("a", "b")


def candidate_units(base: DataFrame, nodes: DataFrame, n_signatures: int, similarity: Fraction) -> DataFrame:
    """(node, component) of units that hold every pair of similar sets; ``base`` is removed."""
    linked = components(family_edges(nodes, similarity))
    family = nodes.select("node", "row", "n_shingles", "bins").join(linked, "node", "left").withColumn("family", F.coalesce("component", "node"))
    first = family.groupBy("family").agg(F.min("row").alias("first"))
    placed = written(family.join(first, "family").select("node", "first", "n_shingles", "bins"), "families")
    rows = base.where(F.col("node").isNotNull()).select("row", "node").join(placed.select("node", "first"), "node")
    moved = written(rows.where("row != first").select("row", "first"), "family-rows")
    with arrow_rows(base.sparkSession, BLOCKS_AT_ONCE):
        met = written(shared_signatures(base, moved, n_signatures), "shared-signatures")
    drop_table(base)
    pair = F.flatten(
        F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, SMALL_GROUP), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    )
    star = F.transform(F.slice("m", F.lit(2), F.size("m")), lambda y: F.struct(F.col("m")[0].alias("a"), y.alias("b")))
    large = F.size("m") > SMALL_GROUP
    # Groups with the same first row mostly tell the same pairs: these become one before they move.
    told = met.repartition(F.col("m")[0]).select(F.explode(F.when(large, star).otherwise(pair)).alias("p"), large.alias("star"))
    met = told.select("p.*", "star").groupBy("a", "b").agg(F.max("star").alias("star"))
    if moved.count() > MOVED_ROWS:
        for end in ("a", "b"):
            met = met.join(moved.toDF(end, "first"), end, "left").withColumn(end, F.coalesce("first", end)).drop("first")
        met = met.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "star")
        met = met.groupBy("a", "b").agg(F.max("star").alias("star"))
    met = written(met, "shared-families")
    close = close_families(met.where("not star").select("a", "b"), placed, similarity)
    joined = components(close.unionByName(met.where("star").select("a", "b"))).select(F.col("node").alias("first"), "component")
    units = placed.select("node", "first").join(joined, "first", "left").select("node", F.coalesce("component", "first").alias("component"))
    several = units.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    return units.join(several, "component", "left_semi").select("node", "component")


# --- exact comparison ---------------------------------------------------------------------


def links_of(left: list[np.ndarray], right: list[np.ndarray], same: bool, similarity: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the similar pairs of two lists of sorted sets; ``same``: one list with itself, each pair once."""
    if same and len(left) == 2:
        a, b = left
        both = len(np.intersect1d(a, b, assume_unique=True))
        fits = similarity.denominator * both >= similarity.numerator * (len(a) + len(b) - both)
        return np.zeros(int(fits), np.int64), np.ones(int(fits), np.int64)
    sizes = np.array([len(s) for s in right])
    elements, place = np.unique(np.concatenate(right), return_inverse=True)
    owner = np.repeat(np.arange(len(right)), sizes)[np.argsort(place, kind="stable")]
    begin = np.r_[0, np.cumsum(np.bincount(place, minlength=len(elements)))]
    found_i, found_j = [], []
    for i, own in enumerate(left):
        at = np.searchsorted(elements, own)
        at = at[(at < len(elements)) & (elements[np.minimum(at, len(elements) - 1)] == own)]
        if not len(at):
            continue
        length = begin[at + 1] - begin[at]
        total = int(length.sum())
        index = np.arange(total) + np.repeat(begin[at] - np.r_[0, np.cumsum(length)[:-1]], length)
        both = np.bincount(owner[index], minlength=len(right))
        fits = similarity.denominator * both >= similarity.numerator * (len(own) + sizes - both)
        fits[: i + 1] &= not same
        j = np.flatnonzero(fits)
        found_i.append(np.full(len(j), i))
        found_j.append(j)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (empty, empty)


def frozen(text: str) -> bytes:
    """A text, compressed: shorter than its shingles' hashes."""
    raw = text.encode("utf-8", "replace")
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def thawed(blob: bytes) -> str:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True).decode("utf-8")


def compare_units(batches: Iterator[pd.DataFrame], similarity: Fraction) -> Iterator[pd.DataFrame]:
    """Forest edges (a, b) of the links in each (unit, low block, high block); rows come sorted by these."""

    def compared(rows: list[tuple], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        ends = [[r for r in rows if r[0] == block] for block in ((low,) if low == high else (low, high))]
        sets = [[shingle_set(thawed(r[2])) for r in end] for end in ends]
        ends, sets = (ends * 2)[:2], (sets * 2)[:2]
        if not sets[0] or not sets[1]:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i, j = links_of(*sets, low == high, similarity)
        names = [np.array([r[1] for r in end], np.int64) for end in ends]
        nodes, root = roots(names[0][i], names[1][j]) if len(i) else (np.zeros(0, np.int64),) * 2
        return nodes[nodes != root], root[nodes != root]

    memory_returned()
    held: list[tuple] = []
    last = None
    for batch in batches:
        out_a, out_b = [], []
        for unit, low, high, *row in zip(*(batch[c] for c in ("unit", "low", "high", "block", "node", "frozen")), strict=True):
            if (unit, low, high) != last:
                if len(held) > 1:
                    a, b = compared(held, last[1], last[2])
                    out_a.append(a)
                    out_b.append(b)
                held, last = [], (unit, low, high)
            held.append(tuple(row))
        if out_a:
            yield pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})
    if len(held) > 1:
        a, b = compared(held, last[1], last[2])
        yield pd.DataFrame({"a": a, "b": b})
    held = []
    memory_returned()


def similar_links(docs: DataFrame, nodes: DataFrame, units: DataFrame, similarity: Fraction) -> list[DataFrame]:
    """Tables of links (a, b) that connect all similar nodes of each unit."""
    wanted = units.join(nodes.select("node", "doc_id", "text_key"), "node").select(
        F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "node", F.col("component").alias("unit")
    )
    wanted = written(wanted, "units")
    count = wanted.count()
    # Units that are too many for one broadcast take turns; the texts stay where they are.
    slices = min(SLICES, parts_for(count, BROADCAST_ROWS))
    found = []
    for number in range(slices):
        some = wanted.where(F.pmod(F.xxhash64("unit"), F.lit(slices)) == number) if slices > 1 else wanted
        asked = F.broadcast(some) if count <= BROADCAST_ROWS * slices else some
        found.append(written(slice_links(docs, some, asked, similarity), "shingle-links"))
    return found


def slice_links(docs: DataFrame, wanted: DataFrame, asked: DataFrame, similarity: Fraction) -> DataFrame:
    texts = docs.withColumn("text_key", F.xxhash64("text")).join(
        asked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k"))
    )

    @F.pandas_udf("binary")
    def freeze(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([frozen(t) for t in batch], dtype=object)

    blocks = wanted.groupBy(F.col("unit").alias("u")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sets = texts.select("unit", "node", freeze("text").alias("frozen")).join(blocks, F.col("u") == F.col("unit"))
    sets = sets.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    sets = sets.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = sets.select(
        "unit", F.least("block", "partner").alias("low"), F.greatest("block", "partner").alias("high"), "block", "node", "frozen"
    )
    dealt = sets.repartition("unit", "low", "high").sortWithinPartitions("unit", "low", "high", "node")
    return dealt.mapInPandas(lambda b: compare_units(b, similarity), "a long, b long")


def jaccard_classes(docs: DataFrame, similarity: Fraction = SIMILARITY, doc_id: str = "doc_id") -> DataFrame:
    """A row per row of ``docs``: doc_id, text_key, n_shingles, component_id, class_id.

    Texts are linked if their sets of five-word shingles reach ``similarity``, decided in whole
    numbers. component_id is the smallest doc_id reachable; rows without an id do not name a
    class. class_id tells classes apart whatever their ids; it is null without shingles. Null, empty and blank texts have no shingles and link with nothing; equal texts
    and repeated rows are always linked. Only id and text are read. No documents, no rows.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    with shuffles_dropped(docs.sparkSession):
        rows, classes = _classes(docs, similarity)
    rows = rows.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    named = rows.where(F.col("class").isNotNull()).groupBy(F.col("class").alias("c")).agg(F.min("doc_id").alias("component_id"))
    out = rows.join(named, F.col("class") == F.col("c"), "left")
    own = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_key", "n_shingles", own.alias("component_id"), F.col("class").alias("class_id"))


def _classes(docs: DataFrame, similarity: Fraction) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, n_shingles, node) of all rows, (node, class) of the nodes that are linked."""
    common = common_shingles(docs)
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        n_bytes = F.sum(F.length("signatures")).alias("n")
        base, facts = written_with_facts(signature_table(docs, common, similarity), "shingle-signatures", n_bytes)
    rows = written(base.select("doc_id", "text_key", "n_shingles", "node"), "shingle-rows")
    # Of a node's texts any serves; the rows with signatures hold the histogram.
    first = F.min(F.when(F.col("bins").isNotNull(), F.struct("doc_id", "text_key", "n_shingles", "bins", "few")))
    nodes = base.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("row").alias("row"), first.alias("f")).select("node", "row", "f.*")
    nodes = written(nodes, "shingle-nodes")
    units = candidate_units(base, nodes, (facts["n"] or 0) // SIG_BYTES, similarity)
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        links = similar_links(docs, nodes, units, similarity)
    every = links[0]
    for other in links[1:]:
        every = every.unionByName(other)
    return rows, components(every).withColumnRenamed("component", "class")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
