"""Language-model scores from a hierarchical Pitman-Yor model, trained and applied where the words are.

The model has one restaurant for each context (every word that comes before another, and the
start of a text) and their common parent, the unigram restaurant, whose base measure is
uniform. Seating is sampled by Gibbs: each sweep draws the tables of every (context, word) cell
from their conditional given all others as the last sweep left them, and then the parent's
tables of each word given its tables in all contexts. Probabilities are averaged over samples.

1. Tokens are shuffled once, as compact blocks of (word, context, text). A word is in one bucket
   with all its contexts. Very frequent words and the end of a text are in all buckets: their cells lie by the
   context, or by both where that is as frequent (or the start). So a rare word or context is named in few
   blocks. Each bucket is written as one row that holds all about its cells, in a
   table bucketed by that number, and stays there. Texts are known by number; a row beside the blocks tells their keys.
2. A cell of one customer has one table. The others travel between parts by context, where
   their tables are drawn, and parts by word, where those of the parent are. Their seating and the
   totals are written by each sweep and summed anew for the next.
3. Every bucket asks for the totals of its contexts; the answers are brought to the buckets, which add
   up the scores of their tokens by text.

Cells are drawn side by side, each from totals of the sweep before. Words are told apart by
64-bit hashes. Sampling is seeded by part and sweep, so a task that runs again gives the same result.
"""

from __future__ import annotations

import pickle
import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm.shingles import mix, word_hashes
from basketlens.llm.tables import arrow_rows, parts_for, table
from basketlens.sources.buckets import default_buckets, write_bucketed
from basketlens.sources.scratch import drop, reserve, shuffles_dropped, written

CONTEXT_SHARE = 2e-5
COUNTED_WORDS = 300_000  # a task that counts more forgets the rarest
BUCKET_TOKENS = 1_000_000
CHUNK_TOKENS = 1_000_000  # of a block of texts
DRAWN_AT_ONCE = 30_000  # customers or tables, so that they stay in a cache
SUMS_AT_ONCE = 1_000_000  # texts whose sums a scoring task holds
BLOCKS_AT_ONCE = 100  # rows in an Arrow batch; units come singly
ZSTD = pa.Codec("zstd", compression_level=1)
DISCOUNT, STRENGTH = 0.75, 1.0  # of the contexts
PARENT_DISCOUNT, PARENT_STRENGTH = 0.5, 1.0
BURN_IN, SAMPLES = 3, 3  # sweeps before the samples at least, and samples
MOST_BURN_IN, SETTLED = 20, 0.005  # sweeps before the samples at most; change of all tables that counts as none
EXACT = 2048  # customers of a cell whose number of tables is drawn at once; others are seated one by one
RARE = 0  # place of the words that are not spread; those that are follow
END = b"\x00end"
START_CONTEXT = np.uint64(xxhash.xxh64_intdigest(b"\x00start"))
SMOOTH = 0.1  # of the base score

#: ``word``, ``contexts``: distinct and sorted; ``cells``: how many contexts each word has; ``context``: places in ``contexts``.
#: ``text``: number of each token's; ``texts``: in units the ids and numbers at which chunks begin, in blocks the one id.
#: Bucket ``KEYS`` has in ``contexts`` the keys of the texts from that id on.
UNIT = "bucket int, word binary, cells binary, contexts binary, context binary, count binary, size binary, text binary, texts binary"
KEYS = -1
CELL_COLUMNS = ["bucket", "word", "cells", "contexts", "context", "count", "size"]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


# --- words --------------------------------------------------------------------------------


def slices(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Runs of rows of at most that many tokens, or one row; with each the number of rows before it."""
    before = 0
    for batch in batches:
        most = np.cumsum(pc.binary_length(batch.column("text").cast(pa.binary())).to_numpy().astype(np.int64) // 2 + 2)
        low = 0
        while low < len(batch):
            high = max(low + 1, int(np.searchsorted(most, tokens + (most[low - 1] if low else 0), "right")))
            yield batch.slice(low, high - low), before + low
            low = high
        before += len(batch)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in turn, as ``shingles.word_list`` tells them apart, and how many each text has."""
    runs = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, lengths = runs.flatten(), pc.list_value_length(runs).to_numpy().astype(np.int64)
    there = pc.not_equal(words, "")
    ends = np.r_[0, np.cumsum(there.to_numpy(zero_copy_only=False))][np.cumsum(lengths)]
    return words.filter(there).cast(pa.binary()), np.diff(np.r_[0, ends])


# --- frequent words -----------------------------------------------------------------------------


def frequent_words(docs: DataFrame, share: float = CONTEXT_SHARE) -> np.ndarray:
    """Sorted hashes of the words with about ``share`` of all training tokens or more, at most 1/``share``.

    Ends of texts count as a word. Each task reports the words with half that share of its own
    tokens. The choice says only which cells are spread over the buckets, not what the model is.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        total = 0
        for texts, _ in slices(batches, CHUNK_TOKENS // 2):
            words, _ = split_words(texts.column("text"))
            each = words.dictionary_encode()
            seen.update(dict(zip(each.dictionary.to_numpy(zero_copy_only=False), np.bincount(each.indices.to_numpy(), minlength=len(each.dictionary)).tolist(), strict=True)))
            seen[END] += len(texts)
            total += len(words) + len(texts)
            if len(seen) > COUNTED_WORDS:  # a word that is frequent in all is frequent here
                seen = Counter({w: n for w, n in seen.items() if n >= total * share / 8})
        kept = [(xxhash.xxh64_intdigest(w) - (1 << 63), n) for w, n in seen.items() if n >= total * share / 2 and n > 1]
        words, numbers = zip(*kept, (None, total), strict=True)
        del seen
        pa.default_memory_pool().release_unused()
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(numbers, pa.int64())], ["word", "n"])

    found = written(docs.where(~F.col("held_out")).select("text").mapInArrow(count, "word long, n long"), "lm-frequent")
    total = found.where("word is null").agg(F.sum("n")).first()[0] or 0
    top = found.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, total * share))
    words = top.orderBy(F.desc("n"), "word").limit(int(1 / share)).toPandas()["word"].to_numpy(np.int64)
    return np.sort((words.astype(object) + (1 << 63)).astype(np.uint64)) if len(words) else np.zeros(0, np.uint64)


def place_of(words: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """1 + the place of each word among the spread ones, ``RARE`` for all others."""
    if not len(frequent):
        return np.full(len(words), RARE, np.uint16)
    at = np.minimum(np.searchsorted(frequent, words), len(frequent) - 1)
    return np.where(frequent[at] == words, at + RARE + 1, RARE).astype(np.uint16)


# --- blocks of tokens ---------------------------------------------------------------------


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix(keys) % np.uint64(parts)).astype(np.int32)


def in_all(contexts: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Which contexts do not place the cells of frequent words."""
    return (place_of(contexts, frequent) > RARE) | (contexts == START_CONTEXT)


def bucket_of(words: np.ndarray, contexts: np.ndarray, spread: np.ndarray, open_: np.ndarray, buckets: int) -> np.ndarray:
    """By word; for words that are ``spread`` by context, or by both if the context is ``open_`` (``in_all``)."""
    return part_of(np.where(spread, np.where(open_, words ^ mix(contexts + np.uint64(1)), contexts), words), buckets)


def by_cell(bucket: np.ndarray, word: np.ndarray, context: np.ndarray, names: int) -> np.ndarray:
    """Order by bucket, word and context; the latter two are numbers below ``names``."""
    bits = max(1, (names - 1).bit_length())
    if 2 * bits + int(bucket.max()).bit_length() > 63:
        return np.lexsort((context, word, bucket))
    key = bucket.astype(np.int64)
    key = ((key << bits | word) << bits) | context
    return np.argsort(key)


def block_rows(words: pa.Array, lengths: np.ndarray, train: np.ndarray, first_text: int, frequent: np.ndarray, buckets: int) -> Iterator[tuple]:
    """One row per bucket for a chunk of texts, whose numbers begin with ``first_text``; all ``words`` without the ends of texts."""
    each = words.dictionary_encode()
    known = each.dictionary.to_numpy(zero_copy_only=False)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
    hashes = np.r_[hashes, word_hashes([END]), START_CONTEXT]
    names, rank = np.unique(hashes, return_inverse=True)
    rank = rank.astype(np.int32)  # a chunk has fewer
    own = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + 1)
    ends = np.cumsum(lengths + 1) - 1
    word = np.full(len(own), rank[-2])
    inner = np.ones(len(own), bool)
    inner[ends] = False
    word[inner] = rank[each.indices.to_numpy()]
    context = np.r_[rank[-1], word[:-1]]
    context[np.r_[0, ends[:-1] + 1]] = rank[-1]
    spread, open_ = place_of(names, frequent) > RARE, in_all(names, frequent)
    part = part_of(names, buckets)
    bucket = np.where(spread[word], part[context], part[word])
    both = np.flatnonzero(spread[word] & open_[context])
    w, c = names[word[both]], names[context[both]]
    bucket[both] = bucket_of(w, c, np.ones(len(w), bool), np.ones(len(w), bool), buckets)
    order = by_cell(bucket, word, context, len(names))
    word, context, own, bucket = word[order], context[order], own[order], bucket[order]
    first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (context[1:] != context[:-1]) | (bucket[1:] != bucket[:-1])])
    size, count = np.diff(np.r_[first, len(word)]), np.add.reduceat(train[own].astype(np.int64), first)
    word, context, cell_bucket = word[first], context[first], bucket[first]
    texts = np.array([first_text]).tobytes()
    cuts = np.flatnonzero(np.diff(cell_bucket)) + 1
    for low, high in zip(np.r_[0, cuts], np.r_[cuts, len(word)], strict=True):
        contexts, at = np.unique(context[low:high], return_inverse=True)
        w = word[low:high]
        new = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        begin, end = first[low], first[high] if high < len(first) else len(own)
        yield (
            int(cell_bucket[low]), names[w[new]].tobytes(), squeezed(np.diff(np.r_[new, len(w)])), names[contexts].tobytes(),
            squeezed(at), squeezed(count[low:high]), squeezed(size[low:high]), squeezed(own[begin:end]), texts,
        )


def token_blocks(docs: DataFrame, frequent: np.ndarray, buckets: int) -> DataFrame:
    """``UNIT`` rows of chunks of texts, and a row with the keys of each. ``docs``: key, text, held_out."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = held.value
        context = TaskContext.get()
        task = (context.partitionId() if context else 0) << 40

        def flush() -> Iterator[pa.RecordBatch]:
            lengths = np.concatenate([n for _, n in parts])
            keys, train = (np.concatenate(x) for x in zip(*columns, strict=True))
            rows = [*block_rows(pa.concat_arrays([w for w, _ in parts]), lengths, train, task + begin, frequent, buckets)]
            rows.append((KEYS, NONE, NONE, keys.tobytes(), *[NONE] * 4, np.array([task + begin]).tobytes()))
            for low in range(0, len(rows), BLOCKS_AT_ONCE):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[low : low + BLOCKS_AT_ONCE], strict=True), kinds, strict=True)], names)

        names = [x.split()[0] for x in UNIT.split(", ")]
        kinds = [pa.int32(), *[pa.binary()] * (len(names) - 1)]
        parts: list[tuple] = []
        columns: list[tuple] = []
        total = begin = 0
        for texts, before in slices(batches, CHUNK_TOKENS // 2):
            if not parts:
                begin = before
            parts.append(split_words(texts.column("text")))
            columns.append((texts.column("key").to_numpy(), ~texts.column("held_out").to_numpy(zero_copy_only=False)))
            total += len(parts[-1][0]) + len(texts)
            if total >= CHUNK_TOKENS:
                yield from flush()
                parts, columns, total = [], [], 0
        if parts:
            yield from flush()
        parts.clear()
        pa.default_memory_pool().release_unused()

    return docs.select("key", "text", "held_out").mapInArrow(blocks, UNIT)


def text_keys(table: DataFrame) -> DataFrame:
    """(text, key) of all texts: their numbers, and what they were called."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                for first, keys in pickle.loads(row.contexts):
                    yield pd.DataFrame({"text": first + np.arange(len(keys) // 8), "key": np.frombuffer(keys, np.int64)})

    return table.where(F.col("bucket") == KEYS).select("contexts").mapInPandas(rows, "text long, key long")


def packed(numbers: np.ndarray) -> bytes:
    """Counts in as many bytes each (1, 2, 4 or 8) as the largest needs; all first bytes, then all second ones and so on."""
    whole = numbers.astype(np.min_scalar_type(int(numbers.max())) if len(numbers) else np.uint8)
    return whole.tobytes() if whole.itemsize == 1 else whole.view(np.uint8).reshape(-1, whole.itemsize).T.tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    width = len(data) // n
    bytes_ = np.frombuffer(data, np.uint8)
    return bytes_.astype(np.int64) if width == 1 else np.ascontiguousarray(bytes_.reshape(width, n).T).view(f"u{width}").ravel().astype(np.int64)


def squeezed(numbers: np.ndarray) -> bytes:
    """``packed`` and compressed."""
    data = packed(numbers)
    return len(numbers).to_bytes(8, "little") + (len(data) // max(1, len(numbers))).to_bytes(1, "little") + ZSTD.compress(data, asbytes=True)


def unsqueezed(data: bytes) -> np.ndarray:
    """Counts in as many bytes as they were packed in."""
    n, width = int.from_bytes(data[:8], "little"), data[8]
    return unpacked(ZSTD.decompress(data[9:], n * width, asbytes=True), n).astype(f"u{width or 1}")


def packed_cells(word: np.ndarray, context: np.ndarray, count: np.ndarray, size: np.ndarray) -> tuple[bytes, ...]:
    """Columns of cells sorted by word."""
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    names, place = np.unique(context, return_inverse=True)
    return word[first].tobytes(), packed(np.diff(np.r_[first, len(word)])), names.tobytes(), packed(place), packed(count), packed(size)


def unpack_cells(row) -> tuple[np.ndarray, ...]:
    """Words and contexts; by cell the places of its word and context among them, count and size."""
    names, contexts = np.frombuffer(row.word, np.uint64), np.frombuffer(row.contexts, np.uint64)
    word = np.repeat(np.arange(len(names)), unpacked(row.cells, len(names)))
    return names, contexts, word, *(unpacked(x, len(word)) for x in (row.context, row.count, row.size))


def unpack(row) -> tuple[np.ndarray, ...]:
    """``unpack_cells``; text by token, as places in the last: the texts' ids."""
    cells = unpack_cells(row)
    ids, starts = np.frombuffer(row.texts, np.int64).reshape(2, -1)
    numbers = unpacked(row.text, int(cells[-1].sum()))
    if starts[-1] + 1 > len(numbers):  # of most chunks, few texts are here
        numbers, text = np.unique(numbers, return_inverse=True)
    else:
        numbers, text = np.arange(int(numbers.max()) + 1), numbers
    chunk = np.searchsorted(starts, numbers, "right") - 1
    return (*cells, text, ids[chunk] + numbers - starts[chunk])


def unpack_block(row) -> tuple[np.ndarray, ...]:
    """word, context, count, size by cell; text by token, as places in the chunk."""
    word, contexts = np.frombuffer(row.word, np.uint64), np.frombuffer(row.contexts, np.uint64)
    return np.repeat(word, unsqueezed(row.cells)), contexts[unsqueezed(row.context)], unsqueezed(row.count), unsqueezed(row.size), unsqueezed(row.text)


def merge_blocks(rows: list) -> tuple:
    """One ``UNIT`` row from all blocks of a bucket."""
    if rows[0].bucket == KEYS:
        every = pickle.dumps([(int.from_bytes(r.texts, "little"), r.contexts) for r in rows])
        return (KEYS, NONE, NONE, every, *[NONE] * 5)
    rows = sorted(rows, key=lambda r: int.from_bytes(r.texts, "little"))
    each = [unpack_block(r) for r in rows]
    word, context, count, size = (np.concatenate([e[i] for e in each]) for i in range(4))
    ids = np.array([int.from_bytes(r.texts, "little") for r in rows])
    starts = np.r_[0, np.cumsum([int(e[4].max()) + 1 for e in each])]
    kind = np.min_scalar_type(int(starts[-1]))
    text = np.concatenate([e[4].astype(kind) + kind.type(s) for s, e in zip(starts[:-1], each, strict=True)])
    del each  # a bucket is large
    order = np.lexsort((context, word))
    index = (np.cumsum(size, dtype=np.int64) - size)[order]
    size = size[order]
    index = np.repeat(index - np.r_[0, np.cumsum(size, dtype=np.int64)[:-1]], size)
    index += np.arange(len(text))
    text = packed(text[index])
    del index
    word, context, count = word[order], context[order], count[order]
    del order
    first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (context[1:] != context[:-1])])
    total = lambda x: np.add.reduceat(x, first, dtype=np.int64)
    cells = packed_cells(word[first], context[first], total(count), total(size))
    return (rows[0].bucket, *cells, text, np.stack([ids, starts[:-1]]).tobytes())


def units(blocks: DataFrame, buckets: int) -> DataFrame:
    """A written table with one row per bucket, in as many files as a shuffle has partitions at most."""

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in UNIT.split(", ")]
        held: list = []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if held and row.bucket != held[0].bucket:
                    yield pd.DataFrame([merge_blocks(held)], columns=names)
                    held = []
                held.append(row)
        if held:
            yield pd.DataFrame([merge_blocks(held)], columns=names)

    spark = blocks.sparkSession
    files = min(buckets, default_buckets(spark))
    dealt = blocks.repartition(files, "bucket").sortWithinPartitions("bucket")
    with arrow_rows(spark, BLOCKS_AT_ONCE), shuffles_dropped(spark):
        return write_bucketed(dealt.mapInPandas(merged, UNIT), reserve(spark, "lm-units"), "bucket", files, placed=True, compression="zstd")


def combined(frames: Iterator[pd.DataFrame], most: int = SUMS_AT_ONCE) -> Iterator[pd.DataFrame]:
    """The frames' rows summed by text, as far as ``most`` texts at once allow."""

    def summed(parts: list[pd.DataFrame]) -> pd.DataFrame:
        key, place = np.unique(np.concatenate([p["key"] for p in parts]), return_inverse=True)
        out = {"key": key}
        for name in ("score", "base_score", "n_tokens", "n_known"):
            out[name] = np.bincount(place, np.concatenate([p[name] for p in parts]), len(key))
        for name in ("n_tokens", "n_known"):
            out[name] = out[name].astype(np.int64)  # whole numbers, exact up to 2**53
        return pd.DataFrame(out)

    held: list[pd.DataFrame] = []
    for frame in frames:
        held.append(frame)
        if sum(map(len, held)) > most:
            held = [summed(held)]
            if len(held[0]) > most // 2:
                yield held.pop()
    if held:
        yield summed(held)


# --- sweeps -------------------------------------------------------------------------------

#: What parts and buckets send each other. ``source``: of a bucket, part or sample.
SENT = "bucket int, source int, keys binary, others binary, counts binary, tables binary, extra binary, n double, m double, v double, kind int"
CELLS, WORDS, CONTEXTS, ASKED, WORD_TOTALS, SPREAD_TOTALS, ANSWERS, MEANS, UNITS = range(9)
NONE = b""
SUMS = "key long, score double, base_score double, n_tokens long, n_known long"

_stirling: list[np.ndarray] = []


def stirling() -> np.ndarray:
    """Logs of the generalised Stirling numbers for ``DISCOUNT``, [customers, tables] up to ``EXACT``."""
    if not _stirling:
        out = np.full((EXACT + 1, EXACT + 2), -np.inf)
        out[1, 1] = 0.0
        number = np.arange(EXACT + 2)
        with np.errstate(divide="ignore"):
            for n in range(1, EXACT):
                top = n + 2
                stay = out[n, 1:top] + np.log(np.maximum(n - DISCOUNT * number[1:top], 0))
                out[n + 1, 1:top] = np.logaddexp(out[n, : top - 1], stay)
        _stirling.append(out)
    return _stirling[0]


def pick(rng: np.random.Generator, length: np.ndarray, log_ratio, first, log_base=None) -> np.ndarray:
    """For each row a number from 1 to ``length``, by weights given as logs of the ratio of each to the one before.

    ``log_ratio(each, number)`` is the ratio of the weights of number + 1 and number, without
    ``log_base(each, number)``, the log of a factor; ``each`` repeats a value of every row for its numbers.
    Numbers below ``first`` have no weight.
    """
    each = lambda x: np.repeat(x, length)
    begin = np.r_[0, np.cumsum(length)[:-1]]
    number = np.arange(int(length.sum())) - each(begin - 1)
    step = log_ratio(each, number)
    open_ = None if (first <= 1).all() else number >= each(first)
    if open_ is not None:
        step[~open_] = 0.0
    total = np.cumsum(step) - step
    weight = total - each(total[begin])
    if log_base is not None:
        weight += log_base(each, number)
    if open_ is not None:
        weight[~open_] = -np.inf
    with np.errstate(divide="ignore"):
        weight -= np.log(-np.log(1 - rng.random(len(number))))  # Gumbel
    best = np.flatnonzero(weight == each(np.maximum.reduceat(weight, begin)))
    out = np.zeros(len(length), np.int64)
    out[np.searchsorted(begin, best, "right") - 1] = number[best]
    return out


def draw_parent(rng: np.random.Generator, tables: np.ndarray, before: np.ndarray, all_parent: float, base: float) -> np.ndarray:
    """The parent's tables of words that have so many in all contexts, from their exact conditional for a discount of a half.

    ``before``: the parent's tables of each word in the last sweep, which are part of
    ``all_parent``. Stirling numbers of a half have the ratio 4 (n - k) / (k (2n - k - 1)) from k to k + 1.
    """
    out = np.minimum(tables, 1)
    open_ = np.flatnonzero(tables > 1)
    for some in np.array_split(open_, max(1, int(tables[open_].sum()) // DRAWN_AT_ONCE)):
        if len(some):
            n, others = tables[some], all_parent - before[some]

            def ratio(each, k, n=n, others=others):
                n = each(n)
                number = np.maximum(n - k, 1e-300) * 4 / (k * np.maximum(2 * n - k - 1, 1))
                return np.log(number * (PARENT_STRENGTH + PARENT_DISCOUNT * (each(others) + k)) * base)

            out[some] = pick(rng, n, ratio, np.ones(len(n), np.int64))
    return out


def table_weight(n, k):
    """Weight in the parent of one more table of a word with ``n`` tables, ``k`` of the parent's; Stirling numbers of a half."""
    return (2 * n - k + 1) * (2 * n - k) / (4 * (n - k + 1))


def draw_cells(rng: np.random.Generator, count, tables, context_tables, word_tables, word_parent, all_tables: float) -> np.ndarray:
    """Tables of cells of ``EXACT`` customers at most from their exact conditional, given the totals without their own."""
    out = tables.copy()
    for some in np.array_split(np.arange(len(count)), max(1, int(count.sum()) // DRAWN_AT_ONCE)):
        if not len(some):
            continue
        c, t = count[some], tables[some]
        above, of_word, parent = context_tables[some] - t, word_tables[some] - t, word_parent[some]
        numbers = stirling()

        def ratio(each, number, t=t, above=above, of_word=of_word, parent=parent):
            opens = STRENGTH + DISCOUNT * (each(above) + number)
            parent = each(parent)
            n = np.maximum(each(of_word) + number, parent)
            return np.log(opens * table_weight(n, parent) / (PARENT_STRENGTH + all_tables - each(t) + number))

        first = np.maximum(1, parent - of_word)
        out[some] = pick(rng, c, ratio, first, lambda each, number, c=c, numbers=numbers: numbers.ravel()[each(c * numbers.shape[1]) + number])
    return out


def reseat(rng: np.random.Generator, sizes: np.ndarray, context_tables: int, word_tables: int, parent: int, all_tables: float) -> np.ndarray:
    """Each customer of a cell leaves its table and sits down again, given the totals without the cell's tables."""
    held = sizes.tolist()
    at = rng.permutation(np.repeat(np.arange(len(held)), sizes)).tolist()  # in any order, as sizes do not say who sits where
    n, t, free = len(at), len(held), []
    for i, (u, (a, b)) in enumerate(zip(rng.random(n).tolist(), rng.random((n, 2)).tolist(), strict=True)):
        k = at[i]
        if held[k] == 1 and word_tables + t <= parent:
            continue  # the parent has a table for each of the word's: none can go
        held[k] -= 1
        if not held[k]:
            t -= 1
            free.append(k)
        opens = (STRENGTH + DISCOUNT * (context_tables + t)) * table_weight(word_tables + t, parent) / (PARENT_STRENGTH + all_tables + t)
        if u * (opens + n - 1 - DISCOUNT * t) < opens:
            k = free.pop() if free else len(held)
            if k == len(held):
                held.append(0)
            t += 1
        else:
            while True:  # with another customer, then less the discount of the table
                j = int(a * n)
                k = at[j]
                if j != i and b * held[k] < held[k] - DISCOUNT:
                    break
                a, b = rng.random(), rng.random()
        held[k] += 1
        at[i] = k
    return np.array([x for x in held if x], np.int64)


def sums_of(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of each value."""
    names, at = np.unique(keys, return_inverse=True)
    return (names, *[np.bincount(at, v, len(names)) for v in values])


@dataclass
class Cells:
    """Cells of two customers and more. ``sizes``: of the tables of those with more than ``EXACT``; ``mean``: sums of probabilities."""

    word: np.ndarray
    context: np.ndarray
    count: np.ndarray
    tables: np.ndarray
    more: np.ndarray  # mean, tables of the word, the parent's tables of the word
    sizes: list[np.ndarray]

    @classmethod
    def read(cls, rows: list) -> Cells:
        get = lambda name, kind: np.concatenate([np.frombuffer(getattr(r, name), kind) for r in rows] or [np.zeros(0, kind)])
        word, context = get("keys", np.uint64), get("others", np.uint64)
        n = [len(r.keys) // 8 for r in rows]
        whole = lambda name: np.concatenate([unpacked(getattr(r, name), k) for r, k in zip(rows, n, strict=True)] or [np.zeros(0, np.int64)])
        count, tables = whole("counts"), whole("tables")
        more, flat = np.zeros((len(word), 3)), [np.zeros(0, np.int64)]
        low = 0
        for r, k in zip(rows, n, strict=True):
            means, *totals, sizes = pickle.loads(r.extra)
            if means:
                more[low : low + k, 0] = np.frombuffer(means)
            for column, x in enumerate(totals, 1):
                more[low : low + k, column] = unpacked(x, k) if x else 0
            flat.append(np.frombuffer(sizes, np.int64))
            low += k
        lengths = tables[count > EXACT]
        return cls(word, context, count, tables, more, np.split(np.concatenate(flat), np.cumsum(lengths)[:-1]) if len(lengths) else [])

    def rows(self, parts: np.ndarray, kind: int = CELLS) -> Iterator[tuple]:
        sizes = np.full(len(self.word), None, object)
        for i, x in zip(np.flatnonzero(self.count > EXACT), self.sizes):  # none of them in ``MEANS``
            sizes[i] = x
        order = np.lexsort((self.context, self.word, parts))
        for at in np.split(order, np.flatnonzero(np.diff(parts[order])) + 1):
            if len(at):
                means, totals = self.more[at, 0], self.more[at, 1:].T.astype(np.int64)
                flat = np.concatenate([np.zeros(0, np.int64), *[x for x in sizes[at] if x is not None]])
                known = [packed(x) if x.any() else NONE for x in totals]
                extra = pickle.dumps((means.tobytes() if means.any() else NONE, *known, flat.astype(np.int64).tobytes()))
                yield (
                    int(parts[at[0]]), 0, self.word[at].tobytes(), self.context[at].tobytes(), packed(self.count[at]),
                    packed(self.tables[at]), extra, 0.0, 0.0, 0.0, kind,
                )


def by_part(parts: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The distinct parts, and the rows of each in turn."""
    order = np.argsort(parts, kind="stable")
    each = [x for x in np.split(order, np.flatnonzero(np.diff(parts[order])) + 1) if len(x)]
    return [int(parts[x[0]]) for x in each], each


def dealt(parts: np.ndarray, keys: np.ndarray, values: np.ndarray, kind: int, source: int = 0) -> Iterator[tuple]:
    """A row per part: its keys, and the matrix of their values, which are whole numbers."""
    for part, at in zip(*by_part(parts), strict=True):
        yield (part, source, keys[at].tobytes(), NONE, NONE, NONE, pickle.dumps([packed(x) for x in values[at].T]), 0.0, 0.0, 0.0, kind)


def columns(data: bytes, n: int) -> np.ndarray:
    return np.array([unpacked(x, n) for x in pickle.loads(data)], np.float64).T


def matrix(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of rows from ``dealt``."""
    keys = np.concatenate([np.frombuffer(r.keys, np.uint64) for r in rows] or [np.zeros(0, np.uint64)])
    return keys, np.concatenate([columns(r.extra, len(r.keys) // 8) for r in rows]) if rows else np.zeros((0, 2))


def sent(rows) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=[x.split()[0] for x in SENT.split(", ")])


def exchange(tables: list[DataFrame], of_bucket) -> DataFrame:
    """Rows of ``SENT`` brought together by bucket; what ``of_bucket(bucket, rows)`` yields."""
    every = tables[0]
    for other in tables[1:]:
        every = every.unionByName(other)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if held and row.bucket != held[0].bucket:
                    yield sent(of_bucket(int(held[0].bucket), held))
                    held = []
                held.append(row)
        if held:
            yield sent(of_bucket(int(held[0].bucket), held))

    return every.repartition("bucket").sortWithinPartitions("bucket", "kind", "source", "keys").mapInPandas(run, SENT)


def kept(rows: DataFrame, name: str) -> DataFrame:
    spark = rows.sparkSession
    path = reserve(spark, name)
    with arrow_rows(spark, BLOCKS_AT_ONCE), shuffles_dropped(spark):
        rows.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    return spark.read.schema(SENT).parquet(path)


def drop_kinds(rows: DataFrame, *kinds: int) -> None:
    """Remove those rows of a table from ``kept`` that the next sweep has replaced."""
    for path in {f.rsplit("/", 1)[0] for f in of_kind(rows, *kinds).inputFiles()}:
        if path.rpartition("/kind=")[2] in map(str, kinds):
            drop(rows.sparkSession, path)


def of_kind(rows: DataFrame, *kinds: int) -> DataFrame:
    return rows.where(F.col("kind").isin(*kinds))


@dataclass
class All:
    """Totals of everything after a sweep."""

    tokens: int = 0
    words: int = 0
    tables: float = 0.0
    parent: float = 0.0

    @property
    def base(self) -> float:
        return 1.0 / (self.words + 1)

    def of_word(self, tables, parent):
        """The parent's probability of a word."""
        opens = (PARENT_STRENGTH + PARENT_DISCOUNT * self.parent) * self.base
        return (tables - PARENT_DISCOUNT * parent + opens) / (PARENT_STRENGTH + self.tables)


def only_units(table: DataFrame) -> DataFrame:
    return table.where(F.col("bucket") != KEYS)


def each_bucket(table: DataFrame, of_row) -> DataFrame:
    """What ``of_row(row)`` yields for the cells of every bucket; their tokens are not read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield sent(of_row(row))

    return only_units(table).select(CELL_COLUMNS).mapInPandas(run, SENT)


def started(table: DataFrame, parts: int) -> DataFrame:
    """What the buckets tell at first: cells to draw, and what does not change of words and contexts."""

    def rows(row) -> Iterator[tuple]:
        words, contexts, word, context, count, _ = unpack_cells(row)
        single, many = count == 1, count > 1
        for kind, names, at in ((WORDS, words, word), (CONTEXTS, contexts, context)):
            totals = np.stack([np.bincount(at, count, len(names)), np.bincount(at, single, len(names))], axis=1)
            there = totals[:, 0] > 0 if kind == WORDS else np.ones(len(names), bool)
            yield from dealt(part_of(names[there], parts), names[there], totals[there], kind)
        n, word, context = int(many.sum()), words[word], contexts[context]
        sizes = [np.array([c]) for c in count[many] if c > EXACT]
        yield from Cells(word[many], context[many], count[many], np.ones(n, np.int64), np.zeros((n, 3)), sizes).rows(part_of(word[many], parts))

    return kept(each_bucket(table, rows), "lm-start")


def asked(table: DataFrame, parts: int) -> DataFrame:
    """The contexts whose totals each bucket needs."""

    def rows(row) -> Iterator[tuple]:
        names = np.frombuffer(row.contexts, np.uint64)
        yield from dealt(part_of(names, parts), names, np.zeros((len(names), 0)), ASKED, int(row.bucket))

    return each_bucket(table, rows)


def by_word(tables: list[DataFrame], parts: int, spread: np.ndarray, last: All, sweep: int) -> tuple[DataFrame, All]:
    """Sum the tables of each word and draw the parent's (one each at first)."""

    def of_part(part: int, rows: list) -> Iterator[tuple]:
        keys, values = matrix([r for r in rows if r.kind in (WORDS, WORD_TOTALS)])
        cells = Cells.read([r for r in rows if r.kind == CELLS])
        names, total, ones, *before = sums_of(keys, *values.T)  # before: the parent's tables after the last sweep
        at = np.searchsorted(names, cells.word)
        tables = (ones + np.bincount(at, cells.tables, len(names))).astype(np.int64)
        rng = np.random.default_rng([12, part, sweep])
        parent = draw_parent(rng, tables, before[0], last.parent, last.base) if sweep else np.minimum(tables, 1)
        cells.more[:, 1:] = np.c_[tables, parent][at]
        yield from cells.rows(part_of(cells.context, parts))
        values = np.c_[total, ones, parent, tables]
        yield from dealt(np.full(len(names), part), names, values, WORD_TOTALS, sweep)
        often = place_of(names, spread) > RARE
        yield from dealt(np.full(int(often.sum()), part), names[often], values[often], SPREAD_TOTALS, sweep)
        yield (part, 0, NONE, NONE, NONE, NONE, NONE, float(total.sum()), float(tables.sum()), float(parent.sum()), UNITS)
        yield (part, 1, NONE, NONE, NONE, NONE, NONE, float(len(names)), 0.0, 0.0, UNITS)

    out = kept(exchange(tables, of_part), "lm-words")
    found = {r["source"]: r for r in of_kind(out, UNITS).groupBy("source").agg(*[F.sum(c).alias(c) for c in ("n", "m", "v")]).collect()}
    if not found:
        return out, All()
    return out, All(round(found[0]["n"]), round(found[1]["n"]), found[0]["m"], found[0]["v"])


def by_context(tables: list[DataFrame], parts: int, spread: np.ndarray, last: All, sweep: int, sample: bool, final: bool = False) -> DataFrame:
    """Take a sample of the seating if told so; then draw the tables of all cells anew, or, at the end, answer the buckets."""

    def of_part(part: int, rows: list) -> Iterator[tuple]:
        keys, values = matrix([r for r in rows if r.kind == CONTEXTS])
        names, at = np.unique(keys, return_inverse=True)
        totals = np.stack([np.bincount(at, v, len(names)) for v in values.T], axis=1) if len(names) else values
        cells = Cells.read([r for r in rows if r.kind == CELLS])
        place = np.searchsorted(names, cells.context)
        tables = (totals[:, 1] + np.bincount(place, cells.tables, len(names))).astype(np.int64)
        if sample:
            opens = (STRENGTH + DISCOUNT * tables[place]) * last.of_word(cells.more[:, 1], cells.more[:, 2])
            cells.more[:, 0] += (cells.count - DISCOUNT * cells.tables + opens) / (STRENGTH + totals[place, 0])
            totals = np.c_[totals, tables]
        of_word, parent = cells.more[:, 1].astype(np.int64), cells.more[:, 2].astype(np.int64)
        cells.more[:, 1:] = 0  # known to the part of the word
        if final:
            to = bucket_of(cells.word, cells.context, place_of(cells.word, spread) > RARE, in_all(cells.context, spread), parts)
            order = np.lexsort((cells.context, cells.word, to))
            for at in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):  # the bucket knows which cells these are
                if len(at):
                    yield (int(to[at[0]]), part, NONE, NONE, NONE, NONE, cells.more[at, 0].tobytes(), 0.0, 0.0, 0.0, MEANS)
            for r in rows:
                if r.kind == ASKED:
                    there = totals[np.searchsorted(names, np.frombuffer(r.keys, np.uint64))]
                    yield (int(r.source), part, NONE, NONE, NONE, NONE, pickle.dumps([packed(x) for x in np.delete(there, 1, axis=1).T]), 0.0, 0.0, 0.0, ANSWERS)
            return
        rng = np.random.default_rng([13, part, sweep])
        small = cells.count <= EXACT
        new = cells.tables.copy()
        new[small] = draw_cells(rng, cells.count[small], cells.tables[small], tables[place][small], of_word[small], parent[small], last.tables)
        for k, i in enumerate(np.flatnonzero(~small)):
            t = int(cells.tables[i])
            cells.sizes[k] = reseat(rng, cells.sizes[k], int(tables[place[i]]) - t, int(of_word[i]) - t, int(parent[i]), last.tables - t)
            new[i] = len(cells.sizes[k])
        cells.tables = new
        yield from cells.rows(part_of(cells.word, parts))
        if sample:
            yield from dealt(np.full(len(names), part), names, totals, CONTEXTS)

    return exchange(tables, of_part)


def scored(table: DataFrame, spread: np.ndarray, buckets: int, samples: int) -> tuple[DataFrame, int]:
    """(key, score, base_score, n_tokens, n_known) sums by bucket and number of the text, and the number of training tokens."""
    spark = table.sparkSession
    start = started(table, buckets)
    contexts = of_kind(start, CONTEXTS)
    state, last = by_word([of_kind(start, WORDS), of_kind(start, CELLS)], buckets, spread, All(), 0)
    drop_kinds(start, WORDS, CELLS)
    taken: list[tuple[DataFrame, All]] = []
    sweep, burnt = 0, False
    while len(taken) < samples:
        sweep += 1
        seated = kept(by_context([contexts, of_kind(state, CELLS)], buckets, spread, last, sweep, bool(taken)), "lm-contexts")
        if taken:
            drop_kinds(contexts, CONTEXTS)
            contexts = of_kind(seated, CONTEXTS)
        drop_kinds(state, CELLS)
        before, old = last.tables, state
        state, last = by_word([of_kind(old, WORD_TOTALS), of_kind(seated, CELLS)], buckets, spread, last, sweep)
        drop_kinds(seated, CELLS)
        if not taken:
            drop_kinds(old, WORD_TOTALS, SPREAD_TOTALS, UNITS)
        change = abs(last.tables - before)
        settled = sweep > BURN_IN and change <= max(SETTLED * before, 4 * before**0.5)
        if sweep == MOST_BURN_IN and not (burnt or settled):
            warnings.warn(f"sampling has not settled after {sweep} sweeps: the last changed the tables by {change / before:.2%}", stacklevel=2)
        burnt = burnt or settled or sweep >= MOST_BURN_IN
        if burnt:
            taken.append((state, last))
    final = by_context([contexts, of_kind(state, CELLS), asked(table, buckets)], buckets, spread, last, sweep + 1, True, True)
    often = [{} for _ in taken]
    for i, (each, _) in enumerate(taken):
        for r in of_kind(each, SPREAD_TOTALS).select("keys", "extra").toLocalIterator():
            keys, values = matrix([r])
            often[i].update(zip(keys.tolist(), values.tolist(), strict=True))
    # Spread words by their place in the sorted hashes, by sample.
    known = np.array([[o.get(w, [0.0] * 4) for w in spread.tolist()] for o in often]).reshape(len(taken), len(spread), 4)
    held = spark.sparkContext.broadcast((spread, known, [a for _, a in taken]))

    def of_bucket(unit: pd.DataFrame, messages: pd.DataFrame) -> pd.DataFrame:
        spread, known, everything = held.value
        names, asked, name, of_context, count, size, text, texts = unpack(next(unit.itertuples(index=False)))
        rows = list(messages.itertuples(index=False))
        place = place_of(names, spread).astype(np.int64) - RARE - 1
        of_part = lambda contexts: dict(zip(*by_part(part_of(contexts, buckets)), strict=True))
        at, answers = of_part(asked), np.zeros((len(asked), 1 + len(everything)))
        for r in rows:
            if r.kind == ANSWERS:
                answers[at[r.source]] = columns(r.extra, len(at[r.source]))
        mean = np.zeros(len(name))
        for i, a in enumerate(everything):
            keys, values = matrix([r for r in rows if r.kind == WORD_TOTALS and r.source == i])
            own = np.zeros((len(names), 4))
            if len(keys):
                at = np.minimum(np.searchsorted(keys, names), len(keys) - 1)
                there = keys[at] == names
                own[there] = values[at[there]]
            own[place >= 0] = known[i][place[place >= 0]]
            opens = (STRENGTH + DISCOUNT * answers[:, 1 + i])[of_context] * a.of_word(own[:, 3], own[:, 2])[name]
            mean += ((1 - DISCOUNT) * count + opens) / (STRENGTH + answers[:, 0])[of_context]
        many = np.flatnonzero(count > 1)
        at = of_part(asked[of_context[many]])
        for r in rows:
            if r.kind == MEANS:
                mean[many[at[r.source]]] = np.frombuffer(r.extra)
        mean /= len(everything)
        s = everything[0]
        base = np.log10((own[:, 0] + SMOOTH) / (s.tokens + SMOOTH * (s.words + 1)))[name]
        by_text = lambda x: np.bincount(text, np.repeat(x, size), len(texts))
        return pd.DataFrame({
            "key": texts, "score": by_text(np.log10(mean)), "base_score": by_text(base), "n_tokens": np.bincount(text, minlength=len(texts)),
            "n_known": by_text((own[:, 0] > 0)[name].astype(float)).astype(np.int64),
        })

    messages = of_kind(final, MEANS, ANSWERS)
    for i, (each, _) in enumerate(taken):
        messages = messages.unionByName(of_kind(each, WORD_TOTALS).withColumn("source", F.lit(i)))
    # The table is bucketed by this key, so the messages alone are shuffled.
    each = only_units(table).groupBy("bucket").cogroup(messages.groupBy("bucket")).applyInPandas(of_bucket, SUMS)
    return each.mapInPandas(combined, SUMS), last.tokens


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """A row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Rows whose id has a CRC-32 divisible by 10 (null ids among them) are held out; the others
    train the model. A null text is empty: one token, its end. Rows that repeat id and text each train, and
    get equal scores. With nothing to train on, probabilities are uniform over one unknown
    word. Only id and text are read.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumns({"held_out": held_out(F.col("doc_id")), "key": F.xxhash64("doc_id", "text")})
    size = docs.agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n")).first()
    buckets = parts_for((size["chars"] or 0) / 6 + size["n"], BUCKET_TOKENS, 8)
    frequent = frequent_words(docs)
    table = units(token_blocks(docs, frequent, buckets), buckets)
    each, tokens = scored(table, frequent, buckets, samples)
    names = ["score", "base_score", "n_tokens", "n_known"]
    with shuffles_dropped(docs.sparkSession):
        sums = written(each.groupBy(F.col("key").alias("text")).agg(*[F.sum(c).alias(c) for c in names]), "lm-sums")
    sums = sums.join(text_keys(table), "text").groupBy(F.col("key").alias("k")).agg(*[F.sum(c).alias(c) for c in names])
    rows = docs.select("doc_id", "held_out", "key")
    copies = rows.groupBy(F.col("key").alias("k2")).agg(F.count(F.lit(1)).alias("copies"))  # equal rows share one sum
    sums = sums.join(copies, F.col("k") == F.col("k2")).select("k", *[(F.col(c) / F.col("copies")).alias(c) for c in names])
    return rows.join(sums, F.col("key") == F.col("k")).select(
        "doc_id",
        "held_out",
        F.col("n_tokens").cast("long").alias("n_tokens"),
        F.col("n_known").cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
