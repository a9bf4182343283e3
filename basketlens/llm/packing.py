"""Packing of documents into token sequences: exact complements first, best fit for the rest.

Documents are tokenized and cut in Arrow batches. Only the number of pieces of each length
(at most ``capacity`` numbers) reaches the driver, where the packing is planned on counts:

1. Exact-complement hashing. Lengths are taken from the longest. Tables of the sums that one,
   two or three available lengths make say in constant time whether lengths that fill a gap
   exactly are there; their counts decide whether they suffice, and a combination is consumed as often as the counts of its lengths allow.
2. What finds no exact complement is packed best fit, longest first, again in bulk: all
   sequences with the same gap are one entry.

The plan is a list of slots (length, first number, sequences, offset). Each piece gets a number among
those of its length, from counts of (length, bucket) and a rank inside its bucket, and a range
join with the slots of its length gives its place. No group holds all pieces of a length.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketlens.llm.tables import parts_for, table
from basketlens.sources.scratch import written

CAPACITY = 2048
END_ID = 0
PIECES_PER_BUCKET = 2_000



# --- planning on counts -------------------------------------------------------------------


class Sums:
    """Counts of lengths, and how many pairs and triples of available lengths make each sum."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.astype(np.int64).copy()  # by length
        size = len(counts)
        self.there = self.n > 0
        self.pairs, self.triples = np.zeros(2 * size, np.int64), np.zeros(3 * size, np.int64)
        lengths = np.flatnonzero(self.there)
        for i, a in enumerate(lengths.tolist()):
            self.pairs[a + lengths[: i + 1]] += 1
            self.triples[a : a + 2 * size] += self.pairs  # those whose largest is this length

    def take(self, length: int, times: int) -> None:
        self.n[length] -= times
        if self.n[length] == 0 and self.there[length]:
            self.triples[length : length + len(self.pairs)] -= self.pairs
            self.pairs[length + np.flatnonzero(self.there)] -= 1
            self.there[length] = False

    def available(self, lengths: list[int]) -> int:
        """How often the combination can be taken."""
        need = defaultdict(int)
        for x in lengths:
            need[x] += 1
        return min(int(self.n[x]) // k for x, k in need.items())

    def single(self, gap: int) -> list[int] | None:
        return [gap] if gap < len(self.n) and self.there[gap] else None

    def pair(self, gap: int, top: int | None = None) -> list[int] | None:
        if gap <= 1 or not self.pairs[gap]:
            return None
        high = np.arange(min(gap - 1, len(self.n) - 1, top or gap), (gap - 1) // 2, -1)
        fits = high[self.there[high] & self.there[gap - high]]
        fits = [a for a in fits.tolist() if 2 * a != gap or self.n[a] > 1]
        return [fits[0], gap - fits[0]] if fits else None

    def triple(self, gap: int) -> list[int] | None:
        if not self.triples[gap]:
            return None
        first = np.flatnonzero(self.there[: gap - 1])[::-1]
        for a in first[self.pairs[gap - first] > 0].tolist():
            rest = self.pair(gap - a)
            if rest and self.available([a, *rest]):
                return [a, *rest]
        return None


def exact_rounds(counts: np.ndarray, capacity: int) -> tuple[list[tuple[list[int], int]], np.ndarray]:
    """Combinations that fill a sequence exactly, with how often each is used, and the counts left over."""
    sums, found = Sums(counts), []
    for length in range(capacity - 1, 0, -1):
        while sums.n[length]:
            gap = capacity - length
            for search in (sums.single, sums.pair, sums.triple):
                rest = search(gap)
                times = sums.available([length, *rest]) if rest else 0
                if times:
                    break
            else:
                break
            for x in (whole := [length, *rest]):
                sums.take(x, times)
            found.append((whole, times))
    return found, sums.n


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Best fit, longest first, on counts: what it would do piece by piece, in bulk."""
    open_by_gap: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    gaps = np.zeros(capacity + 1, bool)
    for length in range(len(counts) - 1, 0, -1):
        left = int(counts[length])
        while left:
            fitting = np.flatnonzero(gaps[length:])
            gap = int(fitting[0]) + length if len(fitting) else capacity
            per = gap // length
            if len(fitting):
                content, bins = open_by_gap[gap].pop()
                if not open_by_gap[gap]:
                    gaps[gap] = False
            else:
                content, bins = [], max(1, left // per)
            used = min(bins, left // per)
            if used:
                placed = [(content + [length] * per, used, gap - per * length)]
                rest = [(content, bins - used, gap)] if bins > used else []
            else:
                placed = [(content + [length] * left, 1, gap - left * length)]
                rest, used, per = ([(content, bins - 1, gap)] if bins > 1 else []), 1, left
            left -= used * per
            for what, times, room in placed + (rest if content else []):
                open_by_gap[room].append((what, times))
                gaps[room] = True
    return [x for room in open_by_gap.values() for x in room]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first number, how many, first sequence, offset).

    The pieces numbered from ``first`` of that length go, one each, to the sequences from
    ``first sequence`` on, at ``offset``.
    """
    n = np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        n[length] = count
    whole = [([capacity], int(n[capacity]))] if n[capacity] else []
    exact, rest = exact_rounds(n[:capacity], capacity)
    slots, taken, sequence = [], defaultdict(int), 0
    for lengths, times in whole + exact + best_fit(rest, capacity):
        offset = 0
        for length in lengths:
            slots.append((length, taken[length], times, sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    return slots


# --- packing tables -----------------------------------------------------------------------


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; sequences hold at most ``capacity``.

    Each row with a length from 1 to ``capacity`` gets a place, and other lengths raise an
    error. Pieces of equal length may swap places between runs only if the rows themselves
    are written anew; here they are numbered by a written table. An empty table stays empty.
    """
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    valid = F.when(F.col(length).between(1, capacity), F.col(length)).otherwise(F.raise_error("length out of range"))
    rows = written(pieces.select(*names).withColumn(length, valid).withColumn("_at", F.monotonically_increasing_id()), "pieces")
    n_rows = rows.count()
    bucket = F.pmod(F.xxhash64("_at"), F.lit(parts_for(n_rows, PIECES_PER_BUCKET)))
    rows = rows.withColumn("_bucket", bucket)
    sizes = written(rows.groupBy(F.col(length).alias("_length"), "_bucket").agg(F.count(F.lit(1)).alias("_n")), "piece-counts")
    counts = {r["_length"]: r["n"] for r in sizes.groupBy("_length").agg(F.sum("_n").alias("n")).collect()}
    slots = plan(counts, capacity)
    spark = pieces.sparkSession
    # At most a few slots for each length: their number depends on the lengths, not on the pieces.
    schema = "_length long, _first long, _times long, _sequence long, offset long"
    slot_rows = spark.createDataFrame(slots, schema)

    before = Window.partitionBy("_length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_bucket", length).orderBy("_at")
    numbered = rows.withColumn("_rank", F.row_number().over(inside) - 1)
    numbered = numbered.join(starts.withColumnRenamed("_bucket", "_b"), (F.col(length) == F.col("_length")) & (F.col("_bucket") == F.col("_b")))
    numbered = numbered.withColumn("_number", F.col("_start") + F.col("_rank")).drop("_length")
    of_length = slot_rows.groupBy("_length").agg(
        F.sort_array(F.collect_list(F.struct("_first", "_times", "_sequence", "offset"))).alias("_slots")
    )
    placed = numbered.join(F.broadcast(of_length), F.col(length) == F.col("_length"))
    hit = F.filter("_slots", lambda s: (s["_first"] <= F.col("_number")) & (F.col("_number") < s["_first"] + s["_times"]))[0]
    return placed.withColumn("_slot", hit).select(
        *names,
        (F.col("_slot._sequence") + F.col("_number") - F.col("_slot._first")).alias("sequence_id"),
        F.col("_slot.offset").alias("offset"),
    )


# --- tokens -------------------------------------------------------------------------------


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _encoding(path: str):
    """The byte-level BPE of a tokenizers file, run by tiktoken where its ranks lie beside it.

    Both give the same ids (tests compare them); tiktoken is several times faster.
    """
    ranks = Path(path).with_suffix(".tiktoken")
    if not ranks.exists():
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        return lambda text: model.encode(text, add_special_tokens=False).ids
    import public_tokenizers
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.read_bytes().splitlines())}
    special = {"<|endoftext|>": len(merges)}
    model = tiktoken.Encoding(ranks.stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=special)
    return lambda text: model.encode(text, allowed_special="all")


def cut(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: full ones, after a shorter first one if needed."""
    first = n_tokens % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n_tokens, capacity))]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", with_ids: bool = True) -> DataFrame:
    """A row per piece: the columns of ``docs`` but the text, and piece, start, length, ids, ids_crc32.

    A document is its ids and a closing ``END_ID``; null is an empty text, one id. ``ids`` are
    little-endian unsigned 32-bit numbers; ``with_ids=False`` leaves them null.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("piece", "start", "length", "ids", "ids_crc32", text.lower())]
    fields = "array<struct<piece:int,start:long,length:long,ids:binary,ids_crc32:long>>"

    @F.pandas_udf(fields)
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(path)
        for batch in batches:
            out = []
            for t in batch:
                ids = np.array([*encode(t), END_ID], "<u4")
                row = []
                for i, (at, n) in enumerate(cut(len(ids), capacity)):
                    own = ids[at : at + n].tobytes()
                    row.append({"piece": i, "start": at, "length": n, "ids": own if with_ids else None, "ids_crc32": zlib.crc32(own)})
                out.append(row)
            yield pd.Series(out, dtype=object)

    found = docs.select(*kept, F.explode(pieces(F.coalesce(F.col(text), F.lit("")))).alias("_p"))
    return found.select(*kept, "_p.*")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """All pieces of ``docs`` with their place: sequences of at most ``capacity`` ids, as few as the method finds."""
    return pack(token_pieces(docs, path or vocabulary(), capacity, with_ids=with_ids), "length", capacity)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
