"""Joins of facts with per-group results, safe for many groups and for hot groups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from basketlens.sources.scratch import written, written_with_facts

# A lookup is broadcast only when it was seen to have at most this many rows and bytes.
BROADCAST_ROWS = 10_000
BROADCAST_BYTES = 8 << 20


@dataclass(frozen=True)
class Lookup:
    """One row per group. ``rows`` holds them if there were seen to be few."""

    df: DataFrame
    rows: Sequence[Row] | None = None

    @property
    def small(self) -> bool:
        return self.rows is not None



def held(lookup: DataFrame, by: Sequence[str], max_rows: int = BROADCAST_ROWS) -> Lookup:
    """The groups computed once: one row is taken as it is, more are written and taken if they are small."""
    if not by:
        return taken(lookup)
    size = F.sum(F.lit(8 * len(lookup.columns)) + _text_bytes(lookup, by))
    table, facts = written_with_facts(
        lookup, "group-values", F.count(F.lit(1)).alias("rows"), size.alias("bytes")
    )
    if facts["rows"] <= max_rows and (facts["bytes"] or 0) <= BROADCAST_BYTES:
        return taken(table)
    return Lookup(table)


def taken(lookup: DataFrame) -> Lookup:
    """The rows of a lookup that is known to be small."""
    rows = lookup.collect()
    return Lookup(lookup.sparkSession.createDataFrame(rows, lookup.schema), rows)


def _text_bytes(lookup: DataFrame, by: Sequence[str]) -> Column:
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c in by if lookup.schema[c].dataType.typeName() == "string"]
    return sum(texts, F.lit(0))


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]]) -> Column:
    """Key equality in which a missing key equals a missing key."""
    first, *rest = [left[a].eqNullSafe(right[b]) for a, b in keys]
    for equal in rest:
        first = first & equal
    return first


def attach(
    facts: DataFrame,
    lookup: Lookup,
    keys: Sequence[str],
    values: Sequence[str],
    weight: str | None = None,
    *,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left join of ``facts`` with the ``values`` of their group; null is a group like any other.

    A small lookup is broadcast and the facts do not move. A large one is split by the number
    of facts per group: fewer than ``max_rows`` groups can hold more than 1/``max_rows`` of
    all facts. Those hot groups are broadcast and their facts stay where they are; the rest is
    shuffled, and no key in it is hot. ``weight`` is a column of the lookup with that
    number, if it was learnt from these facts; else they are counted, map side first.
    """
    if not keys:  # one row: its values are literals, which filters can use
        types = lookup.df.schema
        return facts.withColumns({c: F.lit(lookup.rows[0][c]).cast(types[c].dataType) for c in values})
    columns = [*facts.columns, *values]
    pairs = [(k, f"_key_{k}") for k in keys]
    named = lookup.df.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *values, *([weight] if weight else []))
    if lookup.small:
        few = F.broadcast(named)
        return facts.join(few, null_safe(facts, named, pairs), "left").select(*columns)

    if weight is None:
        # Hot keys of the facts; one that the lookup does not know gets nulls where it is.
        weight = "_weight"
        counts = written(facts.groupBy(*[F.col(k).alias(f"_fact_{k}") for k in keys]).agg(F.count("*").alias(weight)), "fact-counts")
        total = counts.agg(F.sum(weight)).first()[0] or 0
        often = counts.where(F.col(weight) > F.lit(total / max_rows))
        joined = often.join(named, null_safe(often, named, [(f"_fact_{k}", f"_key_{k}") for k in keys]), "left")
        hot = joined.select(*[F.col(f"_fact_{k}").alias(f"_key_{k}") for k in keys], *values)
        cold = named
    else:
        total = named.agg(F.sum(weight)).first()[0]
        is_hot = F.col(weight) > F.lit(total / max_rows)
        hot, cold = named.where(is_hot), named.where(~is_hot)
    hot_facts = facts.join(F.broadcast(hot), null_safe(facts, hot, pairs), "inner")
    other = facts.join(F.broadcast(hot), null_safe(facts, hot, pairs), "left_anti")
    other = other.join(cold, null_safe(other, cold, pairs), "left")
    return hot_facts.select(*columns).unionByName(other.select(*columns))
