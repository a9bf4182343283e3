"""Exact order statistics and quantiles per group, for several groupings at once.

The column is counted once, by the finest groups and by the fixed cells of ``cells.py``; that digest gives counts, means and
spreads of every grouping and tells in which cell each wanted rank lies. A later pass reads only what lies in
those cells: each value with its rows where few are left, else up to 65,536 equal steps of the cell, which the next
pass splits again. Running counts over a group's cells decide where a rank lies; values are never sorted, and equal
values are counted before they are shuffled, so neither ties nor a hot group make a task large.

Counters of few groups come to the driver, as those of a whole column do: 200,000 at most. Those of more groups stay in a
table, and running counts are windows over a group's counters.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from types import ModuleType

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basketlens.operators.cells import (
    STEPS,
    TASK_VALUES,
    cell_counts,
    first_cell,
    number,
    profile,
    settled,
    step,
)
from basketlens.operators.lookups import BROADCAST_ROWS, Lookup, attach, held, null_safe
from basketlens.sources.scratch import written_with_facts

#: Statistics of a group next to its ranks. ``m2`` and ``m3`` are sums of powers of the distance from the mean.
MOMENTS = ("n", "missing", "mean", "m2", "m3", "low", "high")
RANK = "struct<low:double,high:double,less:long,rows:long>"
#: A 0-based index from the number of values, as a column or an array; the second argument has floor and ceil for it.
# Counters that are brought to the driver, at most.
COUNTERS = 200_000
Index = Callable[[Column | np.ndarray, ModuleType], Column | np.ndarray]


@dataclass(frozen=True)
class Digest:
    """Rows, ends and moments of a column by group and fixed cell: a table that statistics are merged from."""

    table: DataFrame
    by: tuple[str, ...]
    rows: int


def _counted(df: DataFrame, value: str, by: Sequence[str], cubes: bool) -> DataFrame:
    """The one pass over all rows: a row per group and cell that occurs."""
    v = F.col("_v")
    keyed = df.select(*by, number(value).alias("_v")).select("*", first_cell(v).alias("_cell"))
    third = F.coalesce(F.nanvl(F.skewness(v), F.lit(0.0)) * F.pow(F.var_pop(v), 1.5) * F.count(v), F.lit(0.0)) if cubes else F.lit(None).cast("double")
    return keyed.groupBy(*by, "_cell").agg(*cell_counts(v), third.alias("_cubes"))


def digest(df: DataFrame, value: str, by: Sequence[str], cubes: bool = False) -> Digest:
    """The counted column, written; ``cubes`` says that m3 is wanted."""
    table, facts = written_with_facts(_counted(df, value, by, cubes), "value-digest", F.count(F.lit(1)).alias("rows"))
    return Digest(table, tuple(by), facts["rows"])


def _in_sets(df: DataFrame, by: Sequence[str], sets: Sequence[Sequence[str]], *rest: str) -> DataFrame:
    """Every row once per grouping: its number ``_set``, and the columns that are not part of it null."""
    if len(sets) == 1 and list(sets[0]) == list(by):
        return df.select(F.lit(0).alias("_set"), *by, *rest)
    tracks = [F.struct(F.lit(i).alias("_set"), *[(F.col(c) if c in s else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in by]) for i, s in enumerate(sets)]
    return df.select(F.explode(F.array(*tracks)).alias("_t"), *rest).select("_t.*", *rest)


def _first_state(source: Digest, sets: Sequence[Sequence[str]], indices: Sequence[Index]) -> DataFrame:
    """Per group of every grouping its moments, and for each wanted rank the cell that holds it."""
    track = ["_set", *source.by]
    rows = _in_sets(source.table, source.by, sets, "_cell", "_rows", "_low", "_high", "_mean", "_squares", "_cubes")
    known = F.col("_cell").isNotNull()
    rows = rows.withColumn("_n", F.when(known, F.col("_rows")).otherwise(0))
    group, cell = Window.partitionBy(*track), Window.partitionBy(*track, "_cell")
    placed = rows.select(
        "*",
        F.sum("_n").over(group).alias("_total"),
        F.try_divide(F.sum(F.col("_n") * F.col("_mean")).over(group), F.sum("_n").over(group)).alias("_middle"),
        F.sum("_n").over(group.orderBy("_cell")).alias("_running"),  # a cell may have a row per finer group
        F.sum("_n").over(cell).alias("_own"),
        F.min("_low").over(cell).alias("_from"),
        F.max("_high").over(cell).alias("_to"),
    )
    apart, n = F.col("_mean") - F.col("_middle"), F.col("_n")
    return placed.groupBy(*track).agg(
        F.first("_total").alias("n"),
        F.coalesce(F.sum(F.when(~known, F.col("_rows"))), F.lit(0)).alias("missing"),
        F.first("_middle").alias("mean"),
        F.sum(F.col("_squares") + n * apart * apart).alias("m2"),
        F.sum(F.col("_cubes") + 3 * apart * F.col("_squares") + n * apart * apart * apart).alias("m3"),
        F.min("_low").alias("low"),
        F.max("_high").alias("high"),
        *_picked(indices, F.col("_total"), F.col("_running") - F.col("_own"), F.col("_own"), F.col("_from"), F.col("_to"), known),
    )


def _picked(indices: Sequence[Index], n: Column, less: Column, rows: Column, low: Column, high: Column, where: Column) -> list[Column]:
    """Aggregates: for each index the struct (low, high, less, rows) of the cell that holds it, else null."""
    found = F.struct(low.alias("low"), high.alias("high"), less.alias("less"), rows.alias("rows"))
    return [F.max(F.when(where & (index(n, F) >= less) & (index(n, F) < less + rows), found)).alias(f"_r{i}") for i, index in enumerate(indices)]


def _open(i: int) -> Column:
    return F.coalesce(F.col(f"_r{i}.low") < F.col(f"_r{i}.high"), F.lit(False))


def _intervals(ranks: int) -> Column:
    """The cells of the ranks that are still open, each once."""
    cells = [F.when(_open(i), F.struct(F.col(f"_r{i}.low").alias("low"), F.col(f"_r{i}.high").alias("high"), F.col(f"_r{i}.rows").alias("rows"))) for i in range(ranks)]
    return F.array_distinct(F.array_compact(F.array(*cells)))


def _rows_left(state: Lookup, ranks: int) -> int:
    """Rows in the open cells of the group that has most of them."""
    if not ranks:
        return 0
    rows = F.aggregate(_intervals(ranks), F.lit(0).cast("long"), lambda total, c: total + c["rows"])
    return state.df.agg(F.max(rows)).first()[0] or 0


def _next_state(df: DataFrame, value: str, state: Lookup, by: Sequence[str], sets: Sequence[Sequence[str]], indices: Sequence[Index], most: int, task_values: int, max_rows: int) -> DataFrame:
    """The state after one more pass over what lies in the open cells."""
    track, v = ["_set", *by], F.col("_v")
    rows = df.select(*by, number(value).alias("_v")).where(v.isNotNull())
    for i, s in enumerate(sets):
        own = state.df.where(F.col("_set") == i).select(*s, "n", _intervals(len(indices)).alias(f"_cells{i}"))
        if s:
            rows = attach(rows, Lookup(own), s, [f"_cells{i}"], "n", max_rows=max_rows)
        else:  # one group: its cells are literals
            cells = [F.struct(F.lit(c["low"]).alias("low"), F.lit(c["high"]).alias("high")) for r in own.collect() for c in r[f"_cells{i}"]]
            rows = rows.withColumn(f"_cells{i}", F.array(*cells).cast("array<struct<low:double,high:double>>"))
    entries = []
    for i, s in enumerate(sets):
        inside = F.get(F.filter(f"_cells{i}", lambda c: (v >= c["low"]) & (v <= c["high"])), F.lit(0))
        keys = [(F.col(c) if c in s else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in by]
        entries.append(F.when(inside.isNotNull(), F.struct(F.lit(i).alias("_set"), *keys, inside["low"].alias("_start"), inside["high"].alias("_end"))))
    entry = F.explode(F.array_compact(F.array(*entries)))
    found = rows.select(entry.alias("_e"), "_v").select("_e._set", *[F.col(f"_e.`{c}`") for c in by], "_e._start", "_e._end", "_v")
    key = v if most <= task_values else step(v, F.col("_start"), F.col("_end"), STEPS).cast("double")
    counted = found.select(*track, "_start", key.alias("_key"), "_v").groupBy(*track, "_start", "_key").agg(
        F.count(F.lit(1)).alias("_own"), F.min("_v").alias("_from"), F.max("_v").alias("_to")
    )
    group = Window.partitionBy(*track)
    running = F.sum("_own").over(group.orderBy("_start", "_key")) - F.col("_own")
    placed = counted.withColumn("_running", running)
    placed = placed.withColumn("_less", F.col("_running") - F.min("_running").over(Window.partitionBy(*track, "_start")))
    old = state.df.select(*[F.col(c).alias(f"_k{c}") for c in track], "n", *[F.col(f"_r{i}") for i in range(len(indices))])
    joined = placed.join(old, null_safe(placed, old, [(c, f"_k{c}") for c in track]))
    picks = []
    for i, index in enumerate(indices):
        was = F.col(f"_r{i}")
        less, own = was["less"] + F.col("_less"), F.col("_own")
        at = index(F.col("n"), F)
        cell = F.struct(F.col("_from").alias("low"), F.col("_to").alias("high"), less.alias("less"), own.alias("rows"))
        picks.append(F.max(F.when(_open(i) & (F.col("_start") == was["low"]) & (at >= less) & (at < less + own), cell)).alias(f"_new{i}"))
    fresh = joined.groupBy(*track).agg(*picks).select(*[F.col(c).alias(f"_k{c}") for c in track], *[f"_new{i}" for i in range(len(indices))])
    both = state.df.join(fresh, null_safe(state.df, fresh, [(c, f"_k{c}") for c in track]), "left")
    return both.select(*track, *MOMENTS, *[F.coalesce(f"_new{i}", f"_r{i}").alias(f"_r{i}") for i in range(len(indices))])


@dataclass(frozen=True)
class Counters:
    """Counters of few groups on the driver: cells in ascending order, one group (``tracks``) after the other."""

    by: tuple[str, ...]
    kinds: StructType
    tracks: list[tuple]
    finest: dict[tuple, list[int]]
    moments: dict[str, np.ndarray]
    track: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, source: Digest, sets: Sequence[Sequence[str]]) -> Counters:
        found = source.table.toArrow()  # as many rows as the caller has made sure of
        keys = list(zip(*[found[c].to_pylist() for c in source.by], strict=True)) if source.by else [()] * found.num_rows
        tracks: dict[tuple, int] = {}
        finest: dict[tuple, list[int]] = {}
        for key in dict.fromkeys(keys):
            named = [(i, *(k if c in s else None for k, c in zip(key, source.by, strict=True))) for i, s in enumerate(sets)]
            finest[key] = [tracks.setdefault(t, len(tracks)) for t in named]
        track = np.array([finest[k] for k in keys], np.int64).reshape(len(keys), len(sets)).T.ravel()
        columns = {c: np.tile(np.asarray(found[c].to_numpy(), float if c == "_cubes" else None), len(sets)) for c in ("_rows", "_low", "_high", "_mean", "_squares", "_cubes")}
        known = np.tile(found["_cell"].is_valid().to_numpy(), len(sets))
        size = len(tracks)

        def total(values: np.ndarray, where: np.ndarray = known) -> np.ndarray:
            return np.bincount(track[where], values[where], size)

        with np.errstate(invalid="ignore", divide="ignore"):
            n, mean = columns["_rows"].astype(float), columns["_mean"]
            middle = total(n * mean) / total(n)
            apart = mean - middle[track]
            moments = {
                "n": np.bincount(track[known], columns["_rows"][known], size).astype(np.int64),
                "missing": total(n, ~known).astype(np.int64),
                "mean": middle,
                "m2": total(columns["_squares"] + n * apart**2),
                "m3": total(columns["_cubes"] + 3 * apart * columns["_squares"] + n * apart**3),
            }
        # A coarser group's cell is made of those of the finer ones.
        cell = np.tile(found["_cell"].fill_null(0).to_numpy(), len(sets))[known]
        order = np.lexsort((cell, track[known]))
        own, cell = track[known][order], cell[order]
        at = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (cell[1:] != cell[:-1]))) if len(own) else np.zeros(0, np.int64)
        low, high, rows = (columns[c][known][order] for c in ("_low", "_high", "_rows"))
        merged = (f.reduceat(c, at) if len(at) else c for f, c in ((np.minimum, low), (np.maximum, high), (np.add, rows.astype(np.int64))))
        return cls(source.by, source.table.select(*source.by).schema, list(tracks), finest, moments, own[at], *merged)

    def ranks(self, indices: Sequence[Index]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, index) arrays: the number of the cell that holds a rank, its rows before, and whether there is one."""
        ends = np.cumsum(self.rows)
        n = self.moments["n"]
        start = np.cumsum(n) - n
        at = np.array([index(n, np) for index in indices], float).reshape(len(indices), len(n)).T
        inside = (at >= 0) & (at < n[:, None])
        cell = np.searchsorted(ends, np.where(inside, start[:, None] + at, 0), side="right")
        cell = np.minimum(cell, max(0, len(self.rows) - 1))
        before = (ends - self.rows)[cell] - start[:, None] if len(self.rows) else np.zeros_like(cell)
        return cell, before, inside

    def split(self, df: DataFrame, value: str, cells: np.ndarray, task_values: int) -> Counters:
        """One pass over the rows in some open cells, which are given up for finer ones."""
        left, v = int(self.rows[cells].sum()), F.col("_v")
        of_track: dict[int, list[tuple[int, float, float]]] = {}
        for i in cells:
            of_track.setdefault(int(self.track[i]), []).append((int(i), float(self.low[i]), float(self.high[i])))
        lookup = [(*key, own) for key, tracks in self.finest.items() if (own := [c for t in tracks for c in of_track.get(t, [])])]
        kinds = StructType([*self.kinds.fields, *StructType.fromDDL("_cells array<struct<cell:int,low:double,high:double>>").fields])
        rows = df.select(*self.by, number(value).alias("_v")).where("_v is not null")
        if self.by:
            named = [f"_key_{c}" for c in self.by]
            wanted = df.sparkSession.createDataFrame(lookup, kinds).toDF(*named, "_cells")
            rows = rows.join(F.broadcast(wanted), null_safe(rows, wanted, list(zip(self.by, named, strict=True))))
        else:
            own = [F.struct(F.lit(c).alias("cell"), F.lit(a).alias("low"), F.lit(b).alias("high")) for c, a, b in lookup[0][0]]
            rows = rows.withColumn("_cells", F.array(*own))
        inside = rows.select(F.explode(F.filter("_cells", lambda c: (v >= c["low"]) & (v <= c["high"]))).alias("_c"), "_v")
        key = v if left <= task_values else step(v, F.col("_c.low"), F.col("_c.high"), max(2, STEPS // len(cells))).cast("double")
        counted = inside.select(F.col("_c.cell").alias("_cell"), key.alias("_key"), "_v").groupBy("_cell", "_key")
        found = counted.agg(F.count(F.lit(1)).alias("_rows"), F.min("_v").alias("_low"), F.max("_v").alias("_high")).toArrow()
        keep = np.ones(len(self.rows), bool)
        keep[cells] = False
        fresh = [self.track[found["_cell"].to_numpy()], *(found[c].to_numpy() for c in ("_low", "_high", "_rows"))]
        old = (self.track, self.low, self.high, self.rows)
        both = [np.concatenate([a[keep], b]) for a, b in zip(old, fresh, strict=True)]
        order = np.lexsort((both[1], both[0]))
        return Counters(self.by, self.kinds, self.tracks, self.finest, self.moments, *(c[order] for c in both))

    def settled(self, df: DataFrame, value: str, indices: Sequence[Index], task_values: int) -> Lookup:
        """The statistics of all groups, once every rank has come down to a value."""
        ends = self.ends()
        now = self
        while True:
            cell, before, inside = now.ranks(indices)
            unsettled = inside & (now.low[cell] < now.high[cell]) if len(now.rows) else inside
            if not unsettled.any():
                break
            now = now.split(df, value, np.unique(cell[unsettled]), task_values)
        rows = []
        for t, track in enumerate(self.tracks):
            picks = [(float(now.low[c]), float(now.high[c]), int(b), int(now.rows[c])) if i else None for c, b, i in zip(cell[t], before[t], inside[t], strict=True)]
            moments = [self.moments[name][t].item() for name in ("n", "missing", "mean", "m2", "m3")]
            moments[2:] = [m if moments[0] and m == m else None for m in moments[2:]]
            rows.append((*track, *moments, *ends[t], *picks))
        ranks = "".join(f", _r{i} {RANK}" for i in range(len(indices)))
        stats = StructType.fromDDL(f"n long, missing long, mean double, m2 double, m3 double, low double, high double{ranks}")
        kinds = StructType([*StructType.fromDDL("_set int").fields, *self.kinds.fields, *stats.fields])
        table = df.sparkSession.createDataFrame(rows, kinds)
        return Lookup(table, [Row(**dict(zip(kinds.names, r, strict=True))) for r in rows])

    def ends(self) -> list[tuple[float | None, float | None]]:
        """Smallest and largest value of each group."""
        found: list[tuple[float | None, float | None]] = [(None, None)] * len(self.tracks)
        tracks, first, count = np.unique(self.track, return_index=True, return_counts=True)
        for t, a, n in zip(tracks.tolist(), first.tolist(), count.tolist(), strict=True):
            found[t] = (self.low[a].item(), self.high[a + n - 1].item())
        return found


def group_statistics(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    indices: Sequence[Index],
    sets: Sequence[Sequence[str]] | None = None,
    *,
    few_groups: bool = False,
    cubes: bool = False,
    task_values: int = TASK_VALUES,
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> Lookup:
    """Per group of every grouping in ``sets`` (all of ``by`` if left out): ``_set``, ``by``, the moments and ``_r0``, ``_r1``, …

    A rank is the struct (low, high, less, rows) of the value at its 0-based index: low and high are that value, less and rows
    count smaller and equal ones; an index outside the values gives null. Missing keys are a group; a group
    without values has n 0. NaN counts as missing. ``cubes`` asks for m3. ``few_groups`` says that the groups are a handful
    by their nature, so that their counters need not be written to know their number.
    """
    by, sets = list(by), [list(by)] if sets is None else [list(s) for s in sets]
    if clash := {*by} & {*MOMENTS}:
        raise ValueError(f"rename the grouping columns {sorted(clash)}: results have columns of these names")
    if few_groups:
        return Counters.of(Digest(_counted(df, value, by, cubes), tuple(by), 0), sets).settled(df, value, indices, task_values)
    source = digest(df, value, by, cubes)
    if source.rows * len(sets) <= COUNTERS:
        few = Counters.of(source, sets)
        if len(few.tracks) <= max_broadcast_rows:
            return few.settled(df, value, indices, task_values)
    state = held(_first_state(source, sets, indices), ["_set", *by], 0)
    while most := _rows_left(state, len(indices)):
        state = held(_next_state(df, value, state, by, sets, indices, most, task_values, max_broadcast_rows), ["_set", *by], 0)
    return state


def quantile_indices(probabilities: Sequence[float]) -> list[Index]:
    """The two neighbours that linear interpolation takes each quantile from."""
    found: list[Index] = []
    for p in probabilities:
        found += [lambda n, m, p=float(p): m.floor((n - 1) * p), lambda n, m, p=float(p): m.ceil((n - 1) * p)]
    return found


def interpolated(p: float, first: Column, last: Column, n: Column) -> Column:
    at = (n - 1) * F.lit(float(p))
    part = at - F.floor(at)
    return (1 - part) * first + part * last


def quantiles(state: DataFrame, probabilities: Sequence[float]) -> Column:
    """Array of the quantiles from the ranks of ``quantile_indices``."""
    return F.array(*[interpolated(p, F.col(f"_r{2 * i}.low"), F.col(f"_r{2 * i + 1}.low"), F.col("n")) for i, p in enumerate(probabilities)])


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    *,
    few_groups: bool = False,
    task_values: int = TASK_VALUES,
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Per group: its moments (``MOMENTS``) and ``q``, the linear-interpolation quantiles.

    Groups without a value are kept, with ``n`` 0 and null quantiles. Without ``by`` there is one row (and no m3).
    """
    by = list(by)
    if by:
        limits = {"few_groups": few_groups, "task_values": task_values, "max_broadcast_rows": max_broadcast_rows}
        state = group_statistics(df, value, by, quantile_indices(probabilities), cubes=True, **limits).df
        return state.select(*by, *MOMENTS, quantiles(state, probabilities).alias("q"))
    seen = profile(df, value)
    q, low, high = [None] * len(probabilities), None, None
    if seen.n:
        low, high = float(seen.cells.low[0]), float(seen.cells.high[-1])
        ask = lambda cells: [cells.quantile(p).low for p in probabilities]
        q, _ = settled(seen.cells, df, value, ask, task_values)
    kinds = "n long, missing long, mean double, m2 double, low double, high double, q array<double>"
    row = (seen.n, seen.missing, seen.mean, seen.squares, low, high, [None if x is None else float(x) for x in q])
    return df.sparkSession.createDataFrame([row], kinds)


def order_statistics(
    df: DataFrame,
    value: str,
    ranks: dict[str, Sequence[Index]],
    by: Sequence[str] = (),
    *,
    few_groups: bool = False,
    task_values: int = TASK_VALUES,
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Per group with a value: count ``n`` and, per name, an array of struct(value, less, ties).

    ``less`` is the number of strictly smaller values and ``ties`` the number of equal
    ones. An index outside the values gives a null struct.
    """
    keys = list(by) or ["_all"]
    data = df if by else df.withColumn("_all", F.lit(0))
    indices = [index for rank in ranks.values() for index in rank]
    limits = {"few_groups": few_groups or not by, "task_values": task_values, "max_broadcast_rows": max_broadcast_rows}
    state = group_statistics(data, value, keys, indices, **limits).df
    hits = [F.when(F.col(f"_r{i}").isNotNull(), F.struct(F.col(f"_r{i}.low").alias("value"), F.col(f"_r{i}.less").alias("less"), F.col(f"_r{i}.rows").alias("ties"))) for i in range(len(indices))]
    columns, at = [], 0
    for name, rank in ranks.items():
        columns.append(F.array(*hits[at : at + len(rank)]).alias(name))
        at += len(rank)
    return state.where(F.col("n") > 0).select(*by, "n", *columns)
