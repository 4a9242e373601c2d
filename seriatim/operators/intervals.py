"""Continuous periods and gaps of overlapping intervals, by dyadic blocks.

An interval [start, end] of an entity becomes the integer cells 2*start .. 2*end (microseconds,
doubled), so that intervals that only touch share a cell and intervals that do not touch leave
at least one cell free between them; an empty interval is one cell. Time is cut into slots of
2**SLOT cells, which spreads one entity's rows over many tasks. Inside a slot every interval is
decomposed into canonical dyadic blocks; blocks covered by an ancestor are removed, sibling
pairs merge upward, and adjacent blocks coalesce into runs. Runs meet across slots through one
row per entity and slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriatim.session import partitions
from seriatim.sources.tables import micros, require, stamp

#: Cells of a slot, as a power of two: 2**40 half microseconds are about 6.4 days.
SLOT = 40


def blocks(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical dyadic blocks (group, level, index) of half-open cell ranges within [0, 2**top)."""
    out, lo, hi = [], lo.copy(), hi.copy()
    for level in range(top + 1):
        at = (lo < hi) & (lo & 1 == 1)
        out.append((group[at], np.full(at.sum(), level), lo[at]))
        lo = lo + at
        at = (lo < hi) & (hi & 1 == 1)
        hi = hi - at
        out.append((group[at], np.full(at.sum(), level), hi[at]))
        lo, hi = lo >> 1, hi >> 1
    return tuple(np.concatenate(x) for x in zip(*out))


def uncovered(group: np.ndarray, level: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The blocks without any ancestor in their group, each once.

    Dyadic blocks nest or are disjoint, so in order of start (larger first) a block has an
    ancestor exactly if it starts before the furthest end seen so far in its group.
    """
    if not len(group):
        return group, level, index
    start, end = index << level, (index + 1) << level
    order = np.lexsort((-level, start, group))
    group, level, index, start, end = (x[order] for x in (group, level, index, start, end))
    rank = np.cumsum(np.r_[False, group[1:] != group[:-1]])
    base = rank * (np.int64(end.max()) + 1)
    seen = np.r_[np.int64(-1), np.maximum.accumulate(base + end)[:-1]]
    keep = base + start >= seen
    return group[keep], level[keep], index[keep]


def merged(group: np.ndarray, level: np.ndarray, index: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sibling pairs replaced by their parent, from the smallest blocks upward."""
    done, carried = [], (group[:0], index[:0])
    for at in range(top + 1):
        own = level == at
        g, i = np.r_[group[own], carried[0]], np.r_[index[own], carried[1]]
        order = np.lexsort((i, g))
        g, i = g[order], i[order]
        first = np.r_[(g[1:] == g[:-1]) & (i[1:] == i[:-1] + 1) & (i[:-1] & 1 == 0), False] if len(g) else np.zeros(0, bool)
        both = first | np.r_[False, first[:-1]] if len(g) else first
        carried = (g[first], i[first] >> 1)
        done.append((g[~both], np.full((~both).sum(), at), i[~both]))
    return tuple(np.concatenate(x) for x in zip(*done))


def runs(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, top: int = SLOT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of covered cells per group, ordered: (group, first cell, cell after the last)."""
    g, level, i = merged(*uncovered(*blocks(group, lo, hi, top)), top)
    start, end = i << level, (i + 1) << level
    order = np.lexsort((start, g))
    g, start, end = g[order], start[order], end[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (start[1:] > end[:-1])] if len(g) else np.zeros(0, bool)
    last = np.r_[new[1:], True] if len(g) else new
    return g[new], start[new], end[last]


def _slot_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (entity columns, slot, lo, hi) -> runs; a slot that a batch cuts waits for the next batch."""
    held: pa.Table | None = None

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        keys = t.select(t.column_names[:-2])
        edge = _edges(keys)
        group = np.cumsum(edge) - 1
        g, lo, hi = runs(group.astype(np.int64), t["lo"].to_numpy().astype(np.int64), t["hi"].to_numpy().astype(np.int64))
        at = keys.take(pa.array(np.flatnonzero(edge)[g]))
        base = at["slot"].to_numpy().astype(np.int64) << SLOT
        first = np.r_[True, g[1:] != g[:-1]]
        before = np.where(first, 0, np.r_[np.int64(0), (base + hi)[:-1]])
        at = at.append_column("lo", pa.array(base + lo)).append_column("hi", pa.array(base + hi))
        at = at.append_column("prev_hi", pa.array(before, mask=first)).append_column("last", pa.array(np.r_[first[1:], True]))
        yield from at.combine_chunks().to_batches()

    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None else t
        edge = np.flatnonzero(_edges(t.select(t.column_names[:-2])))
        if not len(edge):
            continue
        held = t.slice(edge[-1])
        yield from done(t.slice(0, edge[-1]))
    if held is not None:
        yield from done(held)


def _edges(keys: pa.Table) -> np.ndarray:
    """True where a row's keys differ from the row before."""
    n = keys.num_rows
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for c in keys.columns:
            code = c.combine_chunks().dictionary_encode()
            code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
    return new


def covered(df: DataFrame, entity: list[str], start: str, end: str) -> DataFrame:
    """Runs of covered cells: entity columns, slot, lo, hi, prev_hi (null for the first run of a slot), last.

    Rows with a null in any used column are left out; reversed intervals are turned round.
    """
    require(df, [*entity, start, end])
    used = df.select(*entity, micros(start).alias("_s"), micros(end).alias("_e")).dropna()
    cells = used.select(*entity, (F.least("_s", "_e") * 2).alias("lo"), (F.greatest("_s", "_e") * 2 + 1).alias("hi"))
    slots = cells.withColumn("slot", F.explode(F.sequence(F.shiftright("lo", SLOT), F.shiftright(F.col("hi") - 1, SLOT))))
    base, width = F.shiftleft("slot", SLOT), F.lit(1 << SLOT)
    cut = slots.select(*entity, "slot", F.greatest(F.col("lo") - base, F.lit(0)).alias("lo"), F.least(F.col("hi") - base, width).alias("hi"))
    once = cut.groupBy(*entity, "slot", "lo").agg(F.max("hi").alias("hi"))
    ordered = once.repartition(partitions(df), *entity, "slot").sortWithinPartitions(*entity, "slot", "lo")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields[:-2])
    return ordered.mapInArrow(_slot_runs, f"{fields}, lo bigint, hi bigint, prev_hi bigint, last boolean")


def gaps(df: DataFrame, entity: list[str], start: str = "starttime", end: str = "endtime") -> DataFrame:
    """The time between one continuous period and the next of the same entity.

    Result: entity columns, gap_from, gap_to (microseconds). Rows with a null in a used column
    are left out; reversed intervals are turned round; empty intervals count; intervals that
    overlap or touch are one period. An empty table, or an entity with one period, has no gap.
    Other columns are ignored.
    """
    r = covered(df, entity, start, end)
    inner = r.where("prev_hi is not null").select(*entity, F.col("prev_hi").alias("hi"), "lo")
    ends = r.groupBy(*entity, "slot").agg(F.min("lo").alias("lo"), F.max("hi").alias("_hi"))
    w = Window.partitionBy(*entity).orderBy("slot")
    across = ends.withColumn("hi", F.lag("_hi").over(w)).where("hi < lo").select(*entity, "hi", "lo")
    return inner.unionByName(across).select(*entity, F.shiftright(F.col("hi") - 1, 1).alias("gap_from"), F.shiftright("lo", 1).alias("gap_to"))


def periods(df: DataFrame, entity: list[str], start: str = "starttime", end: str = "endtime") -> DataFrame:
    """Continuous periods: entity columns, period_from, period_to (microseconds); rules as in gaps()."""
    r = covered(df, entity, start, end).withColumn("edge", F.col("prev_hi").isNull() | F.col("last"))
    whole = r.where("not edge").select(*entity, "lo", "hi")
    w = Window.partitionBy(*entity).orderBy("lo")
    joined = (
        r.where("edge")
        .withColumn("new", F.when(F.lag("hi").over(w) >= F.col("lo"), 0).otherwise(1))
        .withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*entity, "island")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .drop("island")
    )
    return whole.unionByName(joined).select(*entity, F.shiftright("lo", 1).alias("period_from"), F.shiftright(F.col("hi") - 1, 1).alias("period_to"))


def ventilation(df: DataFrame) -> DataFrame:
    """The ventilation table with its status trimmed and in lower case."""
    return df.withColumn("ventilation_status", F.lower(F.regexp_replace("ventilation_status", r"^\s+|\s+$", "")))


def ventilation_gaps(df: DataFrame) -> DataFrame:
    g = gaps(ventilation(df), ["stay_id", "ventilation_status"])
    return g.select("stay_id", "ventilation_status", stamp(F.col("gap_from")).alias("gap_from"), stamp(F.col("gap_to")).alias("gap_to"))


def ventilation_periods(df: DataFrame) -> DataFrame:
    p = periods(ventilation(df), ["stay_id", "ventilation_status"])
    return p.select("stay_id", "ventilation_status", stamp(F.col("period_from")).alias("period_from"), stamp(F.col("period_to")).alias("period_to"))
