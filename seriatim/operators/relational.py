"""Joins, aggregations and set operations with the exact semantics that the analyses rely on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriatim.sources.tables import require


class GateFailed(AssertionError):
    """A reproduction gate or data check did not hold."""


def single_match(df: DataFrame, key: str, partner: str) -> DataFrame:
    """(key, partner) of the keys that have exactly one distinct partner; keys with several are dropped, not resolved."""
    return df.select(key, partner).dropna().groupBy(key).agg(F.min(partner).alias(partner), F.max(partner).alias("_z")).where(F.col(partner) == F.col("_z")).drop("_z")


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """The first row of each key in a total order, as one minimum of (order, row): no sort, no window."""
    best = F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *[F.col(c) for c in keep if c not in key]))
    return df.groupBy(*key).agg(best.alias("_b")).select(*key, *[F.col(f"_b.{c}").alias(c) for c in keep if c not in key])


def semi(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def dropped(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """How an existence gate splits rows: kept, dropped."""
    flag = df.join(keys.select(on if isinstance(on, str) else F.struct(*on)).distinct().withColumn("_in", F.lit(1)) if isinstance(on, str) else keys.select(*on).distinct().withColumn("_in", F.lit(1)), on, "left")
    return flag.agg(F.count("_in").alias("kept"), (F.count("*") - F.count("_in")).alias("dropped"))


def within(events: DataFrame, windows: DataFrame, key: str, time: str, start: str, end: str) -> DataFrame:
    """Events inside an inclusive time window of their key; an event may fall into several windows."""
    return events.join(windows, key).where(F.col(time).between(F.col(start), F.col(end)))


def overlaps(intervals: DataFrame, windows: DataFrame, key: str, start: str, end: str, t0: str, t1: str) -> DataFrame:
    """Windows with a flag whether any interval of the key starts inside, ends inside, or covers them.

    The three clauses are kept as they are: with reversed intervals they differ from the two-sided test.
    """
    s, e, a, b = (F.col(c) for c in (start, end, t0, t1))
    hit = (s.between(a, b)) | (e.between(a, b)) | ((s <= a) & (e >= b))
    hits = intervals.select(key, start, end).join(windows, key).where(hit).select(key).distinct().withColumn("_hit", F.lit(1))
    return windows.join(hits, key, "left").withColumn("flag", F.coalesce("_hit", F.lit(0))).drop("_hit")


def extremes(df: DataFrame, entity: Sequence[str], measure: str, value: str, measures: Sequence[str]) -> DataFrame:
    """Wide minimum and maximum of each measure: <measure>_min, <measure>_max."""
    own = lambda m: F.when(F.col(measure) == m, F.col(value))
    return df.groupBy(*entity).agg(*[f(own(m)).alias(f"{m}_{n}") for m in measures for n, f in (("min", F.min), ("max", F.max))])


def slots(df: DataFrame, key: Sequence[str], value: str, order: Sequence[Column], most: int, prefix: str) -> DataFrame:
    """The first `most` values of a key in order, as columns <prefix>1.. : a bounded top-k, then a pivot by maximum."""
    from pyspark.sql import Window

    r = df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= most)
    return r.groupBy(*key).agg(*[F.max(F.when(F.col("_n") == i, F.col(value))).alias(f"{prefix}{i}") for i in range(1, most + 1)])


def attrition(steps: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Counts at each step of an inclusion chain, in order: step, name, n."""
    out = None
    for i, (name, df) in enumerate(steps):
        row = df.agg(F.count("*").alias("n")).select(F.lit(i).alias("step"), F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one table has and the other has not, counted with repeats, in both directions."""
    only_a, only_b = a.exceptAll(b.select(*a.columns)), b.select(*a.columns).exceptAll(a)
    return only_a.agg(F.count("*").alias("only_left")).crossJoin(only_b.agg(F.count("*").alias("only_right")))  # one row each


def gate(a: DataFrame, b: DataFrame, key: Sequence[str], value: str, tolerance: float = 5e-4) -> float:
    """The largest difference of two stored summaries; GateFailed beyond the tolerance or where a key is missing."""
    both = a.select(*key, F.col(value).alias("_a")).join(b.select(*key, F.col(value).alias("_b")), list(key), "full_outer")
    got = both.agg(F.max(F.abs(F.col("_a") - F.col("_b"))).alias("worst"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("missing")).first()
    if got["missing"] or (got["worst"] or 0.0) > tolerance:
        raise GateFailed(f"largest difference {got['worst']}, {got['missing']} keys on one side only; tolerance {tolerance}")
    return got["worst"] or 0.0


def resolve(items: DataFrame, patterns: dict[str, str], fluids: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Items whose label matches each key's pattern, without regard to case: key, itemid, label.

    fluids narrows a key to items whose fluid and category contain two words. Null labels are empty.
    """
    require(items, ["itemid", "label"])
    out = None
    for key, pattern in patterns.items():
        hit = items.where(F.coalesce("label", F.lit("")).rlike(f"(?i){pattern}"))
        if fluids and key in fluids and {"fluid", "category"} <= set(items.columns):
            fluid, category = fluids[key]
            hit = hit.where(F.contains(F.lower(F.coalesce("fluid", F.lit(""))), F.lit(fluid)) & F.contains(F.lower(F.coalesce("category", F.lit(""))), F.lit(category)))
        row = hit.select(F.lit(key).alias("key"), "itemid", "label")
        out = row if out is None else out.unionByName(row)
    return out


def verdict(value: float | None, bands: Sequence[tuple[float, str]], otherwise: str) -> str:
    """The first band whose upper bound is not reached; a decision rule as data."""
    if value is None:
        return "not available"
    return next((name for bound, name in bands if value < bound), otherwise)
