"""Global ranks, exact quantiles and mid-ranks without a single-task window.

Rows (or distinct values with their counts) are range-partitioned by the ordering; a partition
adds up on its own, and the totals of the partitions before it, one number each, are its offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriatim.session import cut, partitions


def _placed(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with the number of their range partition; written out, so that it stays the same."""
    return cut(df.repartitionByRange(partitions(df), *order).withColumn("__part", F.spark_partition_id()))


def _offset(placed: DataFrame, amount: Column) -> DataFrame:
    """For each range partition, the total of the partitions before it; one row per partition."""
    sums = placed.groupBy("__part").agg(amount.alias("__sum"))
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sums.select("__part", F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__before")))


def ranked(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """Rows with their position (from 1) in a total order; ties beyond the order columns are arbitrary."""
    p = _placed(df, order)
    k = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return p.withColumn("__k", k).join(_offset(p, F.count("*")), "__part").withColumn(name, F.col("__before") + F.col("__k")).drop("__part", "__k", "__before")


def cumulative(df: DataFrame, value: str, *more: Column, running: Sequence[str] = ()) -> DataFrame:
    """Distinct non-null values with n (rows) and below (rows of smaller values), and more aggregates.

    running names further aggregates that get a below_<name> too.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), *more)
    p = _placed(counts, [value])
    names = {"n": "below", **{c: f"below_{c}" for c in running}}
    w = Window.partitionBy("__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = p.groupBy("__part").agg(*[F.sum(c).alias(f"__s_{c}") for c in names])
    before = F.broadcast(sums.select("__part", *[F.coalesce(F.sum(f"__s_{c}").over(over), F.lit(0)).alias(f"__b_{c}") for c in names]))  # one row per partition
    inside = p.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"__i_{c}") for c in names])
    return inside.join(before, "__part").select(*p.columns, *[(F.col(f"__b_{c}") + F.col(f"__i_{c}")).alias(b) for c, b in names.items()]).drop("__part")


def ranked_within(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """Rows with their position (from 1) inside their group; a group of any size spreads over range partitions.

    The group's first global rank is one number per group, joined back.
    """
    r = cut(ranked(df, [*group, *order], "__r"))
    first = r.groupBy(*group).agg(F.min("__r").alias("__f"))
    return r.join(first, list(group)).withColumn(name, F.col("__r") - F.col("__f") + 1).drop("__r", "__f")


def mid_ranks(df: DataFrame, value: str, name: str = "midrank") -> DataFrame:
    """Rows with the average rank of their value (ties share it); null values have none."""
    c = cumulative(df, value).select(F.col(value), (F.col("below") + (F.col("n") + 1) / 2).alias(name))
    return df.join(c, value, "left")


def quantiles(df: DataFrame, value: str, probabilities: Sequence[float]) -> list[float]:
    """Exact quantiles by linear interpolation between neighbouring order statistics."""
    c = cut(cumulative(df, value))
    total = c.agg(F.sum("n")).first()[0]
    if not total:
        return []
    spots = sorted({int(p * (total - 1)) + k for p in probabilities for k in (0, 1)})
    spots = [s for s in spots if s < total]
    at = F.array(*[F.lit(s).cast("bigint") for s in spots])
    hit = c.withColumn("s", F.explode(F.filter(at, lambda s: (s >= F.col("below")) & (s < F.col("below") + F.col("n")))))
    by = {r["s"]: r[value] for r in hit.select("s", value).collect()}  # two rows per probability
    out = []
    for p in probabilities:
        h = p * (total - 1)
        lo = int(h)
        a, b = by[lo], by.get(lo + 1, by[lo])
        out.append(a + (h - lo) * (b - a))
    return out
