"""Joins of many rows to one row per key, in which no key is bound to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key from which it is split, and most split keys (they are broadcast): with more, the first grows.
HEAVY, MOST = 200_000, 10_000


def spread_join(rows: DataFrame, groups: DataFrame, on: Sequence[str], count: str, how: str = "inner", heavy: int = HEAVY) -> DataFrame:
    """rows joined to groups, which has one row per key and in `count` how many rows the key has.

    A key of more than `heavy` rows is cut into as many shares by a hash of the rows, and its one
    group row is repeated for each share. The split keys are at most MOST and known to the driver;
    where there are none the join is a plain one. groups is read twice, so it should be cut before.
    how: inner, left, left_semi or left_anti; null keys match nothing.
    """
    on = list(on)
    while True:
        hot = groups.where(F.col(count) > heavy).select(*on, F.ceil(F.col(count) / heavy).cast("int").alias("_n")).limit(MOST + 1).collect()
        if len(hot) <= MOST:
            break
        heavy *= 10
    if not hot:
        return rows.join(groups, on, how)
    known = F.broadcast(rows.sparkSession.createDataFrame(hot, groups.select(*on, F.lit(0).cast("int").alias("_n")).schema))
    of = F.xxhash64(*[F.col(c) for c in rows.columns if c not in on]) if len(rows.columns) > len(on) else F.spark_partition_id()
    cut = rows.join(known, on, "left").withColumn("_share", F.when(F.col("_n").isNull(), 0).otherwise(F.pmod(of, F.col("_n")).cast("int"))).drop("_n")
    copies = groups.join(known, on, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")
    return cut.join(copies, [*on, "_share"], how).drop("_share")
