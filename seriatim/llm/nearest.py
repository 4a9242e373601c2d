"""Pairs of records of two tables by nearest time, within a tolerance.

Rows are hash-partitioned into Arrow groups by entity and time slot; right rows within the
tolerance of a slot's border are copied into the neighbouring slot. Inside a group DuckDB runs
a backward and a forward ASOF join, and the nearer candidate inside the tolerance wins. Time
slots spread one entity's rows over many groups, and right rows with equal entity and time are
cut to their smallest id before the shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriatim.session import partitions
from seriatim.sources.tables import micros, require

#: Width of a time slot in microseconds (12 hours), and rows of a group to aim at.
SLOT = 12 * 3_600_000_000
GROUP_ROWS = 100_000

PAIR = """
with back as (select l.id, l.t, r.id as rid, r.t as rt from l asof left join r on l.e = r.e and l.s = r.s and l.t >= r.t),
     ahead as (select l.id, r.id as rid, r.t as rt from l asof left join r on l.e = r.e and l.s = r.s and l.t <= r.t)
select b.id as left_id,
       case when a.rt is null or (b.rt is not null and b.t - b.rt <= a.rt - b.t) then b.rid else a.rid end as right_id,
       case when a.rt is null or (b.rt is not null and b.t - b.rt <= a.rt - b.t) then b.t - b.rt else a.rt - b.t end as apart
from back b join ahead a on a.id = b.id
"""


def _asof(tolerance: int):
    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        import duckdb

        with duckdb.connect(config={"threads": 1}) as con:
            con.register("l", left)
            con.register("r", right)
            got = con.execute(f"select left_id, right_id from ({PAIR}) where apart <= {tolerance}").to_arrow_table()
        return got.cast(pa.schema([("left_id", pa.int64()), ("right_id", pa.int64())]))

    return of


def nearest(left: DataFrame, right: DataFrame, entity: str, left_id: str, right_id: str, left_time: str, right_time: str, tolerance: int) -> DataFrame:
    """For each left row, the right row of the same entity that is nearest in time: left_id, right_id.

    tolerance is in microseconds, both ends included. At equal distance the earlier right time
    wins, then the smaller right id. Left and right rows without entity or time are left out, a
    left row without a partner too; left ids are unique. Other columns are ignored.
    """
    require(left, [entity, left_id, left_time])
    require(right, [entity, right_id, right_time])
    a = left.select(F.col(entity).alias("e"), F.col(left_id).cast("bigint").alias("id"), micros(left_time).alias("t")).dropna()
    b = right.select(F.col(entity).alias("e"), F.col(right_id).cast("bigint").alias("id"), micros(right_time).alias("t")).dropna()
    slot = F.floor(F.col("t") / SLOT).cast("bigint")
    a = a.withColumn("s", slot)
    b = b.groupBy("e", "t").agg(F.min("id").alias("id"))
    b = b.withColumn("s", F.explode(F.sequence(F.floor((F.col("t") - tolerance) / SLOT).cast("bigint"), F.floor((F.col("t") + tolerance) / SLOT).cast("bigint"))))
    n = a.select(F.lit(0).alias("x")).unionAll(b.select(F.lit(0).alias("x"))).count()  # both sides: a group holds rows of either
    groups = max(partitions(left), n // GROUP_ROWS)
    key = F.pmod(F.xxhash64("e", "s"), F.lit(groups)).alias("g")
    a, b = a.select(key, "e", "s", "t", "id"), b.select(key, "e", "s", "t", "id")
    return a.groupBy("g").cogroup(b.groupBy("g")).applyInArrow(_asof(tolerance), "left_id bigint, right_id bigint").select(F.col("left_id").alias(left_id), F.col("right_id").alias(right_id))


def oxygen(labs: DataFrame, chart: DataFrame, hours: int = 2) -> DataFrame:
    """Arterial pO2 (labevents 50821) paired with the nearest inspired oxygen fraction (chartevents 223835)."""
    return nearest(labs.where("itemid = 50821"), chart.where("itemid = 223835"), "subject_id", "labevent_id", "row_id", "charttime", "charttime", hours * 3_600_000_000)
