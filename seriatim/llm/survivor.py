"""One surviving record of each group of duplicate records, field by field.

A single aggregation takes, for each attribute, the maximum of a composite struct
(non-null, source priority, timestamp, row, value); the best whole row is the maximum of one
such struct too. Maxima combine on the map side, so a group of any size reaches its task as
one partial row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriatim.sources.tables import require

KEY = ("subject_id", "itemid", "minute")
FIELDS = ("stay_id", "storetime", "value", "valuenum")


def _pick(field: str) -> Column:
    """The value of a field from the most trusted, most recent row that has one."""
    best = F.max(F.struct(F.col(field).isNotNull().alias("has"), F.col("_trust").alias("trust"), F.col("storetime").alias("at"), (-F.col("row_id")).alias("row"), F.col(field).alias("v")))
    return best["v"].alias(field)


def survivors(df: DataFrame) -> DataFrame:
    """The survivors of chartevents rows with the same subject_id, itemid and charttime cut to the minute.

    Result, one row per group: subject_id, itemid, minute, n_copies, first_row_id (smallest
    row_id), kept_row_id (the best row: warning 0 before 1, most non-null fields among stay_id,
    storetime, value and valuenum, latest storetime, smallest row_id), and the record built
    field by field: for each field the non-null value of the row with the lowest warning, then
    the latest storetime, then the smallest row_id; warning is the lowest of the group.
    Rows with a null key belong to no group; a null warning counts as the least trusted; a null
    storetime as the oldest; a field that is null in every copy stays null. Columns beyond those
    used are ignored; an empty table gives an empty result.
    """
    require(df, ["row_id", "subject_id", "itemid", "charttime", "warning", *FIELDS])
    filled = sum((F.col(c).isNotNull().cast("int") for c in FIELDS), F.lit(0))
    rows = df.select("row_id", "subject_id", "itemid", F.date_trunc("minute", "charttime").alias("minute"), "warning", *FIELDS, (-F.coalesce("warning", F.lit(2))).alias("_trust"), filled.alias("_filled"))
    best = F.max(F.struct(F.col("_trust"), F.col("_filled"), F.col("storetime"), (-F.col("row_id")).alias("row")))
    return (
        rows.dropna(subset=list(KEY))
        .groupBy(*KEY)
        .agg(F.count("*").alias("n_copies"), F.min("row_id").alias("first_row_id"), (-best["row"]).alias("kept_row_id"), *(_pick(c) for c in FIELDS), F.min("warning").alias("warning"))
    )


def found(df: DataFrame) -> DataFrame:
    """Of every group of two or more rows, its smallest row_id and the row_id of its best row."""
    return survivors(df).where("n_copies >= 2").select("first_row_id", "kept_row_id")
