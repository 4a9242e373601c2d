"""One quantity in one unit: records of several tables converted to the common unit.

The item dictionaries are fixed tables, so they are the broadcast side; their size is checked.
Rows of other items are dropped before any Python runs. The parser is an Arrow-batched UDF that
keeps parsed texts per worker, as measurements repeat.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriatim.functions import units
from seriatim.sources.tables import require

#: Most rows of a dictionary that is still broadcast.
DICTIONARY = 10_000

_RESULT = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in ("number", "scale", "offset")]
    + [T.StructField("dims", T.ArrayType(T.IntegerType())), T.StructField("common_value", T.DoubleType()), T.StructField("same", T.BooleanType())]
)


@F.pandas_udf(_RESULT)
def _resolved(quantity: pd.Series, text: pd.Series, num: pd.Series, uom: pd.Series, unitname: pd.Series, label: pd.Series, common: pd.Series, low: pd.Series, high: pd.Series, body: pd.Series) -> pd.DataFrame:
    out = []
    plain = lambda s: s.astype(object).where(s.notna(), None)
    for q, t, x, m, un, la, c, lo, hi, b in zip(*map(plain, (quantity, text, num, uom, unitname, label, common, low, high, body))):
        got = units.resolve(q, t, x, m, units.own(un, la), c, lo, hi, b)
        if got is None:
            out.append((None, None, None, None, None, None))
        else:
            n, u, y = got
            out.append((n, u.scale, u.offset, list(u.dims), y, units.same(u, units.unit(c))))
    return pd.DataFrame(out, columns=["number", "scale", "offset", "dims", "common_value", "same"])


def small(df: DataFrame, most: int = DICTIONARY) -> DataFrame:
    """A broadcast hint where the table really has few rows; beyond that Spark chooses the join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def records(labevents: DataFrame, chartevents: DataFrame, inputevents: DataFrame) -> DataFrame:
    """The three sources in one shape: src, rec_id, itemid, text, num, uom, body."""
    require(labevents, ["labevent_id", "itemid", "value", "valuenum", "valueuom"])
    require(chartevents, ["row_id", "itemid", "value", "valuenum"])
    require(inputevents, ["row_id", "itemid", "rate", "rateuom", "patientweight"])
    none = F.lit(None).cast("string")
    return (
        labevents.select(F.lit("labevents").alias("src"), F.col("labevent_id").alias("rec_id"), "itemid", F.col("value").alias("text"), F.col("valuenum").alias("num"), F.col("valueuom").alias("uom"), F.lit(None).cast("double").alias("body"))
        .unionByName(chartevents.where("value is not null").select(F.lit("chartevents").alias("src"), F.col("row_id").alias("rec_id"), "itemid", F.col("value").alias("text"), F.col("valuenum").alias("num"), none.alias("uom"), F.lit(None).cast("double").alias("body")))
        .unionByName(inputevents.where("rate is not null").select(F.lit("inputevents").alias("src"), F.col("row_id").alias("rec_id"), "itemid", none.alias("text"), F.col("rate").alias("num"), F.col("rateuom").alias("uom"), F.col("patientweight").alias("body")))
    )


def unified(rows: DataFrame, quantities: DataFrame, items: DataFrame) -> DataFrame:
    """Every record with a number, in the common unit of its quantity.

    Result: src, rec_id, quantity, number, scale, offset, dims (exponents of mass, length, time,
    amount, temperature, units), common_value, common_unit, same (its unit is the common unit).
    Records of other items, without a number, with a null id or itemid are left out.
    common_value is null where a body weight is needed and absent. Repeated records stay.
    """
    q = require(quantities, ["quantity", "itemid", "common_unit", "low", "high"]).select("quantity", "itemid", "common_unit", "low", "high")
    own = require(items, ["itemid", "label", "unitname"]).select("itemid", "label", "unitname").dropDuplicates(["itemid"])
    known = small(q.join(own, "itemid", "left").dropDuplicates(["itemid"]))
    r = rows.dropna(subset=["rec_id", "itemid"]).join(known, "itemid")
    r = r.withColumn("r", _resolved("quantity", "text", "num", "uom", "unitname", "label", "common_unit", "low", "high", "body"))
    return r.where("r.number is not null").select("src", "rec_id", "quantity", "r.number", "r.scale", "r.offset", "r.dims", "r.common_value", "common_unit", "r.same")


def foreign(rows: DataFrame, quantities: DataFrame, items: DataFrame) -> DataFrame:
    """The records whose unit is not the common unit of their quantity: src, rec_id."""
    return unified(rows, quantities, items).where("not same").select("src", "rec_id")
