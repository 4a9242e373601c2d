"""Nearest-time pairs: ties, tolerance, slot borders, nulls."""

from datetime import datetime, timedelta

from seriatim.llm import nearest

T0 = datetime(2150, 1, 1)


def _labs(spark, rows):
    return spark.createDataFrame([(i, s, 50821, t, "g") for i, s, t in rows], "labevent_id bigint, subject_id bigint, itemid int, charttime timestamp_ntz, g string")


def _chart(spark, rows):
    return spark.createDataFrame([(i, s, 223835, t, "e") for i, s, t in rows], "row_id bigint, subject_id bigint, itemid int, charttime timestamp_ntz, e string")


def _m(x):
    return T0 + timedelta(minutes=x)


def test_pairs(spark):
    labs = [(1, 1, _m(0)), (2, 1, _m(719)), (3, 1, _m(1000)), (4, 2, _m(0)), (5, None, _m(0)), (6, 1, None), (7, 1, _m(5000)), (8, 3, _m(0))]
    chart = [(10, 1, _m(30)), (11, 1, _m(-30)), (12, 1, _m(721)), (13, 1, _m(721)), (14, 1, _m(880)), (15, 1, _m(1121)), (16, 2, _m(120)), (17, 2, _m(-121)), (18, None, _m(0)), (19, 1, None), (20, 1, _m(5120) + timedelta(seconds=1)), (21, 3, _m(0)), (20 - 13, 3, _m(0))]
    got = {tuple(r) for r in nearest.oxygen(_labs(spark, labs), _chart(spark, chart)).collect()}
    assert got == {(1, 11), (2, 12), (3, 14), (4, 16), (8, 7)}


def test_other_items_and_empty(spark):
    labs, chart = _labs(spark, [(1, 1, _m(0))]), _chart(spark, [(2, 1, _m(0))])
    from pyspark.sql import functions as F

    assert nearest.oxygen(labs.withColumn("itemid", F.lit(1)), chart).count() == 0
    assert nearest.oxygen(labs, chart.limit(0)).count() == 0
    assert nearest.oxygen(labs.limit(0), chart).count() == 0


def test_brute_force(spark):
    import random

    rng = random.Random(5)
    labs = [(i, rng.randint(1, 3), _m(rng.randint(0, 20000))) for i in range(300)]
    chart = [(1000 + i, rng.randint(1, 3), _m(rng.randint(0, 20000))) for i in range(400)]
    want = set()
    for i, s, t in labs:
        near = [(abs(t - c), c, j) for j, z, c in chart if z == s and abs(t - c) <= timedelta(hours=2)]
        if near:
            want.add((i, min(near)[2]))
    assert {tuple(r) for r in nearest.oxygen(_labs(spark, labs), _chart(spark, chart)).collect()} == want
