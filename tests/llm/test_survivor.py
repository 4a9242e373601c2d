"""Survivors: order of trust, field by field, nulls and ties."""

from datetime import datetime

from seriatim.llm import survivor

T = [datetime(2150, 1, 1, 8, m, s) for m, s in ((0, 0), (0, 40), (1, 0), (5, 0))]
SCHEMA = "row_id bigint, subject_id bigint, stay_id bigint, charttime timestamp_ntz, storetime timestamp_ntz, itemid int, value string, valuenum double, warning int, minute string, v string"


def _run(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_order(spark):
    rows = [
        (9, 1, 5, T[0], T[3], 7, "a", 1.0, 1),  # complete but doubtful
        (8, 1, None, T[1], T[3], 7, "b", None, 0),
        (7, 1, 5, T[0], T[2], 7, None, 2.0, 0),  # most complete of the trusted
        (6, 1, None, T[0], None, 7, "c", 3.0, 0),
        (5, 1, 5, T[2], T[2], 7, "d", 4.0, 0),  # the next minute
        (4, 2, None, T[0], None, 7, None, None, None),
        (3, 2, None, T[0], None, 7, None, None, None),
        (2, None, 5, T[0], T[0], 7, "n", 1.0, 0),
        (1, 1, 5, None, T[0], 7, "n", 1.0, 0),
    ]
    df = _run(spark, rows)
    assert {tuple(r) for r in survivor.found(df).collect()} == {(6, 7), (3, 3)}
    got = {(r["subject_id"], r["first_row_id"]): r for r in survivor.survivors(df).collect()}
    r = got[(1, 6)]
    assert (r["n_copies"], r["stay_id"], r["storetime"], r["value"], r["valuenum"], r["warning"]) == (4, 5, T[3], "b", 2.0, 0)
    assert got[(2, 3)]["value"] is None and got[(1, 5)]["n_copies"] == 1


def test_latest_then_smallest(spark):
    rows = [(3, 1, 5, T[0], T[2], 7, "a", 1.0, 0), (2, 1, 5, T[0], T[3], 7, "b", 1.0, 0), (1, 1, 5, T[0], T[3], 7, "c", 1.0, 0), (1, 1, 5, T[0], T[3], 7, "c", 1.0, 0)]
    assert [tuple(r) for r in survivor.found(_run(spark, rows)).collect()] == [(1, 1)]


def test_empty(spark):
    assert survivor.found(_run(spark, [])).count() == 0
