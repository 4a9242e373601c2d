"""Dyadic periods and gaps against a sorted sweep."""

from datetime import datetime, timedelta

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from seriatim.operators import intervals

T0 = datetime(2150, 1, 1)


def sweep(rows):
    out = []
    for lo, hi in sorted(rows):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200), st.integers(1, 40)), min_size=1, max_size=30))
def test_runs_equal_a_sweep(rows):
    lo = np.array([a for a, _ in rows], np.int64)
    hi = np.minimum(lo + np.array([n for _, n in rows], np.int64), 256)
    _, a, z = intervals.runs(np.zeros(len(lo), np.int64), lo, hi, 8)
    assert list(zip(a.tolist(), z.tolist())) == sweep(zip(lo.tolist(), hi.tolist()))


def test_blocks_are_canonical():
    g, level, i = intervals.blocks(np.zeros(1, np.int64), np.array([3]), np.array([14]), 4)
    assert sorted(((x << lv), ((x + 1) << lv)) for lv, x in zip(level.tolist(), i.tolist())) == [(3, 4), (4, 8), (8, 12), (12, 14)]


def test_siblings_merge_and_ancestors_cover():
    g = np.zeros(4, np.int64)
    kept = intervals.uncovered(g, np.array([2, 0, 1, 0]), np.array([0, 1, 1, 4]))
    assert sorted(zip(kept[1].tolist(), kept[2].tolist())) == [(0, 4), (2, 0)]
    m = intervals.merged(np.zeros(4, np.int64), np.zeros(4, np.int64), np.array([0, 1, 2, 3]), 3)
    assert [x.tolist() for x in m] == [[0], [2], [0]]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "stay_id bigint, starttime timestamp_ntz, endtime timestamp_ntz, ventilation_status string, slot int, lo string")


def _h(x):
    return T0 + timedelta(hours=x)


def test_gaps_and_periods(spark):
    """Touching joins, empty and reversed intervals count, nulls are left out, status is trimmed, long spells cross slots."""
    rows = [
        (1, _h(0), _h(2), " InvasiveVent ", 1, "x"),
        (1, _h(2), _h(3), "invasivevent", 1, "x"),
        (1, _h(2), _h(3), "invasivevent", 1, "x"),
        (1, _h(7), _h(5), "InvasiveVent", 1, "x"),
        (1, _h(9), _h(9), "INVASIVEVENT", 1, "x"),
        (1, _h(100), _h(2000), "InvasiveVent", 1, "x"),
        (1, _h(150), _h(160), "InvasiveVent", 1, "x"),
        (1, _h(5000), _h(5001), "InvasiveVent", 1, "x"),
        (1, None, _h(4), "InvasiveVent", 1, "x"),
        (2, _h(0), _h(1), None, 1, "x"),
        (2, _h(0), _h(1), "None", 1, "x"),
    ]
    df = _frame(spark, rows)
    f = lambda x: _h(x).strftime("%Y-%m-%d %H:%M:%S")
    gaps = {tuple(r) for r in intervals.ventilation_gaps(df).collect()}
    assert gaps == {(1, "invasivevent", f(a), f(b)) for a, b in ((3, 5), (7, 9), (9, 100), (2000, 5000))}
    periods = {tuple(r) for r in intervals.ventilation_periods(df).collect()}
    assert periods == {(1, "invasivevent", f(a), f(b)) for a, b in ((0, 3), (5, 7), (9, 9), (100, 2000), (5000, 5001))} | {(2, "none", f(0), f(1))}


def test_empty_table(spark):
    df = _frame(spark, [])
    assert intervals.ventilation_gaps(df).count() == 0 and intervals.ventilation_periods(df).count() == 0


def test_one_microsecond_is_a_gap(spark):
    df = _frame(spark, [(1, _h(0), _h(1), "a", 0, ""), (1, _h(1) + timedelta(microseconds=1), _h(2), "a", 0, "")])
    assert intervals.gaps(df, ["stay_id", "ventilation_status"]).count() == 1
