"""Flags of planted spikes, frozen runs and impossible readings."""

from datetime import datetime, timedelta

import numpy as np

from seriatim.operators import spikes


def series(n=80, seed=1, level=80.0):
    return np.round(level + np.random.default_rng(seed).normal(0, 3, n))


def flag(x, low=0.0, high=300.0):
    return spikes.flags([(x, x, low, high)])[0].tolist()


def test_calm_series_has_no_flags():
    for seed in range(20):
        assert not any(flag(series(seed=seed)))


def test_one_to_three_spikes():
    for n in (1, 2, 3):
        x = series()
        x[30 : 30 + n] = 150 + np.arange(n)
        got = flag(x)
        assert [i for i, f in enumerate(got) if f == 1] == list(range(30, 30 + n)) and sum(map(bool, got)) == n


def test_equal_spikes():
    x = series()
    x[30:33] = 150
    assert [i for i, f in enumerate(flag(x)) if f] == [30, 31, 32]


def test_change_of_level_is_no_spike():
    x = series()
    x[40:] += 60
    assert not any(flag(x))


def test_longer_excursion_is_no_spike():
    x = series()
    x[40:45] += 80
    assert 1 not in flag(x)


def test_frozen_run():
    x = series()
    x[20:32] = 81
    x[[19, 32]] = 85, 78
    got = flag(x)
    assert [i for i, f in enumerate(got) if f == 2] == list(range(20, 32))
    y = series()
    y[20:29] = 81
    y[[19, 29]] = 85, 78
    assert 2 not in flag(y)


def test_frozen_run_with_differing_copies():
    x = series()
    x[20:32], x[19], x[32] = 81, 85, 78
    hi = x.copy()
    hi[25] += 1
    lo = x.copy()
    lo[27] -= 1
    got = spikes.flags([(lo, hi, 0.0, 300.0)])[0]
    assert (got[20:32] == 2).all()


def test_a_setpoint_is_not_frozen():
    x = np.repeat([14.0, 16.0, 12.0, 18.0], 25)
    assert not any(flag(x))


def test_out_of_range():
    x = series()
    x[[3, 40]] = 999, -5
    assert [i for i, f in enumerate(flag(x)) if f == 3] == [3, 40]


def test_short_and_constant():
    assert flag(np.array([80.0])) == [0]
    assert flag(np.array([80.0, 81.0, 500.0])) == [0, 0, 3]
    assert not any(flag(np.full(50, 80.0)))
    assert spikes.flags([]) == []


def _chart(spark, rows):
    return spark.createDataFrame(rows, "row_id bigint, stay_id bigint, itemid int, charttime timestamp_ntz, value string, valuenum double, entity string, chunk int")


ITEMS = [(220045, "Routine Vital Signs", 0.0, 300.0), (1, "Other", None, None)]


def test_query(spark):
    t0 = datetime(2150, 1, 1)
    x = series()
    x[30] = 150
    rows = [(i, 5, 220045, t0 + timedelta(hours=i), f"{v:g} bpm", None if i % 2 else float(v), "e", 0) for i, v in enumerate(x)]
    rows += [(130, 5, 220045, t0 + timedelta(hours=30, seconds=20), "150", 150.0, "e", 0), (131, 5, 220045, t0 + timedelta(hours=31), "999", 999.0, "e", 0)]
    rows += [(200, None, 220045, t0, "999", 999.0, "e", 0), (201, 5, 220045, None, "999", 999.0, "e", 0), (202, 5, 1, t0, "999", 999.0, "e", 0), (203, 5, 220045, t0, "ERROR", None, "e", 0), (204, 5, 220045, t0, None, float("nan"), "e", 0)]
    items = spark.createDataFrame(ITEMS, "itemid int, category string, low_limit double, high_limit double")
    got = sorted(r[0] for r in spikes.found(_chart(spark, rows), items).collect())
    assert got == [30, 130, 131]
    assert spikes.found(_chart(spark, []), items).count() == 0


def test_chunks_cover_every_reading_once(spark):
    rows = [(1, 2, i * 400, float(i), float(i), None, None) for i in range(1000)] + [(3, 2, i, 0.0, 0.0, None, None) for i in range(5)]
    df = spark.createDataFrame(rows, "entity bigint, kind int, minute bigint, lo double, hi double, low_limit double, high_limit double")
    got = spikes.chunked(df, chunk=100, halo=10).collect()
    assert sorted((r["entity"], r["minute"]) for r in got if r["own"]) == sorted((r[0], r[2]) for r in rows)
    sizes = {}
    for r in got:
        sizes.setdefault((r["entity"], r["chunk"]), [0, 0])[0 if r["own"] else 1] += 1
    assert sizes[(1, 0)] == [100, 10] and sizes[(1, 5)] == [100, 20] and sizes[(3, 0)] == [5, 0]


def test_a_freeze_as_long_as_a_chunk(spark):
    """The source changes before and after, so every reading of the freeze is stuck, in whatever chunk it lies."""
    t0 = datetime(2150, 1, 1)
    x = np.r_[series(4000), np.full(10_000, 81.0), series(4000, seed=2)]
    x[[3999, 14_000]] = 85, 78
    rows = [(i, 5, 220045, t0 + timedelta(minutes=7 * i), None, float(v), "e", 0) for i, v in enumerate(x)]
    items = spark.createDataFrame(ITEMS, "itemid int, category string, low_limit double, high_limit double")
    got = {r["row_id"] for r in spikes.flagged(_chart(spark, rows), items).where("flag = 'stuck'").collect()}
    assert got == set(range(4000, 14_000))


def test_spike_among_few_readings():
    assert flag(np.array([80.0, 82, 150, 81, 79])) == [0, 0, 1, 0, 0]
    assert flag(np.array([80.0, 81, 150, 82, 80, 83, 81])) == [0, 0, 1, 0, 0, 0, 0]
    assert not any(flag(np.array([80.0, 84, 81, 79, 82])))
    assert not any(flag(np.array([80.0, 81, 82, 150, 151, 150])))
