"""The unit grammar and the conversion of records."""

import pytest

from seriatim.functions import units
from seriatim.operators import unify


@pytest.mark.parametrize(
    ("text", "number", "unit"),
    [
        ("T 36.0 C", 36.0, "degC"),
        ("98,6", 98.6, None),
        ("37.1 deg C oral", 37.1, "degC"),
        ("99.3F", 99.3, "degF"),
        ("wt 77 kg", 77.0, "kg"),
        ("176.7lbs.", 176.7, "lb"),
        ("62 mg / dL", 62.0, "mg/dL"),
        ("0.8 mg/100mL", 0.8, "mg/dL"),
        ("10.2 mM", 10.2, "mmol/L"),
        ("48μmol/l", 48.0, "umol/L"),
        ("99 MM HG", 99.0, "mm Hg"),
        ("62 torr", 62.0, "mm Hg"),
        ("336 x10E9/L", 336.0, "K/uL"),
        ("491100per µL", 491100.0, "/uL"),
        ("1,234 g", 1234.0, "g"),
        ("0,400", 0.4, None),
        ("-5 %", -5.0, "%"),
    ],
)
def test_quantities(text, number, unit):
    n, u = units.quantity(text)
    assert n == number
    assert (u is None) if unit is None else units.same(u, units.unit(unit))


@pytest.mark.parametrize(("text", "cm"), [("5 ft 8 in", 172.72), ("5'10\"", 177.8), ("1.79m", 179), ("66 in", 167.64)])
def test_lengths_add_up(text, cm):
    n, u = units.quantity(text)
    assert units.convert(n, u, units.unit("cm")) == pytest.approx(cm)


@pytest.mark.parametrize("text", [None, "", "   ", "hemolyzed", "___", "-", "see note"])
def test_no_number(text):
    assert units.quantity(text) == (None, None)


def test_exponents():
    assert units.unit("mcg/kg/min").dims == units.unit("units/hour").dims[:5] + (0,)
    assert units.unit("mm Hg").dims == (1, -1, -2, 0, 0, 0)
    assert units.unit("mmol/L").dims == (0, -3, 0, 1, 0, 0)
    assert units.unit("nonsense") is None


def test_conversions():
    u = units.unit
    assert units.convert(100.4, u("degF"), u("degC")) == pytest.approx(38)
    assert units.convert(5.5, u("mmol/L"), u("mg/dL"), 0.180156) == pytest.approx(99.0858)
    assert units.convert(6.0, u("mg/hr"), u("mcg/kg/min"), None, 50.0) == pytest.approx(2)
    assert units.convert(6.0, u("mg/hr"), u("mcg/kg/min")) is None
    assert units.convert(1.0, u("kg"), u("cm")) is None


def _resolve(name, text, num=None, uom=None, own="mg/dL", common="mg/dL", low=50.0, high=450.0, body=None):
    got = units.resolve(name, text, num, uom, own, common, low, high, body)
    return got and (got[0], units.same(got[1], units.unit(common)), got[2])


def test_which_unit():
    assert _resolve("glucose", "5.5", 5.5)[1] is False  # outside in its own unit, inside in the other
    assert _resolve("glucose", "90", 90.0)[1] is True
    assert _resolve("glucose", "90 mmol/L", 90.0, "mg/dL")[1] is False  # the text comes first
    assert _resolve("glucose", "5.5", 5.5, "mg/dL")[1] is True  # a named unit is believed
    assert _resolve("glucose", "5.5 kg", 5.5, "mmol/L")[1] is False  # a unit of something else is none
    assert _resolve("glucose", "cancelled") is None
    assert _resolve("fio2", "0.4", 0.4, None, "%", "%", 21.0, 100.0) == (0.4, False, pytest.approx(40.0))
    assert _resolve("epinephrine", None, 5.0, None, "mcg/min", "mcg/kg/min", 0.0, 2.0) == (5.0, False, None)


def test_records(spark):
    """Nulls, repeated rows, extra columns and other items."""
    lab = spark.createDataFrame([(1, 50931, "5.5", 5.5, None, "x"), (1, 50931, "5.5", 5.5, None, "x"), (2, 50931, None, None, "mg/dL", "x"), (3, 1, "5", 5.0, None, "x"), (None, 50931, "5.5", 5.5, None, "x"), (4, None, "5.5", 5.5, None, "x")], "labevent_id bigint, itemid int, value string, valuenum double, valueuom string, quantity string")
    chart = spark.createDataFrame([(7, 223761, "T 36.0 C", None), (8, 223761, None, 99.0), (9, 223761, "37,0", None)], "row_id bigint, itemid int, value string, valuenum double")
    inp = spark.createDataFrame([(5, 221906, None, "mcg/min", 70.0), (6, 221906, 7.0, "mcg/min", 70.0)], "row_id bigint, itemid int, rate double, rateuom string, patientweight double")
    q = spark.createDataFrame([("glucose", 50931, "mg/dL", 50.0, 450.0), ("temperature", 223761, "degC", 30.0, 43.0), ("norepinephrine", 221906, "mcg/kg/min", 0.0, 3.0)], "quantity string, itemid int, common_unit string, low double, high double")
    items = spark.createDataFrame([(50931, "Glucose", "mg/dL"), (223761, "Temperature Fahrenheit", "degF"), (221906, "Norepinephrine", "mcg/kg/min")], "itemid int, label string, unitname string")
    rows = unify.records(lab, chart, inp)
    got = sorted(map(tuple, unify.foreign(rows, q, items).collect()))
    assert got == [("inputevents", 6), ("labevents", 1), ("labevents", 1)]
    common = {(r["src"], r["rec_id"]): r["common_value"] for r in unify.unified(rows, q, items).collect()}
    assert common[("chartevents", 7)] == pytest.approx(36) and common[("chartevents", 9)] == pytest.approx(37) and common[("inputevents", 6)] == pytest.approx(0.1)
    assert unify.foreign(unify.records(lab.limit(0), chart.limit(0), inp.limit(0)), q, items).count() == 0
