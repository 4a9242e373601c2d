"""A grammar of quantities: numbers with unit expressions, as scale, offset and exponent vectors.

    quantity   := [words] part { part } [words]          several parts add up: 5 ft 8 in
    part       := number [expression]
    expression := ["per"] factor { ("/" | "per" | "*") factor }
    factor     := atom | power of ten | whole number

A unit is (scale, offset, exponents): x in the unit is x * scale + offset in base units, and the
exponents count mass, length, time, amount, temperature and international units. Names are read
without regard to case, except where case tells two units apart (mM and mm).
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

Dims = tuple[int, int, int, int, int, int]


class Unit(NamedTuple):
    scale: float
    offset: float
    dims: Dims


NONE: Dims = (0, 0, 0, 0, 0, 0)
MASS, LENGTH, TIME, AMOUNT, HEAT, IU = (tuple(int(i == k) for i in range(6)) for k in range(6))
VOLUME, PRESSURE, MOLAR = (0, 3, 0, 0, 0, 0), (1, -1, -2, 0, 0, 0), (0, -3, 0, 1, 0, 0)

#: The scale of each name to kilogram, metre, second, mole, kelvin and unit.
_NAMED = {
    MASS: {1.0: "kg kgs kilogram kilograms", 1e-3: "g gm gms gram grams", 1e-6: "mg milligram", 1e-9: "mcg ug microgram", 1e-12: "ng", 0.45359237: "lb lbs pound pounds", 0.028349523125: "oz"},
    LENGTH: {1.0: "m meter meters metre metres", 1e-2: "cm", 1e-3: "mm", 0.0254: 'in inch inches "', 0.3048: "ft foot feet '"},
    VOLUME: {1e-3: "l liter litre", 1e-4: "dl", 1e-6: "ml cc", 1e-9: "ul"},
    TIME: {1.0: "s sec second", 60.0: "min minute minutes", 3600.0: "h hr hrs hour hours", 86400.0: "d day days"},
    AMOUNT: {1.0: "mol", 1e-3: "mmol millimol", 1e-6: "umol micromol", 1e-9: "nmol"},
    PRESSURE: {1.0: "pa", 1e3: "kpa", 133.322387415: "mmhg torr"},
    IU: {1.0: "u iu unit units"},
    NONE: {1.0: "cell cells fraction breaths insp beats bpm", 1e3: "k thou thousand", 1e6: "mil million", 1e-2: "% percent pct"},
}
ATOMS = {name: Unit(scale, 0.0, dims) for dims, by in _NAMED.items() for scale, names in by.items() for name in names.split()}
ATOMS |= {name: Unit(1.0, 273.15, HEAT) for name in ("degc", "celsius", "c")} | {name: Unit(5 / 9, 459.67 * 5 / 9, HEAT) for name in ("degf", "fahrenheit", "f")}
#: Names whose case matters.
CASED = {"mM": Unit(1.0, 0.0, MOLAR), "uM": Unit(1e-3, 0.0, MOLAR), "M": Unit(1e3, 0.0, MOLAR)}

#: Molar masses in kilograms per mole, and the units in which a quantity is recorded.
MOLAR_MASS = {"glucose": 0.180156, "creatinine": 0.11312, "bilirubin": 0.58466, "lactate": 0.09008}
_DOSE = ("mcg/kg/min", "mcg/kg/hr", "mcg/min", "mg/hr")
RECORDED = {
    "temperature": ("degC", "degF"),
    "weight": ("kg", "lb", "g"),
    "height": ("cm", "in", "m", "ft"),
    "fio2": ("%", "fraction"),
    "glucose": ("mg/dL", "mmol/L"),
    "creatinine": ("mg/dL", "umol/L"),
    "bilirubin": ("mg/dL", "umol/L"),
    "hemoglobin": ("g/dL", "g/L"),
    "lactate": ("mmol/L", "mg/dL"),
    "po2": ("mm Hg", "kPa"),
    "platelets": ("K/uL", "/uL"),
    "norepinephrine": _DOSE,
    "epinephrine": _DOSE,
    "dopamine": _DOSE,
    "dobutamine": _DOSE,
    "vasopressin": ("units/hour", "units/min"),
}

_NUMBER = re.compile(r"[+-]?(?:\d+(?:[.,]\d+)*|\.\d+)(?:[eE][+-]?\d+)?")
_TOKEN = re.compile(r"\s*(?:(?P<power>[x×]?\s*10\s*(?:\^|\*\*|[eE])\s*[+-]?\d+)|(?P<whole>\d+)|(?P<op>[/*·])|(?P<name>[A-Za-z]+|[%\"']))")


def number(text: str) -> float:
    """A number with a decimal point or a decimal comma; commas before groups of three are thousands."""
    if "," in text:
        head, *groups = text.split(",")
        thousands = all(re.fullmatch(r"\d{3}(\.\d+)?", g) for g in groups) and head.lstrip("+-") not in ("", "0")
        text = text.replace(",", "" if thousands else ".")
    return float(text)


def _plain(text: str) -> str:
    for a, b in (("µ", "u"), ("μ", "u"), ("°", "deg"), ("″", '"'), ("′", "'"), ("²", "2")):
        text = text.replace(a, b)
    text = re.sub(r"(?i)\bmm\s*hg\b", "mmhg", text)
    return re.sub(r"(?i)deg\.?\s*([cf])(?![a-z])", r"deg\1", text)


def _product(a: Unit, b: Unit, sign: int) -> Unit:
    return Unit(a.scale * b.scale**sign, 0.0, tuple(x + sign * y for x, y in zip(a.dims, b.dims)))


def _expression(text: str) -> tuple[Unit | None, int]:
    """The longest unit expression that text begins with, and its length."""
    got, at, sign, good, open_ = None, 0, 1, 0, True
    while m := _TOKEN.match(text, at):
        kind, word = m.lastgroup, m[m.lastgroup]
        if kind == "op" or word.lower() == "per":
            if open_ and got is not None:
                break
            sign, open_ = (1 if word in "*·" else -1), True
            got = got or Unit(1.0, 0.0, NONE)
        else:
            if not open_:
                break
            if kind == "name":
                unit = CASED.get(word) or ATOMS.get(word.lower())
            else:
                unit = Unit(10.0 ** int(re.split(r"\^|\*\*|[eE]", word)[-1]) if kind == "power" else float(word), 0.0, NONE)
            if unit is None:
                break
            got = unit if got is None else _product(got, unit, sign)
            if kind == "name":
                sign, open_, good = 1, False, m.end()
            else:  # a number belongs to the name right after it, as in mg/100mL
                after = _TOKEN.match(text, m.end())
                open_ = bool(after and after.lastgroup == "name" and after["name"].lower() != "per")
                sign = sign if open_ else 1
        at = m.end()
    return (got if good else None), good


@lru_cache(100_000)
def unit(text: str | None) -> Unit | None:
    """The unit that a text names, or None; the text may end with words that are no unit."""
    return _expression(_plain(text))[0] if text else None


@lru_cache(200_000)
def quantity(text: str | None) -> tuple[float | None, Unit | None]:
    """The number in a text and the unit written with it; parts of one dimension add up in base units."""
    if not text:
        return None, None
    text, parts, at = _plain(text), [], 0
    while m := _NUMBER.search(text, at):
        if m.start() and text[m.start() - 1].isalnum() and not parts:
            at = m.end()
            continue
        if parts and text[at : m.start()].strip(" .'\"") != "":
            break
        u, length = _expression(text[m.end() :])
        parts.append((number(m[0]), u))
        at = m.end() + length
        if u is None:
            break
    if not parts:
        return None, None
    if len(parts) > 1 and all(u and u.dims == parts[0][1].dims and not u.offset for _, u in parts):
        return sum(x * u.scale for x, u in parts), Unit(1.0, 0.0, parts[0][1].dims)
    return parts[0]


def same(a: Unit, b: Unit) -> bool:
    """Whether two units differ in name only."""
    return a.dims == b.dims and abs(a.scale / b.scale - 1) < 1e-9 and abs(a.offset - b.offset) < 1e-9


def convert(x: float, a: Unit, b: Unit, molar_mass: float | None = None, body: float | None = None) -> float | None:
    """x of unit a in unit b; None if the dimensions do not meet.

    Amounts meet masses through the molar mass, doses of a whole body meet doses per kilogram
    through the body weight in kilograms.
    """
    off = tuple(p - q for p, q in zip(a.dims, b.dims))
    base = x * a.scale + a.offset
    if off != NONE:
        if off == (-1, 0, 0, 1, 0, 0) and molar_mass:
            base *= molar_mass
        elif off == (1, 0, 0, -1, 0, 0) and molar_mass:
            base /= molar_mass
        elif off == MASS and body:
            base /= body
        elif off == (-1, 0, 0, 0, 0, 0) and body:
            base *= body
        else:
            return None
    return (base - b.offset) / b.scale


def meets(a: Unit, b: Unit, name: str) -> bool:
    """Whether a value of a can be one of b for this quantity, given a body weight where that is needed."""
    return convert(1.0, a, b, MOLAR_MASS.get(name), 70.0) is not None


@lru_cache(1_000)
def own(unitname: str | None, label: str | None) -> str | None:
    """An item's own unit: its unitname, or else the part of its label's brackets that names one."""
    if unitname:
        return unitname
    for inside in re.findall(r"\(([^)]*)\)", label or ""):
        for part in inside.split(","):
            if unit(part.strip()):
                return part.strip()
    return None


def resolve(name: str, text: str | None, num: float | None, uom: str | None, own_unit: str | None, common: str, low: float, high: float, body: float | None) -> tuple[float, Unit, float | None] | None:
    """Number, unit and value in the common unit of one record; None without a number or a unit.

    The unit is the one written in the text, else uom, else the item's own, except where the
    number in that lies outside low..high and in another unit of the quantity inside.
    """
    target, mass = unit(common), MOLAR_MASS.get(name)
    said, written = quantity(text)
    x = num if num is not None and num == num else said
    if x is None:
        return None
    if written and meets(written, target, name):
        return said, written, convert(said, written, target, mass, body)
    u = unit(uom)
    if u and meets(u, target, name):
        return x, u, convert(x, u, target, mass, body)
    u = unit(own_unit) or target
    y, slack = convert(x, u, target, mass, body), 1e-9 * max(1.0, abs(high))
    if y is not None and not low - slack <= y <= high + slack:
        for other in RECORDED.get(name, ()):
            o = unit(other)
            z = None if same(o, u) else convert(x, o, target, mass, body)
            if z is not None and low - slack <= z <= high + slack:
                return x, o, z
    return x, u, y
