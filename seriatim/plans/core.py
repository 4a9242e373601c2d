"""Registered queries of the general data-preparation operators, with their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seriatim.operators import intervals, spikes, unify
from seriatim.sources.tables import table


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return intervals.ventilation_gaps(table(spark, root, "ventilation"))


def p3_periods(spark: SparkSession, root: str) -> DataFrame:
    return intervals.ventilation_periods(table(spark, root, "ventilation"))


def _unit_inputs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = unify.records(table(spark, root, "labevents"), table(spark, root, "chartevents"), table(spark, root, "inputevents"))
    return rows, table(spark, root, "quantity_units"), table(spark, root, "d_items")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return unify.foreign(*_unit_inputs(spark, root))


def p2_common(spark: SparkSession, root: str) -> DataFrame:
    return unify.unified(*_unit_inputs(spark, root)).drop("scale", "offset", "dims")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return spikes.found(table(spark, root, "chartevents"), table(spark, root, "d_items"))


QUERIES = {f.__name__: f for f in (p2_found, p2_common, p3_found, p3_periods, p5_found)}

_ISLANDS = """
with v as (select distinct stay_id, lower(regexp_replace(ventilation_status, '^\\s+|\\s+$', '', 'g')) as ventilation_status, least(starttime, endtime) as s, greatest(starttime, endtime) as e
  from ventilation where stay_id is not null and ventilation_status is not null and starttime is not null and endtime is not null),
m as (select *, max(e) over (partition by stay_id, ventilation_status order by s, e rows between unbounded preceding and 1 preceding) as before from v)
"""

#: Names of units as the tables spell them, lower case, with the unit that they stand for.
_SPELT = {
    "degc": "degc|deg c|°c|c", "degf": "degf|deg f|°f|f", "kg": "kg", "lb": "lb|lbs|lbs.|pounds", "g": "g", "cm": "cm", "m": "m", "inch": "in|inch", "ft": "ft|'", "%": "%",
    "mg/dl": "mg/dl|mg / dl|mg/100ml", "mmol/l": "mmol/l|mm", "umol/l": "umol/l|µmol/l|μmol/l|micromol/l", "g/dl": "g/dl|gm/dl", "g/l": "g/l", "mmhg": "mm hg|mmhg|torr", "kpa": "kpa",
    "k/ul": "k/ul|k/µl|10^9/l|x10e9/l|thou/ul", "/ul": "/ul|cells/ul|per µl", "mcg/kg/min": "mcg/kg/min|ug/kg/min|µg/kg/min|mcg/kg/minute", "mcg/kg/hr": "mcg/kg/hr|mcg/kg/hour|ug/kg/h", "mcg/min": "mcg/min|ug/min|µg/min",
    "mg/hr": "mg/hr|mg/h|mg/hour", "units/hour": "units/hour|units/hr|u/h", "units/min": "units/min|units/minute|u/min",
}
#: quantity, unit, factor and offset to the common unit; w: divided by the body weight.
_FACTORS = [
    ("temperature", "degc", "1", "0"), ("temperature", "degf", "5.0 / 9", "-160.0 / 9"), ("weight", "kg", "1", "0"), ("weight", "lb", "0.45359237", "0"), ("weight", "g", "0.001", "0"),
    ("height", "cm", "1", "0"), ("height", "inch", "2.54", "0"), ("height", "m", "100", "0"), ("height", "ft", "30.48", "0"), ("fio2", "%", "1", "0"), ("fio2", "part", "100", "0"),
    ("glucose", "mg/dl", "1", "0"), ("glucose", "mmol/l", "18.0156", "0"), ("creatinine", "mg/dl", "1", "0"), ("creatinine", "umol/l", "0.011312", "0"), ("bilirubin", "mg/dl", "1", "0"), ("bilirubin", "umol/l", "0.058466", "0"),
    ("hemoglobin", "g/dl", "1", "0"), ("hemoglobin", "g/l", "0.1", "0"), ("lactate", "mmol/l", "1", "0"), ("lactate", "mg/dl", "1 / 9.008", "0"), ("po2", "mmhg", "1", "0"), ("po2", "kpa", "7.50061683", "0"), ("platelets", "k/ul", "1", "0"), ("platelets", "/ul", "0.001", "0"),
    *[(d, u, f, "0") for d in ("norepinephrine", "epinephrine", "dopamine", "dobutamine") for u, f in (("mcg/kg/min", "1"), ("mcg/kg/hr", "1 / 60.0"), ("mcg/min", "1 / w"), ("mg/hr", "1000 / 60.0 / w"))],
    ("vasopressin", "units/hour", "1", "0"), ("vasopressin", "units/min", "60", "0"),
]
_SQL = lambda t: "'" + t.replace("'", "''") + "'"
_P2 = f"""
with names as (select * from (values {", ".join(f"({_SQL(n)}, {_SQL(u)})" for u, ns in _SPELT.items() for n in ns.split("|"))}) as t(name, unit)),
k as (select q.quantity, q.itemid, q.low, q.high, (select unit from names where name = lower(q.common_unit)) as common, coalesce((select unit from names where name = lower(i.unitname)), (select unit from names where name = lower(trim(regexp_replace(regexp_extract(i.label, '\\(([^)]*)\\)', 1), '^POC, ', '')))), (select unit from names where name = lower(q.common_unit))) as own
  from quantity_units q left join d_items i using (itemid)),
r as (select 'labevents' as src, labevent_id as rec_id, itemid, value, valuenum as num, valueuom as uom, null::double as w from labevents union all select 'chartevents', row_id, itemid, value, valuenum, null, null from chartevents where value is not null union all select 'inputevents', row_id, itemid, null, rate, rateuom, patientweight from inputevents where rate is not null),
p as (select r.*, k.* exclude (itemid), lower(regexp_extract(value, '[0-9]+(?:[.,][0-9]+)?\\s*(.*)$', 1)) as rest, try_cast(replace(regexp_extract(value, '[0-9]+(?:[.,][0-9]+)?'), ',', '.') as double) as said from r join k using (itemid)),
u as (select *, (select unit from names where name = trim(regexp_replace(regexp_replace(rest, ' oral$', ''), '^('' *|ft ).*$', '\\1'))) as written, (select unit from names where name = lower(uom)) as given from p where coalesce(num, said) is not null),
x as (select *, coalesce(num, said) as v from u),
f as (select * from (values {", ".join(f"({_SQL(q)}, {_SQL(u)}, {k})" for k, (q, u, _, _) in enumerate(_FACTORS))}) as t(quantity, unit, k)),
c as (select x.*, f.unit, case f.k {" ".join(f"when {k} then v * ({a}) + ({b})" for k, (_, _, a, b) in enumerate(_FACTORS))} end as y from (select *, coalesce(w, null) as w_ from x where written is null and given is null) x join f using (quantity)),
d as (select src, rec_id, bool_or(unit = own and not (y between low - 1e-9 * greatest(1, high) and high + 1e-9 * greatest(1, high))) and bool_or(unit <> own and y between low - 1e-9 * greatest(1, high) and high + 1e-9 * greatest(1, high)) as moved, any_value(own) as own, any_value(common) as common,
  bool_or(unit = common and own <> common and y between low and high) as to_common from c group by 1, 2)
select src, rec_id from x where written is not null and written <> common union all select src, rec_id from x where written is null and given is not null and given <> common
union all select src, rec_id from d where case when coalesce(moved, false) then not coalesce(to_common, false) else own <> common end
"""

ORACLE = {
    "p2_found": _P2,
    "p3_found": _ISLANDS + "select stay_id, ventilation_status, strftime(before, '%Y-%m-%d %H:%M:%S') as gap_from, strftime(s, '%Y-%m-%d %H:%M:%S') as gap_to from m where s > before",
    "p3_periods": _ISLANDS + """, i as (select *, sum(case when before >= s then 0 else 1 end) over (partition by stay_id, ventilation_status order by s, e rows unbounded preceding) as island from m)
select stay_id, ventilation_status, strftime(min(s), '%Y-%m-%d %H:%M:%S') as period_from, strftime(max(e), '%Y-%m-%d %H:%M:%S') as period_to from i group by stay_id, ventilation_status, island""",
}
