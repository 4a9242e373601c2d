"""Registered queries: whole exposure scores and comorbidity indices, with their SQL.

Admissions, patients, services, outputs, coma readings and diagnoses are no tables of the test
data. They are stood in for by columns of tables that are, by the rules of `stand_ins`; the SQL
repeats these rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriatim.operators import exposure, relational, strata
from seriatim.plans.exposures import _WIN
from seriatim.sources.tables import table


def stand_ins(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    stays = table(spark, root, "icustays", ["subject_id", "hadm_id", "stay_id", "intime"]).where("stay_id is not null and intime is not null")
    stays = stays.groupBy("stay_id").agg(F.min("subject_id").alias("subject_id"), F.min("hadm_id").alias("hadm_id"), F.min("intime").alias("intime"))
    admitted = stays.groupBy("subject_id", "hadm_id").agg((F.min("intime") - F.make_dt_interval(F.lit(0), (F.col("hadm_id") % 50).cast("int"))).alias("admittime"))
    kind = F.when(F.col("hadm_id") % 3 == 0, "ELECTIVE").otherwise("URGENT")
    service = F.element_at(F.array(*[F.lit(x) for x in ("CSURG", "MED", "ORTHO", "NMED")]), (F.col("hadm_id") % 4 + 1).cast("int"))
    moved = F.when(F.col("hadm_id") % 7 != 0, F.col("admittime") + F.make_dt_interval(F.lit(0), (F.col("hadm_id") % 90).cast("int")))
    inputs = table(spark, root, "inputevents", ["row_id", "stay_id", "itemid", "starttime", "rate"])
    item = F.when(F.col("row_id") % 5 == 0, 227488).when(F.col("row_id") % 5 == 1, 226560).otherwise(226559)
    chart = table(spark, root, "chartevents", ["subject_id", "stay_id", "itemid", "charttime", "valuenum"]).where("itemid in (220045, 220210, 220277) and valuenum is not null and stay_id is not null and charttime is not null")
    whole = F.floor("valuenum")
    part = F.when(F.col("itemid") == 220277, F.pmod(whole, F.lit(4)) + 1).when(F.col("itemid") == 220210, F.pmod(whole, F.lit(5)) + 1).otherwise(F.pmod(whole, F.lit(6)) + 1)
    name = F.when(F.col("itemid") == 220277, 220739).when(F.col("itemid") == 220210, 223900).otherwise(223901)
    tube = (F.col("itemid") == 220210) & (F.pmod(whole, F.lit(7)) == 0)
    return {
        "stays": stays,
        "admissions": admitted.select("subject_id", "hadm_id", "admittime", kind.alias("admission_type")),
        "patients": stays.groupBy("subject_id").agg(F.year(F.min("intime")).alias("y")).select("subject_id", (20 + F.col("subject_id") % 75).cast("int").alias("anchor_age"), (F.col("y") - F.col("subject_id") % 3).cast("int").alias("anchor_year")),
        "services": admitted.select("hadm_id", moved.alias("transfertime"), service.alias("curr_service")),
        "outputs": inputs.where("starttime is not null").select("stay_id", F.col("starttime").alias("charttime"), item.alias("itemid"), (F.col("rate") * 10).alias("value")),
        "coma": chart.select("stay_id", "charttime", name.alias("itemid"), F.when(tube, "No Response-ETT").otherwise("seen").alias("value"), part.cast("double").alias("valuenum")),
        "inputs": inputs,
    }


_STANDS = f"""with {_WIN.format(b=0)}, w6 as (select stay_id, t0 - interval 6 hour as t0, t1 from w),
sy as (select stay_id, min(subject_id) as subject_id, min(hadm_id) as hadm_id, min(intime) as intime from icustays where stay_id is not null and intime is not null group by 1),
ad as (select subject_id, hadm_id, min(intime) - to_hours(hadm_id % 50) as admittime, case when hadm_id % 3 = 0 then 'ELECTIVE' else 'URGENT' end as kind from sy group by subject_id, hadm_id),
pt as (select subject_id, 20 + subject_id % 75 as anchor_age, year(min(intime)) - subject_id % 3 as anchor_year from sy group by subject_id),
sv as (select hadm_id, case when hadm_id % 7 <> 0 then admittime + to_hours(hadm_id % 90) end as moved, ['CSURG', 'MED', 'ORTHO', 'NMED'][hadm_id % 4 + 1] as service from ad),
ot as (select stay_id, starttime as t, case when row_id % 5 = 0 then -(rate * 10) else rate * 10 end as signed from inputevents where starttime is not null and rate is not null),
cm as (select stay_id, charttime as t, max(case when itemid = 220045 then (floor(valuenum)::int % 6 + 6) % 6 + 1 end)::double as m, max(case when itemid = 220210 then case when floor(valuenum)::int % 7 = 0 then 0 else (floor(valuenum)::int % 5 + 5) % 5 + 1 end end)::double as v,
  max(case when itemid = 220277 then (floor(valuenum)::int % 4 + 4) % 4 + 1 end)::double as e, max(case when itemid = 220210 and floor(valuenum)::int % 7 = 0 then 1 else 0 end) as unable
  from chartevents where itemid in (220045, 220210, 220277) and valuenum is not null and stay_id is not null and charttime is not null group by 1, 2)"""


def r(c: str, digits: int = 4):
    return F.round(c, digits).alias(c)


def admission_facts(spark, root):
    s = stand_ins(spark, root)
    return exposure.admission_facts(s["stays"], s["admissions"], s["patients"], s["services"]).select("stay_id", F.col("age").cast("int").alias("age"), r("preiculos"), "surgical", "electivesurgery")


_FACTS = """fa as (select sy.stay_id, (anchor_age + year(admittime) - anchor_year)::int as age, round((epoch_us(sy.intime) - epoch_us(admittime)) / 60000000.0, 4) as preiculos,
  coalesce((select max((contains(lower(service), 'surg') or service = 'ORTHO')::int) from sv where sv.hadm_id = sy.hadm_id and (moved is null or moved < sy.intime + interval 1 day)), 0)::int as surgical, kind
  from sy left join ad using (subject_id, hadm_id) left join pt using (subject_id)),
fx as (select stay_id, age, preiculos, surgical, (kind = 'ELECTIVE' and surgical = 1)::int as electivesurgery from fa)"""


def vasopressor_flag(spark, root):
    w = exposure.windows(table(spark, root, "icustays"), "0 hours")
    return exposure.exposed(table(spark, root, "inputevents", ["stay_id", "itemid", "starttime", "rate"]), w, exposure.VASOPRESSORS).select("stay_id", "flag")


_VASO = "vs as (select stay_id, (exists (select 1 from inputevents i where i.stay_id = w.stay_id and itemid in (221906, 221289, 221662, 221653) and rate > 0 and starttime between t0 and t1))::int as flag from w)"


def first_day_output(spark, root):
    w = exposure.windows(table(spark, root, "icustays"), "0 hours")
    return exposure.first_day_output(stand_ins(spark, root)["outputs"], w, exposure.URINE).select("stay_id", r("urineoutput"))


_OUTPUT = "uo as (select ot.stay_id, sum(signed) as urineoutput from ot join w on w.stay_id = ot.stay_id and t between t0 and t1 group by 1)"


def coma_score(spark, root):
    w = exposure.windows(table(spark, root, "icustays"))
    return exposure.coma_score(stand_ins(spark, root)["coma"], w).select("stay_id", "gcs", "unable")


_COMA = """cl as (select *, lag(t) over s > t - interval 6 hour as fresh, lag(m) over s as lm, lag(v) over s as lv, lag(e) over s as le from cm window s as (partition by stay_id order by t)),
cp as (select *, case when fresh then lm end as pm, case when fresh then lv end as pv, case when fresh then le end as pe from cl),
ct as (select stay_id, t, unable, case when v = 0 then 15 when v is null and pv = 0 then 15 when pv = 0 then coalesce(m, 6) + coalesce(v, 5) + coalesce(e, 4) else coalesce(m, pm, 6) + coalesce(v, pv, 5) + coalesce(e, pe, 4) end::double as gcs from cp),
gc as (select stay_id, gcs, unable from (select ct.*, row_number() over (partition by ct.stay_id order by gcs, t desc) as k from ct join w6 on w6.stay_id = ct.stay_id and t between t0 and t1) where k = 1)"""


def _organs(spark, root):
    w = exposure.windows(table(spark, root, "icustays"), "0 hours")
    labs = {**exposure.LABS, "pao2": 50821}
    lab = table(spark, root, "labevents", ["subject_id", "itemid", "charttime", "valuenum"]).where(F.col("itemid").isin(*labs.values()) & F.col("valuenum").isNotNull())
    name = F.element_at(F.create_map(*[x for k, v in labs.items() for x in (F.lit(v), F.lit(k))]), F.col("itemid"))
    a = relational.extremes(relational.within(lab, w, "subject_id", "charttime", "t0", "t1").withColumn("measure", name), ["stay_id"], "measure", "valuenum", list(labs))
    s = stand_ins(spark, root)
    chart = table(spark, root, "chartevents", ["stay_id", "itemid", "charttime", "valuenum"]).where("itemid in (223835, 220052, 220181) and valuenum is not null")
    kind = F.when(F.col("itemid") == 223835, "fio2").otherwise("map")
    b = relational.extremes(relational.within(chart, w.drop("subject_id"), "stay_id", "charttime", "t0", "t1").withColumn("measure", kind), ["stay_id"], "measure", "valuenum", ["fio2", "map"])
    part = F.element_at(F.create_map(F.lit(220739), F.lit("eye"), F.lit(223900), F.lit("verbal"), F.lit(223901), F.lit("motor")), F.col("itemid"))
    c = relational.extremes(relational.within(s["coma"], w.drop("subject_id"), "stay_id", "charttime", "t0", "t1").withColumn("measure", part), ["stay_id"], "measure", "valuenum", ["eye", "verbal", "motor"])
    vaso = exposure.exposed(s["inputs"], w, exposure.VASOPRESSORS)
    return w.select("stay_id").join(a, "stay_id", "left").join(b, "stay_id", "left").join(c, "stay_id", "left").join(vaso, "stay_id", "left")


def organ_score(spark, root):
    """The six organ parts and their totals of three, four and six."""
    c = F.col
    parts = _organs(spark, root).select(
        "stay_id",
        exposure.coagulation(c("platelet_min")).alias("coag"),
        exposure.renal(c("creatinine_max")).alias("renal"),
        exposure.liver(c("bilirubin_max")).alias("liver"),
        exposure.respiratory(c("pao2_min"), c("fio2_max")).alias("resp"),
        exposure.cardiovascular(c("map_min"), c("flag")).alias("cardio"),
        exposure.nervous(c("eye_min"), c("verbal_min"), c("motor_min")).alias("cns"),
    )
    return exposure.organ_totals(parts)


_ORGANS = f"""{_VASO},
la as (select w.stay_id, min(case when itemid = 51265 then valuenum end) as pl, max(case when itemid = 50912 then valuenum end) as cr, max(case when itemid = 50885 then valuenum end) as bi, min(case when itemid = 50821 then valuenum end) as po
  from w left join labevents l on l.subject_id = w.subject_id and charttime between t0 and t1 group by 1),
cb as (select w.stay_id, max(case when itemid = 223835 then valuenum end) as fi, min(case when itemid in (220052, 220181) then valuenum end) as mp from w left join chartevents c on c.stay_id = w.stay_id and charttime between t0 and t1 and itemid in (223835, 220052, 220181) group by 1),
cc as (select w.stay_id, min(case when itemid = 220277 then (floor(valuenum)::int % 4 + 4) % 4 + 1 end) + min(case when itemid = 220210 then (floor(valuenum)::int % 5 + 5) % 5 + 1 end) + min(case when itemid = 220045 then (floor(valuenum)::int % 6 + 6) % 6 + 1 end) as g
  from w left join chartevents c on c.stay_id = w.stay_id and charttime between t0 and t1 and itemid in (220045, 220210, 220277) group by 1),
og as (select stay_id, case when pl < 20 then 4 when pl < 50 then 3 when pl < 100 then 2 when pl < 150 then 1 when pl is not null then 0 end as coag,
  case when cr >= 5 then 4 when cr >= 3.5 then 3 when cr >= 2 then 2 when cr >= 1.2 then 1 when cr is not null then 0 end as renal,
  case when bi >= 12 then 4 when bi >= 6 then 3 when bi >= 2 then 2 when bi >= 1.2 then 1 when bi is not null then 0 end as liver,
  po / nullif(case when fi > 1 then fi / 100 else fi end, 0) as ratio, case when flag = 1 then 3 when mp is null then null when mp < 70 then 1 else 0 end as cardio, g
  from w join la using (stay_id) join cb using (stay_id) join cc using (stay_id) join vs using (stay_id)),
oh as (select stay_id, coag, renal, liver, case when ratio < 100 then 4 when ratio < 200 then 3 when ratio < 300 then 2 when ratio < 400 then 1 when ratio is not null then 0 end as resp, cardio,
  case when g < 6 then 4 when g < 10 then 3 when g < 13 then 2 when g < 15 then 1 when g is not null then 0 end as cns from og),
oo as (select *, coag + liver + renal as sofa3, coag + liver + renal + resp as sofa4, coag + liver + renal + resp + cardio + cns as sofa6 from oh)"""


def organ_quartile(spark, root):
    """Quartiles by rank of the total of three parts, where it is there, with the part score of two (coagulation and kidney)."""
    o = organ_score(spark, root)
    both = o.where("coag is not null and renal is not null").select("stay_id", (F.col("coag") + F.col("renal")).alias("two"), "sofa3")
    return strata.bins_by_rank(both.where("sofa3 is not null"), "sofa3", "stay_id", 4, "quartile").select("stay_id", "two", "quartile")


def acuity_score(spark, root):
    """The ten parts of the acuity score and their total, a missing part counting as normal."""
    s = stand_ins(spark, root)
    stays = table(spark, root, "icustays")
    day, wide = exposure.windows(stays, "0 hours"), exposure.windows(stays)
    vent = table(spark, root, "ventilation").dropna().where(F.lower(F.trim("ventilation_status")) == "invasivevent")
    mv = relational.overlaps(vent, day.drop("subject_id"), "stay_id", "starttime", "endtime", "t0", "t1").select("stay_id", F.col("flag").alias("mechvent"))
    facts = exposure.admission_facts(s["stays"], s["admissions"], s["patients"], s["services"])
    vitals = exposure.first_day_vitals(table(spark, root, "chartevents"), stays)
    gcs = exposure.coma_score(s["coma"], wide).select("stay_id", F.col("gcs").alias("gcs_min"))
    out = exposure.first_day_output(s["outputs"], day, exposure.URINE)
    d = facts
    for part in (vitals, gcs, out, mv):
        d = d.join(part, "stay_id", "left")
    parts = [f"{k}_score" for k in exposure.oasis_parts()]
    return exposure.oasis(d).select("stay_id", *parts, "oasis")


_ACUITY = f"""{_FACTS}, {_OUTPUT}, {_COMA},
rd as (select stay_id, charttime, case when itemid = 220045 and valuenum > 0 and valuenum < 300 then 'hr' when itemid in (220052, 220181, 225312) and valuenum > 0 and valuenum < 300 then 'bp' when itemid in (220210, 224690) and valuenum > 0 and valuenum < 70 then 'rr'
  when itemid = 223761 and valuenum > 70 and valuenum < 120 then 'te' when itemid = 223762 and valuenum > 10 and valuenum < 50 then 'te' end as k, case when itemid = 223761 then (valuenum - 32) / 1.8 else valuenum end as v from chartevents),
rm as (select rd.stay_id, charttime, k, case when k = 'te' then round(avg(v), 2) else avg(v) end as v from rd join w6 on w6.stay_id = rd.stay_id and charttime between t0 and t1 where k is not null group by 1, 2, 3),
vt as (select stay_id, {", ".join(f"min(case when k = '{k}' then v end) as {k}0, max(case when k = '{k}' then v end) as {k}1" for k in ("hr", "bp", "rr", "te"))} from rm group by 1),
vn as (select * from ventilation where stay_id is not null and starttime is not null and endtime is not null and lower(trim(ventilation_status)) = 'invasivevent'),
mv as (select stay_id, (exists (select 1 from vn where vn.stay_id = w.stay_id and (starttime between t0 and t1 or endtime between t0 and t1 or (starttime <= t0 and endtime >= t1))))::int as mechvent from w),
al as (select fx.*, vt.* exclude (stay_id), gcs, urineoutput as uo, mechvent from fx left join vt using (stay_id) left join gc using (stay_id) left join uo using (stay_id) left join mv using (stay_id)),
sc as (select stay_id, case when preiculos < 10.2 then 5 when preiculos < 297 then 3 when preiculos < 1440 then 0 when preiculos < 18708 then 2 when preiculos is not null then 1 end as preiculos_score,
  case when age < 24 then 0 when age <= 53 then 3 when age <= 77 then 6 when age <= 89 then 9 when age is not null then 7 end as age_score,
  case when gcs <= 7 then 10 when gcs < 14 then 4 when gcs = 14 then 3 when gcs is not null then 0 end as gcs_score,
  case when hr1 > 125 then 6 when hr0 < 33 then 4 when hr1 between 107 and 125 then 3 when hr1 between 89 and 106 then 1 when hr1 is not null then 0 end as heart_rate_score,
  case when bp0 < 20.65 then 4 when bp0 < 51 then 3 when bp1 > 143.44 then 3 when bp0 >= 51 and bp0 < 61.33 then 2 when bp0 is not null then 0 end as mbp_score,
  case when rr0 < 6 then 10 when rr1 > 44 then 9 when rr1 > 30 then 6 when rr1 > 22 then 1 when rr0 < 13 then 1 when rr0 is not null then 0 end as resp_rate_score,
  case when te1 > 39.88 then 6 when te0 between 33.22 and 35.93 then 4 when te1 between 33.22 and 35.93 then 4 when te0 < 33.22 then 3 when te0 > 35.93 and te0 <= 36.39 then 2 when te1 between 36.89 and 39.88 then 2 when te1 is not null then 0 end as temperature_score,
  case when uo < 671.09 then 10 when uo > 6896.80 then 8 when uo between 671.09 and 1426.99 then 5 when uo between 1427 and 2544.14 then 1 when uo is not null then 0 end as urineoutput_score,
  case when mechvent = 1 then 9 when mechvent is not null then 0 end as mechvent_score, case when electivesurgery = 1 then 0 when electivesurgery is not null then 6 end as electivesurgery_score from al),
ac as (select *, coalesce(preiculos_score, 0) + coalesce(age_score, 0) + coalesce(gcs_score, 0) + coalesce(heart_rate_score, 0) + coalesce(mbp_score, 0) + coalesce(resp_rate_score, 0) + coalesce(temperature_score, 0) + coalesce(urineoutput_score, 0)
  + coalesce(mechvent_score, 0) + coalesce(electivesurgery_score, 0) as oasis from sc)"""


def acuity_coverage(spark, root):
    """How many stays have each part of the acuity score, their share, and its mean points."""
    from seriatim.operators import studies

    a = acuity_score(spark, root)
    return studies.coverage(a, [c for c in a.columns if c.endswith("_score")]).select("part", "n", F.round("share", 6).alias("share"), F.round("mean", 6).alias("mean"))


def acuity_without_age(spark, root):
    """Quartiles of the acuity score and of the score without its age part."""
    from seriatim.operators import studies

    return studies.without_part(acuity_score(spark, root), "stay_id", "oasis", "age_score").select("whole", "rest", "n", F.round("agree", 6).alias("agree"))


_PREFIXES = exposure.prefixes(exposure.CONDITIONS)


def _diagnoses(spark, root):
    """Stand-in diagnoses: each order line has the code at its place in the table of conditions, with a digit more."""
    li = table(spark, root, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey"])
    codes = F.broadcast(spark.createDataFrame([(i, p, v) for i, (_, _, v, p) in enumerate(_PREFIXES)], "i int, prefix string, version int"))  # a fixed table
    place = ((F.col("l_partkey") * 31 + F.col("l_linenumber") * 7) % (2 * len(_PREFIXES))).cast("int").alias("i")
    return li.select("l_orderkey", place).join(codes, "i").select("l_orderkey", F.concat("prefix", (F.col("l_orderkey") % 10).cast("string")).alias("code"), "version")


def comorbidity_index(spark, root):
    return exposure.charlson(_diagnoses(spark, root), "l_orderkey").select("l_orderkey", "score", "conditions")


def comorbidity_weights(spark, root):
    return exposure.charlson(_diagnoses(spark, root), "l_orderkey", "weights").select("l_orderkey", "score")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


_DX = f"""cd as (select * from (values {_values((i, p, v) for i, (_, _, v, p) in enumerate(_PREFIXES))}) as t(i, prefix, version)),
dx as (select distinct l_orderkey, prefix || (l_orderkey % 10)::varchar as code, version from lineitem join cd on i = (l_partkey * 31 + l_linenumber * 7) % {2 * len(_PREFIXES)})"""


def disposition(spark, root):
    """Ends of stays grouped, from a location that the unit's name stands in for; open stays count as died."""
    s = table(spark, root, "icustays", ["stay_id", "first_careunit", "outtime"]).where("stay_id is not null").groupBy("stay_id").agg(F.max("first_careunit").alias("u"), F.max("outtime").alias("o"))
    place = F.when(F.col("stay_id") % 4 == 0, "HOME HEALTH CARE").when(F.col("stay_id") % 4 == 1, "Skilled Nursing Facility").when(F.col("stay_id") % 4 == 2, F.col("u"))
    return s.select("stay_id", exposure.disposition(place, F.col("o").isNull().cast("int")).alias("disposition"))


def relabelled(spark, root):
    """Stays with their acuity quartile, relabelled by the organ score's; stays that have none are dropped."""
    a = strata.bins_by_rank(acuity_score(spark, root), "oasis", "stay_id", 4, "acuity").select("stay_id", "acuity")
    both, _ = exposure.relabelled(a, organ_quartile(spark, root), "stay_id", "quartile")
    return both.groupBy("acuity", "quartile").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (admission_facts, vasopressor_flag, first_day_output, coma_score, organ_score, organ_quartile, acuity_score, acuity_coverage, acuity_without_age, comorbidity_index, comorbidity_weights, disposition, relabelled)
}

_QUARTILE = """oq as (select stay_id, coag + renal as two, greatest(1, ceil(4.0 * (row_number() over (order by sofa3, stay_id) - 1) / (count(*) over () - 1)))::int as quartile from oo where coag is not null and renal is not null and sofa3 is not null)"""
_PARTS = ("preiculos", "age", "gcs", "heart_rate", "mbp", "resp_rate", "temperature", "urineoutput", "mechvent", "electivesurgery")
_EDGES = "list_distinct(quantile_cont({c}, [0.25, 0.5, 0.75])) as {e}, min({c}) as {e}lo, max({c}) as {e}hi"

ORACLE = {
    "admission_facts": f"{_STANDS}, {_FACTS} select * from fx",
    "vasopressor_flag": f"{_STANDS}, {_VASO} select * from vs",
    "first_day_output": f"{_STANDS}, {_OUTPUT} select stay_id, round(urineoutput, 4) as urineoutput from uo",
    "coma_score": f"{_STANDS}, {_COMA} select * from gc",
    "organ_score": f"{_STANDS}, {_ORGANS} select * from oo",
    "organ_quartile": f"{_STANDS}, {_ORGANS}, {_QUARTILE} select * from oq",
    "acuity_score": f"{_STANDS}, {_ACUITY} select * from ac",
    "acuity_coverage": f"{_STANDS}, {_ACUITY} " + " union all ".join(f"select '{p}_score' as part, count({p}_score) as n, round(count({p}_score) / count(*)::double, 6) as share, round(avg({p}_score), 6) as mean from ac" for p in _PARTS),
    "acuity_without_age": f"""{_STANDS}, {_ACUITY}, ed as (select {_EDGES.format(c="oasis", e="a")}, {_EDGES.format(c="oasis - coalesce(age_score, 0)", e="b")} from ac),
bb as (select 1 + len(list_filter(a, lambda x: x > alo and x < ahi and oasis > x)) as whole, 1 + len(list_filter(b, lambda x: x > blo and x < bhi and oasis - coalesce(age_score, 0) > x)) as rest from ac, ed)
select whole, rest, count(*) as n, round((select avg((whole = rest)::int) from bb), 6) as agree from bb group by 1, 2""",
    "comorbidity_index": f"""with {_DX}, cn as (select * from (values {_values((c, w, v, p) for c, w, v, p in _PREFIXES)}) as t(condition, weight, version, prefix)),
hs as (select distinct l_orderkey, condition, weight from dx join cn on dx.version = cn.version and starts_with(code, cn.prefix)),
sm as (select a.l_orderkey, sum(a.weight) as score, count(*) as conditions, sum(case when exists (select 1 from hs b where b.l_orderkey = a.l_orderkey and (a.condition, b.condition) in (('mild_liver', 'severe_liver'), ('diabetes_uncomplicated', 'diabetes_complicated'), ('malignancy', 'metastatic'))) then a.weight else 0 end) as over from hs a group by 1)
select l_orderkey, (score - over)::bigint as score, conditions from sm""",
    "comorbidity_weights": f"""with {_DX}, cn as (select * from (values {_values(exposure.prefixes(exposure.WEIGHTS))}) as t(condition, weight, version, prefix)),
hs as (select distinct l_orderkey, condition, weight, dx.version from dx join cn on dx.version = cn.version and substr(code, 1, 3) = cn.prefix)
select l_orderkey, sum(weight)::bigint as score from hs group by 1""",
    "disposition": """with s as (select stay_id, max(first_careunit) as u, max(outtime) as o from icustays where stay_id is not null group by 1),
l as (select stay_id, o, upper(coalesce(case stay_id % 4 when 0 then 'HOME HEALTH CARE' when 1 then 'Skilled Nursing Facility' when 2 then u end, 'UNKNOWN')) as loc from s)
select stay_id, case when o is null or regexp_matches(loc, 'DIED|EXPIRED') then 'died' when contains(loc, 'HOME') then 'home' when regexp_matches(loc, 'SKILLED|REHAB|NURSING|CHRONIC|HOSPICE|FACILITY|ACUTE|PSYCH') then 'facility' else 'other' end as disposition from l""",
    "relabelled": f"""{_STANDS}, {_ORGANS}, {_QUARTILE}, {_ACUITY},
aq as (select stay_id, greatest(1, ceil(4.0 * (row_number() over (order by oasis, stay_id) - 1) / (count(*) over () - 1)))::int as acuity from ac)
select acuity, quartile, count(*) as n from aq join oq using (stay_id) group by 1, 2""",
}
