"""Registered queries: joins, aggregations, windows and exposure scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriatim.operators import exposure, relational
from seriatim.sources.tables import micros, table


def r(c: str, digits: int = 4):
    return F.round(c, digits).alias(c)


def _stays(spark, root):
    return table(spark, root, "icustays").dropDuplicates(["stay_id"])


def scan_attrition(spark, root):
    s = table(spark, root, "icustays").where("stay_id is not null")
    once = s.groupBy("stay_id").agg(F.min("subject_id").alias("subject_id"), F.min("hadm_id").alias("hadm_id"), F.min("intime").alias("intime"), F.min("los").alias("los"), F.min("first_careunit").alias("unit"))
    long = once.where("los * 24 >= 12")
    first = relational.first_by(long, ["hadm_id"], [F.col("intime"), F.col("stay_id")], ["stay_id", "los", "unit"])
    unit = first.where(F.col("unit").rlike(r"\(MICU\)$"))
    return relational.attrition([("stays", once), ("12 hours", long), ("first of admission", first), ("unit", unit), ("72 hours", unit.where("los * 24 >= 72"))]).select("step", "name", "n")


def single_match_link(spark, root):
    link = relational.single_match(table(spark, root, "icustays"), "hadm_id", "stay_id")
    notes = table(spark, root, "discharge", ["note_id", "hadm_id"]).dropDuplicates(["note_id"])
    return notes.join(link, "hadm_id").select("note_id", "stay_id")


def longest_per_entity(spark, root):
    d = table(spark, root, "discharge", ["note_id", "hadm_id", "text"]).where("text is not null").withColumn("n_chars", F.length("text"))
    return relational.first_by(d, ["hadm_id"], [-F.col("n_chars"), F.col("note_id")], ["hadm_id", "note_id", "n_chars"])


def existence_gate(spark, root):
    return relational.dropped(table(spark, root, "documents", ["doc_id", "subject_id"]).where("subject_id is not null"), table(spark, root, "icustays", ["subject_id"]), "subject_id")


def full_outer_sets(spark, root):
    lab = table(spark, root, "labevents", ["subject_id", "itemid", "charttime"]).where("itemid = 50821 and charttime is not null").select("subject_id", F.to_date("charttime").alias("day")).distinct().withColumn("a", F.lit(1))
    chart = table(spark, root, "chartevents", ["subject_id", "itemid", "charttime"]).where("itemid = 223835 and charttime is not null").select("subject_id", F.to_date("charttime").alias("day")).distinct().withColumn("b", F.lit(1))
    both = lab.join(chart, ["subject_id", "day"], "full_outer")
    return both.groupBy("subject_id").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("lab_only"), F.count_if(F.col("a").isNull()).alias("chart_only"))


def first_day_minmax(spark, root):
    v = exposure.first_day_vitals(table(spark, root, "chartevents"), table(spark, root, "icustays"))
    return v.select("stay_id", *[r(c) for c in v.columns if c != "stay_id"])


def carry_forward_6h(spark, root):
    c = table(spark, root, "chartevents", ["stay_id", "itemid", "charttime", "valuenum"]).where("itemid in (220045, 220052, 220210) and stay_id is not null and charttime is not null")
    part = lambda i: F.max(F.when(F.col("itemid") == i, F.col("valuenum")))
    rows = c.groupBy("stay_id", F.date_trunc("hour", "charttime").alias("hour")).agg(part(220045).alias("hr"), part(220052).alias("bp"), part(220210).alias("rr"))
    t = exposure.carried_total(rows, "stay_id", "hour", {"hr": 80.0, "bp": 75.0, "rr": 16.0})
    return exposure.lowest(t, "stay_id", "hour", "total", ["hour"]).select("stay_id", "hour", r("total"))


def gap_islands_14h(spark, root):
    v = table(spark, root, "ventilation").dropna().select("stay_id", F.col("starttime").alias("time"), F.lower(F.trim("ventilation_status")).alias("status"))
    once = v.groupBy("stay_id", "time").agg(F.max("status").alias("status"))
    return exposure.state_islands(once, "stay_id", "time", "status")


def device_slots(spark, root):
    d = table(spark, root, "chartevents", ["subject_id", "charttime", "storetime", "itemid", "value"]).where("itemid = 226732 and value is not null and subject_id is not null and charttime is not null")
    return relational.slots(d, ["subject_id", "charttime"], "value", [F.col("storetime").desc_nulls_last(), F.col("value").desc()], 4, "dev")


def device_spells(spark, root):
    return exposure.ventilation_spells(table(spark, root, "chartevents"), gated=False)


def overlap_flag(spark, root):
    v = table(spark, root, "ventilation").dropna().where(F.lower(F.trim("ventilation_status")) == "invasivevent")
    w = exposure.windows(table(spark, root, "icustays"), "0 hours").drop("subject_id")
    return relational.overlaps(v, w, "stay_id", "starttime", "endtime", "t0", "t1").select("stay_id", "flag")


def item_resolve(spark, root):
    return relational.resolve(table(spark, root, "d_items"), exposure.LABELS, exposure.FLUIDS).select("key", "itemid")


def banded_score(spark, root):
    labs = table(spark, root, "labevents", ["subject_id", "itemid", "charttime", "valuenum"]).where(F.col("itemid").isin(*exposure.LABS.values()) & F.col("valuenum").isNotNull())
    name = F.element_at(F.create_map(*[x for k, v in exposure.LABS.items() for x in (F.lit(v), F.lit(k))]), F.col("itemid"))
    w = exposure.windows(table(spark, root, "icustays"), "0 hours")
    inside = relational.within(labs, w, "subject_id", "charttime", "t0", "t1").withColumn("measure", name)
    e = relational.extremes(inside, ["stay_id"], "measure", "valuenum", list(exposure.LABS))
    s = w.select("stay_id").join(e, "stay_id", "left").select("stay_id", exposure.coagulation(F.col("platelet_min")).alias("coag"), exposure.renal(F.col("creatinine_max")).alias("renal"), exposure.liver(F.col("bilirubin_max")).alias("liver"))
    return s.select("*", (F.col("coag") + F.col("renal") + F.col("liver")).alias("all_required"), (F.coalesce("coag", F.lit(0)) + F.coalesce("renal", F.lit(0)) + F.coalesce("liver", F.lit(0))).alias("filled"))


BRANDS = [("a", 1, 0, "Brand#1"), ("b", 2, 0, "Brand#2"), ("c", 3, 0, "Brand#3"), ("d", 6, 0, "Brand#21")]


def code_hierarchy_score(spark, root):
    li = table(spark, root, "lineitem", ["l_orderkey", "l_partkey"]).join(table(spark, root, "part", ["p_partkey", "p_brand"]), F.col("l_partkey") == F.col("p_partkey"))
    codes = li.select("l_orderkey", F.col("p_brand").alias("code"), F.lit(0).alias("version"))
    return exposure.code_score(codes, "l_orderkey", BRANDS, {"b": "d"}).select("l_orderkey", "score", "conditions")


def distinct_covariates(spark, root):
    li = table(spark, root, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate"]).join(table(spark, root, "orders", ["o_orderkey", "o_orderdate"]), F.col("l_orderkey") == F.col("o_orderkey"))
    lag = (micros("l_shipdate") - micros("o_orderdate")) / 3_600_000_000
    return li.groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"), F.round(F.max(lag), 4).alias("max_lag_hours"))


def value_counts(spark, root):
    return table(spark, root, "documents", ["genre", "lang"]).groupBy("genre", "lang").agg(F.count("*").alias("n"))


def signed_sums(spark, root):
    li = table(spark, root, "lineitem", ["l_returnflag", "l_quantity", "l_linestatus"])
    q = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return li.groupBy("l_linestatus").agg(F.round(F.sum(q), 2).alias("signed"), F.round(F.avg((F.col("l_quantity") > 25).cast("double")), 6).alias("share"), F.max((F.col("l_returnflag") == "A").cast("int")).alias("any_a"))


def set_equality(spark, root):
    o = table(spark, root, "orders", ["o_orderkey", "o_orderstatus", "o_orderdate"])
    return relational.same_rows(o.where("o_orderstatus <> 'P'").drop("o_orderdate"), o.where("o_orderstatus <> 'F' or o_orderdate >= '1996-01-01'").drop("o_orderdate"))


def topk_overlap(spark, root):
    """Share of the five highest-priced nations that two segments have in common, per pair of segments."""
    from pyspark.sql import Window

    c = table(spark, root, "customer", ["c_nationkey", "c_mktsegment", "c_acctbal"]).groupBy("c_mktsegment", "c_nationkey").agg(F.round(F.avg("c_acctbal"), 2).alias("m"))
    top = c.withColumn("k", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.col("m").desc(), "c_nationkey"))).where("k <= 5")
    a, b = top.select(F.col("c_mktsegment").alias("a"), "c_nationkey"), top.select(F.col("c_mktsegment").alias("b"), "c_nationkey")
    return a.join(b, "c_nationkey").where("a < b").groupBy("a", "b").agg((F.count("*") / 5).alias("overlap"))


def selection_regret(spark, root):
    """What choosing the best nation of one segment costs in another."""
    c = table(spark, root, "customer", ["c_nationkey", "c_mktsegment", "c_acctbal"]).groupBy("c_mktsegment", "c_nationkey").agg(F.round(F.avg("c_acctbal"), 2).alias("m"))
    best = c.groupBy("c_mktsegment").agg(F.max(F.struct("m", -F.col("c_nationkey"))).alias("b")).select(F.col("c_mktsegment").alias("source"), (-F.col("b.col2")).alias("c_nationkey"))
    own = c.groupBy(F.col("c_mktsegment").alias("target")).agg(F.max("m").alias("top"))
    there = c.withColumnRenamed("c_mktsegment", "target").join(best, "c_nationkey").join(own, "target").where("source <> target")
    return there.select("source", "target", F.round(F.col("top") - F.col("m"), 2).alias("regret"))


QUERIES = {f.__name__: f for f in (scan_attrition, single_match_link, longest_per_entity, existence_gate, full_outer_sets, first_day_minmax, carry_forward_6h, gap_islands_14h, device_slots, device_spells, overlap_flag, item_resolve, banded_score, code_hierarchy_score, distinct_covariates, value_counts, signed_sums, set_equality, topk_overlap, selection_regret)}

_WIN = "w as (select stay_id, min(subject_id) as subject_id, min(intime) - interval {b} hour as t0, min(intime) + interval 24 hour as t1 from icustays where stay_id is not null and intime is not null group by 1)"
_SEG = "c as (select c_mktsegment, c_nationkey, round(avg(c_acctbal), 2) as m from customer group by 1, 2)"


def _islands(rows: str) -> str:
    return f"""{rows},
a as (select *, lag(t) over (partition by stay_id, status order by t) as own, lead(t) over (partition by stay_id order by t) as nx, lag(status) over (partition by stay_id order by t) as pr from x),
b as (select *, case when pr is null or floor((epoch_us(t) - epoch_us(own)) / 3600000000.0) >= 14 or pr <> status then 1 else 0 end as nw, case when nx is null or floor((epoch_us(nx) - epoch_us(t)) / 3600000000.0) >= 14 then t else nx end as e from a),
c as (select *, sum(nw) over (partition by stay_id order by t rows unbounded preceding) as seq from b)
select stay_id, min(t) as starttime, max(e) as endtime, max(status) as status from c group by stay_id, seq having min(t) <> max(t)"""


_SLOTS = "d as (select *, row_number() over (partition by subject_id, charttime order by storetime desc nulls last, value desc) as k from chartevents where itemid = 226732 and value is not null and subject_id is not null and charttime is not null)"

ORACLE = {
    "scan_attrition": """with o as (select stay_id, min(subject_id) as subject_id, min(hadm_id) as hadm_id, min(intime) as intime, min(los) as los, min(first_careunit) as unit from icustays where stay_id is not null group by 1),
l as (select * from o where los * 24 >= 12), f as (select * from (select *, row_number() over (partition by hadm_id order by intime nulls first, stay_id) as k from l) where k = 1), u as (select * from f where regexp_matches(unit, '\\(MICU\\)$'))
select 0 as step, 'stays' as name, count(*) as n from o union all select 1, '12 hours', count(*) from l union all select 2, 'first of admission', count(*) from f union all select 3, 'unit', count(*) from u union all select 4, '72 hours', count(*) from u where los * 24 >= 72""",
    "single_match_link": "with l as (select hadm_id, min(stay_id) as stay_id from icustays where hadm_id is not null and stay_id is not null group by 1 having count(distinct stay_id) = 1) select distinct note_id, stay_id from discharge join l using (hadm_id)",
    "longest_per_entity": "select hadm_id, note_id, length(text)::int as n_chars from (select *, row_number() over (partition by hadm_id order by length(text) desc, note_id) as k from discharge where text is not null) where k = 1",
    "existence_gate": "select count(*) filter (where subject_id in (select subject_id from icustays)) as kept, count(*) filter (where subject_id not in (select subject_id from icustays where subject_id is not null)) as dropped from documents where subject_id is not null",
    "full_outer_sets": """with a as (select distinct subject_id, charttime::date as day from labevents where itemid = 50821 and charttime is not null), b as (select distinct subject_id, charttime::date as day from chartevents where itemid = 223835 and charttime is not null)
select coalesce(a.subject_id, b.subject_id) as subject_id, count(*) filter (where a.day is not null and b.day is not null) as "both", count(*) filter (where b.day is null) as lab_only, count(*) filter (where a.day is null) as chart_only from a full outer join b on a.subject_id = b.subject_id and a.day = b.day group by 1""",
    "first_day_minmax": f"""with {_WIN.format(b=6)}, v as (select stay_id, charttime, case when itemid = 220045 and valuenum > 0 and valuenum < 300 then 'heart_rate' when itemid in (220052, 220181, 225312) and valuenum > 0 and valuenum < 300 then 'mbp' when itemid in (220210, 224690) and valuenum > 0 and valuenum < 70 then 'resp_rate'
when itemid = 223761 and valuenum > 70 and valuenum < 120 then 'temperature' when itemid = 223762 and valuenum > 10 and valuenum < 50 then 'temperature' end as m, case when itemid = 223761 then (valuenum - 32) / 1.8 else valuenum end as v from chartevents),
p as (select v.stay_id, charttime, m, case when m = 'temperature' then round(avg(v), 2) else avg(v) end as v from v join w on v.stay_id = w.stay_id and charttime between t0 and t1 where m is not null group by 1, 2, 3)
select stay_id, {", ".join(f"round({f}(case when m = '{m}' then v end), 4) as {m}_{f}" for m in ("heart_rate", "mbp", "resp_rate", "temperature") for f in ("min", "max"))} from p group by 1""",
    "carry_forward_6h": """with x as (select stay_id, date_trunc('hour', charttime) as hour, max(case when itemid = 220045 then valuenum end) as hr, max(case when itemid = 220052 then valuenum end) as bp, max(case when itemid = 220210 then valuenum end) as rr from chartevents where itemid in (220045, 220052, 220210) and stay_id is not null and charttime is not null group by 1, 2),
f as (select *, lag(hour) over s > hour - interval 6 hour as fresh, lag(hr) over s as p1, lag(bp) over s as p2, lag(rr) over s as p3 from x window s as (partition by stay_id order by hour)),
t as (select stay_id, hour, coalesce(hr, case when fresh then p1 end, 80) + coalesce(bp, case when fresh then p2 end, 75) + coalesce(rr, case when fresh then p3 end, 16) as total from f)
select stay_id, hour, round(total, 4) as total from (select *, row_number() over (partition by stay_id order by total, hour desc) as k from t) where k = 1""",
    "gap_islands_14h": _islands("with x as (select stay_id, starttime as t, max(lower(trim(ventilation_status))) as status from ventilation where stay_id is not null and starttime is not null and endtime is not null and ventilation_status is not null group by 1, 2)"),
    "device_slots": f"with {_SLOTS} select subject_id, charttime, {', '.join(f'max(case when k = {i} then value end) as dev{i}' for i in range(1, 5))} from d where k <= 4 group by 1, 2",
    "device_spells": _islands(f"""with {_SLOTS}, s as (select subject_id, charttime, max(stay_id) as stay_id, {', '.join(f'max(case when k = {i} then value end) as d{i}' for i in range(1, 5))} from d group by 1, 2),
x as (select stay_id, charttime as t, case when d1 in ('Tracheostomy tube', 'Trach mask ') then 'Tracheostomy' when d1 = 'Endotracheal tube' then 'InvasiveVent' when d1 in ('Bipap mask ', 'CPAP mask ') or d2 in ('Bipap mask ', 'CPAP mask ') or d3 in ('Bipap mask ', 'CPAP mask ') or d4 in ('Bipap mask ', 'CPAP mask ') then 'NonInvasiveVent'
when d1 = 'High flow nasal cannula' then 'HFNC' when d1 in ('Non-rebreather', 'Face tent', 'Aerosol-cool', 'Venti mask ', 'Medium conc mask ', 'Ultrasonic neb', 'Vapomist', 'Oxymizer', 'High flow neb', 'Nasal cannula') then 'SupplementalOxygen' when d1 = 'None' then 'None' end as status from s where stay_id is not null and status is not null)"""),
    "overlap_flag": f"""with {_WIN.format(b=0)}, v as (select * from ventilation where stay_id is not null and starttime is not null and endtime is not null and lower(trim(ventilation_status)) = 'invasivevent')
select stay_id, (exists (select 1 from v where v.stay_id = w.stay_id and (starttime between t0 and t1 or endtime between t0 and t1 or (starttime <= t0 and endtime >= t1))))::int as flag from w""",
    "item_resolve": " union all ".join(f"select '{k}' as key, itemid from d_items where regexp_matches(coalesce(label, ''), '{p}', 'i')" + (" and contains(lower(coalesce(fluid, '')), 'blood') and contains(lower(coalesce(category, '')), 'blood gas')" if k == "pao2" else "") for k, p in exposure.LABELS.items()),
    "banded_score": f"""with {_WIN.format(b=0)}, x as (select w.stay_id, min(case when itemid = 51265 then valuenum end) as p, max(case when itemid = 50912 then valuenum end) as c, max(case when itemid = 50885 then valuenum end) as b from w left join labevents l on l.subject_id = w.subject_id and charttime between t0 and t1 and itemid in (51265, 50912, 50885) group by 1),
s as (select stay_id, case when p < 20 then 4 when p < 50 then 3 when p < 100 then 2 when p < 150 then 1 when p >= 150 then 0 end as coag, case when c >= 5 then 4 when c >= 3.5 then 3 when c >= 2 then 2 when c >= 1.2 then 1 when c < 1.2 then 0 end as renal, case when b >= 12 then 4 when b >= 6 then 3 when b >= 2 then 2 when b >= 1.2 then 1 when b < 1.2 then 0 end as liver from x)
select *, coag + renal + liver as all_required, coalesce(coag, 0) + coalesce(renal, 0) + coalesce(liver, 0) as filled from s""",
    "code_hierarchy_score": """with x as (select l_orderkey, max((p_brand like 'Brand#1%')::int) as a, max((p_brand like 'Brand#2%')::int) as b, max((p_brand like 'Brand#3%')::int) as c, max((p_brand like 'Brand#21%')::int) as d from lineitem join part on l_partkey = p_partkey group by 1)
select l_orderkey, (a + (case when d = 1 then 0 else 2 * b end) + 3 * c + 6 * d)::bigint as score, (a + b + c + d)::bigint as conditions from x where a + b + c + d > 0""",
    "distinct_covariates": "select l_orderkey, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers, round(max((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3600000000.0), 4) as max_lag_hours from lineitem join orders on l_orderkey = o_orderkey group by 1",
    "value_counts": "select genre, lang, count(*) as n from documents group by 1, 2",
    "signed_sums": "select l_linestatus, round(sum(case when l_returnflag = 'R' then -l_quantity else l_quantity end), 2) as signed, round(avg((l_quantity > 25)::int), 6) as share, max((l_returnflag = 'A')::int) as any_a from lineitem group by 1",
    "set_equality": "select (select count(*) from (select o_orderkey, o_orderstatus from orders where o_orderstatus <> 'P' except all select o_orderkey, o_orderstatus from orders where o_orderstatus <> 'F' or o_orderdate >= '1996-01-01')) as only_left, (select count(*) from (select o_orderkey, o_orderstatus from orders where o_orderstatus <> 'F' or o_orderdate >= '1996-01-01' except all select o_orderkey, o_orderstatus from orders where o_orderstatus <> 'P')) as only_right",
    "topk_overlap": f"with {_SEG}, t as (select * from (select *, row_number() over (partition by c_mktsegment order by m desc, c_nationkey) as k from c) where k <= 5) select x.c_mktsegment as a, y.c_mktsegment as b, count(*) / 5.0 as overlap from t x join t y on x.c_nationkey = y.c_nationkey and x.c_mktsegment < y.c_mktsegment group by 1, 2",
    "selection_regret": f"with {_SEG}, b as (select c_mktsegment as source, c_nationkey from (select *, row_number() over (partition by c_mktsegment order by m desc, c_nationkey) as k from c) where k = 1), o as (select c_mktsegment as target, max(m) as top from c group by 1) select source, target, round(top - m, 2) as regret from b join c using (c_nationkey) join o on o.target = c.c_mktsegment where source <> target",
}
