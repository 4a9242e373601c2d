"""Registered queries: strata, sampling, inference and resampling, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriatim.operators import infer, resample, strata, studies
from seriatim.sources.tables import table

REPLICATES = 2000


def r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


def _orders(spark: SparkSession, root: str) -> DataFrame:
    """Orders as outcomes: y, stratum 1-4 from the priority, cluster = customer."""
    o = table(spark, root, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderdate"])
    level = F.least(F.lit(4), F.substring("o_orderpriority", 1, 1).cast("int"))
    return o.select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 1000).alias("y"), level.alias("q"), F.dayofyear("o_orderdate").cast("double").alias("day"), F.month("o_orderdate").cast("double").alias("month"))


ORDERS = "o as (select o_orderkey, o_custkey, o_totalprice / 1000 as y, least(4, cast(substr(o_orderpriority, 1, 1) as int)) as q, dayofyear(o_orderdate)::double as day, month(o_orderdate)::double as month from orders)"


def quartile_by_value(spark, root):
    return strata.bins_by_value(table(spark, root, "customer", ["c_custkey", "c_acctbal"]), "c_acctbal", 4).select("c_custkey", "bin")


def quartile_by_rank(spark, root):
    return strata.bins_by_rank(table(spark, root, "orders", ["o_orderkey", "o_totalprice"]), "o_totalprice", "o_orderkey", 4).select("o_orderkey", "bin")


def crosstab_agreement(spark, root):
    c = table(spark, root, "customer", ["c_custkey", "c_acctbal"])
    both = strata.bins_by_rank(strata.bins_by_value(c, "c_acctbal", 4, "by_value"), "c_acctbal", "c_custkey", 4, "by_rank")
    return strata.agreement(both, "by_value", "by_rank").withColumn("agree", F.round("agree", 6))


def equal_n_sample(spark, root):
    return strata.equal_n(table(spark, root, "documents", ["doc_id", "genre"]).where("genre is not null"), "genre", "doc_id").select("doc_id", "genre")


def cem_length_matched(spark, root):
    d = table(spark, root, "documents", ["doc_id", "genre", "n_chars"]).where("genre is not null and n_chars is not null")
    return strata.matched(d, "genre", "n_chars", "doc_id").select("doc_id", "genre", "bin")


def slope_cr1(spark, root):
    return infer.slope(_orders(spark, root), "y", "q", "o_custkey").select("n", "clusters", r("beta"), r("se"), r("z", 4))


def slope_cr1_by_group(spark, root):
    o = _orders(spark, root).withColumn("grp", (F.col("month") <= 6).cast("int"))
    return infer.slope(o, "y", "q", "o_custkey", ["grp"]).select("grp", "n", "clusters", r("beta"), r("se"))


def stratum_means_cr1(spark, root):
    return infer.stratum_means(_orders(spark, root), "y", "q", "o_custkey").select("stratum", "n", "clusters", r("mean"), r("se"))


def ols2_cr1(spark, root):
    fit = infer.ols(_orders(spark, root), "y", ["q", "day"], "o_custkey")
    rows = [(n, round(b, 6), round(se, 6)) for n, b, se, *_ in fit.table() if n != "const"]
    return spark.createDataFrame(rows, "term string, beta double, se double")


def ols_many_cr1(spark, root):
    fit = infer.ols(_orders(spark, root), "y", ["q", "day", "month"], "o_custkey")
    return spark.createDataFrame([(t, round(b, 6), round(se, 6), round(z, 4)) for t, b, se, z, *_ in fit.table() if t != "const"], "term string, beta double, se double, z double")


def linearity_wald(spark, root):
    w, df, p = infer.linearity(_orders(spark, root), "y", "q", "o_custkey")
    return spark.createDataFrame([(round(w, 4), df)], "wald double, df int")


def pooled_wald(spark, root):
    """Two outcomes stacked: does the slope on the stratum differ between them (interaction, fixed effects)?"""
    o = _orders(spark, root)
    a = o.select("y", "q", "o_custkey", F.lit(0.0).alias("second"))
    b = o.select((F.col("y") * 0.5 + F.col("day")).alias("y"), "q", "o_custkey", F.lit(1.0).alias("second"))
    stacked = a.unionByName(b).withColumn("both", F.col("q") * F.col("second"))
    fit = infer.ols(stacked, "y", ["q", "second", "both"], "o_custkey")
    import numpy as np

    w, df, p = infer.wald(fit, np.array([[0.0, 0, 0, 1]]))
    return spark.createDataFrame([(round(float(fit.beta[3]), 6), round(w, 4), df)], "interaction double, wald double, df int")


def quartile_contrasts(spark, root):
    rows = infer.contrasts(_orders(spark, root), "y", "q", "o_custkey")
    return spark.createDataFrame([(q, round(b, 6), round(se, 6)) for q, b, se, _ in rows], "level int, beta double, se double")


def mediators_adjusted(spark, root):
    """The stratum's slope before and after a flag and a log duration with gaps, both following the order."""
    o = _orders(spark, root).withColumn("late", (F.col("month") > 9).cast("int")).withColumn("days", F.when(F.col("day") % 5 != 0, F.col("day")))
    a = studies.adjusted(o, "y", "q", "o_custkey", ["late"], ["days"])
    return spark.createDataFrame([(round(a["before"], 6), round(a["after"], 6), round(a["se"], 6), round(a["attenuation"], 3))], "before double, after double, se double, attenuation double")


def holm_adjust(spark, root):
    """P values of the months' slopes, adjusted within each half of the year; the oracle shares the P table's recipe."""
    n = table(spark, root, "nation", ["n_nationkey", "n_regionkey"])
    p = n.select("n_nationkey", "n_regionkey", (((F.col("n_nationkey") * 37 + 11) % 101) / 400.0).alias("p"))
    return infer.holm(p, "p", ["n_regionkey"]).select("n_nationkey", "n_regionkey", r("p_holm"))


def logrank_ranks(spark, root):
    return infer.logrank_table(_orders(spark, root), "day", "q").select("stratum", "n", r("observed", 4), r("expected", 4), r("variance", 4))


def auroc_midrank(spark, root):
    o = _orders(spark, root).withColumn("hit", (F.col("q") >= 3).cast("int"))
    return infer.auroc(o, "hit", "day").select("n1", "n0", r("auroc"))


def spearman_midrank(spark, root):
    return infer.spearman(_orders(spark, root), "day", "q").select("n", r("rho"))


def kendall_tau(spark, root):
    c = table(spark, root, "customer", ["c_nationkey", "c_acctbal", "c_custkey"])
    per = c.groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 2).alias("a"), F.count("*").alias("b"))
    return infer.kendall(per, "c_nationkey", "a", "b").select("pairs", r("tau"))


def logit_hit(spark, root):
    o = _orders(spark, root).withColumn("hit", (F.col("y") > 250).cast("int"))
    rows = [(t, round(b, 6), round(se, 6), round(z, 4)) for t, b, se, z, *_ in infer.logit(o, "hit", "q", "o_custkey").table()]
    return spark.createDataFrame(rows, "term string, beta double, se double, z double")


def eta2_cube(spark, root):
    li = table(spark, root, "lineitem", ["l_returnflag", "l_linestatus", "l_linenumber", "l_extendedprice"])
    return infer.eta2(li, "l_extendedprice", ["l_linenumber", "l_returnflag", "l_linestatus"]).select("effect", r("share"))


def vif(spark, root):
    return spark.createDataFrame([(c, round(v, 6)) for c, v in infer.inflation(_orders(spark, root), ["q", "day", "month"])], "term string, vif double")


def attenuation(spark, root):
    rows = infer.conditioned(_orders(spark, root), "y", "q", ["day", "month"], "o_custkey")
    return spark.createDataFrame([(x["given"], round(x["beta"], 6), x["n"]) for x in rows], "given string, beta double, n bigint")


def boot_cluster_mean(spark, root):
    return resample.cluster_mean(_orders(spark, root), "y", "o_custkey", REPLICATES).select("contrast", r("point"), "b", r("lo"), r("hi"), r("sd"))


def boot_paired_clusters(spark, root):
    o = _orders(spark, root).withColumn("other", F.col("day"))
    return resample.paired_slopes(o, "q", "y", "other", "o_custkey", REPLICATES).select("contrast", r("point"), "b", r("lo", 5), r("hi", 5), r("sd", 5), r("p"))


def logrank_trend(spark, root):
    g = infer.logrank(_orders(spark, root), "day", "q", (1, 2, 3, 4))
    return spark.createDataFrame([(round(g["x2"], 4), g["df"], round(g["z"], 4))], "x2 double, df int, z double")


def series_summary(spark, root):
    s = studies.series(_orders(spark, root), "y", "q", "o_custkey")
    return s.select("n", *[r(c, 5) for c in ("q1", "q2", "q3", "q4", "decline", "beta", "se", "relative")])


def series_by_month(spark, root):
    s = studies.series(_orders(spark, root), "y", "q", "o_custkey", ["month"])
    return s.select("month", "n", *[r(c, 5) for c in ("q1", "q4", "decline", "beta")])


def mediation_triple(spark, root):
    m = studies.mediation(_orders(spark, root), "y", "q", "day", "o_custkey")
    return spark.createDataFrame([(round(m["stratum"], 6), round(m["mediator"], 6), round(m["joint"][0], 6), round(m["correlation"], 6))], "stratum double, mediator double, joint double, correlation double")


def retriever_interaction(spark, root):
    o = _orders(spark, root)
    stacked = o.select(F.col("y").alias("v"), "q", "o_custkey", F.lit("a").alias("model")).unionByName(o.select(F.col("day").alias("v"), "q", "o_custkey", F.lit("b").alias("model"))).unionByName(o.select((F.col("month") * 20).alias("v"), "q", "o_custkey", F.lit("c").alias("model")))
    _, (w, df, p) = studies.retrievers(stacked, "v", "model", "q", "o_custkey")
    return spark.createDataFrame([(round(w, 4), df)], "wald double, df int")


def exposure_contrast(spark, root):
    return studies.exposures_compared(_orders(spark, root), "y", "q", "month", "o_custkey", REPLICATES).select("contrast", r("point"), "b", r("lo", 5), r("hi", 5))


def best_in_replicate(spark, root):
    o = _orders(spark, root).withColumn("m20", F.col("month") * 20)
    return studies.best_in_replicate(o, "y", ["day", "m20"], "o_custkey", REPLICATES).select("contrast", r("point"), "b", r("lo", 5), r("hi", 5))


def auroc_interval(spark, root):
    o = _orders(spark, root).withColumn("hit", (F.col("q") >= 3).cast("int"))
    return studies.auroc_interval(o, "hit", "day", "o_orderkey", REPLICATES).select("contrast", r("point"), "b", r("lo", 5), r("hi", 5), r("sd", 5))


def endpoints_by_quartile(spark, root):
    s = table(spark, root, "icustays", ["stay_id", "los", "outtime"]).where("stay_id is not null").groupBy("stay_id").agg(F.max("los").alias("los"), F.max(F.col("outtime").isNull().cast("int")).alias("open"))
    q = strata.bins_by_rank(s, "los", "stay_id", 4, "quartile")
    return studies.endpoints(q, "quartile", "open", "los").select("quartile", "n", r("share"), r("median", 4), r("p25", 4), r("p75", 4))


def score_without_part(spark, root):
    o = _orders(spark, root).withColumn("score", F.floor(F.col("y") / 50) + F.col("q"))
    return studies.without_part(o, "o_orderkey", "score", "q").select("whole", "rest", "n", r("agree"))


QUERIES = {f.__name__: f for f in (logrank_trend, series_summary, series_by_month, mediation_triple, retriever_interaction, exposure_contrast, best_in_replicate, auroc_interval, endpoints_by_quartile, score_without_part, quartile_by_value, quartile_by_rank, crosstab_agreement, equal_n_sample, cem_length_matched, slope_cr1, slope_cr1_by_group, stratum_means_cr1, ols2_cr1, ols_many_cr1, linearity_wald, quartile_contrasts, mediators_adjusted, pooled_wald, holm_adjust, logrank_ranks, auroc_midrank, spearman_midrank, kendall_tau, logit_hit, eta2_cube, vif, attenuation, boot_cluster_mean, boot_paired_clusters)}

_EDGES = "select quantile_cont(c_acctbal, 0.25) as a, quantile_cont(c_acctbal, 0.5) as b, quantile_cont(c_acctbal, 0.75) as c, min(c_acctbal) as lo, max(c_acctbal) as hi from customer"
_MEANS = """, per as (select q, o_custkey, count(*) as n, sum(y) as sy from o group by 1, 2),
t as (select q, sum(n) as tn, sum(sy) as tsy, count(*) as g from per group by 1)"""
_SLOPE = """, {per} per as (select {k} o_custkey, count(*)::double as n, sum(q) as sx, sum(y) as sy, sum(q * q) as sxx, sum(q * y) as sxy from o group by {g} o_custkey),
t as (select {k} sum(n) as tn, count(*) as g, sum(sx) / sum(n) as mx, sum(sy) / sum(n) as my, sum(sxx) - sum(sx) * sum(sx) / sum(n) as xx, (sum(sxy) - sum(sx) * sum(sy) / sum(n)) / (sum(sxx) - sum(sx) * sum(sx) / sum(n)) as beta from per {gg}),
e as (select {ok} o.o_custkey, sum((o.q - t.mx) * (o.y - t.my - t.beta * (o.q - t.mx))) as u from o join t on {on} group by {ok} o.o_custkey),
m as (select {k} sum(u * u) as meat from e {gg})
"""
_ONE = dict(per="", k="", g="", gg="", ok="", on="true")
_GRP = dict(per="", k="grp,", g="grp,", gg="group by grp", ok="o.grp,", on="o.grp = t.grp")


def weighed(keys: str, replicates: int = REPLICATES) -> str:
    """CTE w: rep, k, mult (over 0) of the keys of a table's column k, by the documented hash."""
    at_least = " + ".join(f"(x >= {b})::int" for b in resample.BOUNDS)
    a, b, c, d = resample.FACTORS
    return f"""h0 as (select rep::ubigint as rep, k, (((k % 4294967296)::ubigint * {a}) % 4294967296 + (rep::ubigint * {b}) % 4294967296) % 4294967296 as x from (select distinct k from {keys}), range({replicates}) as a(rep)),
h1 as (select rep, k, (xor(x, x >> 16) * {c}) % 4294967296 as x from h0), h2 as (select rep, k, (xor(x, x >> 15) * {d}) % 4294967296 as x from h1), h3 as (select rep, k, xor(x, x >> 16) as x from h2),
w as (select rep, k, {at_least} as mult from h3 where x >= {resample.BOUNDS[0]})"""


_DRAWS = "c as (select distinct o_custkey, o_custkey as k from o), " + weighed("c")
_SLOPES = ", ".join(f"(sum(sxy_{y} * m) - sum(sx * m) * sum(sy_{y} * m) / sum(n * m)) / (sum(sxx * m) - sum(sx * m) * sum(sx * m) / sum(n * m)) as b_{y}, sum(s1_{y} * m) / sum(n1 * m) as m_{y}" for y in ("y", "day"))


def _ci(point: str, reps: str, name: str, digits: int) -> str:
    return f"select '{name}' as contrast, round({point}, 6) as point, count(v) as b, round(quantile_cont(v, 0.025), {digits}) as lo, round(quantile_cont(v, 0.975), {digits}) as hi, round(stddev_samp(v), {digits}) as sd{{p}} from {reps}"


_TREND = """, ts as (select distinct day as t from o), gs as (select distinct q as g from o),
ats as (select t, g, (select count(*) from o where day >= t and q = g)::double as nr, (select count(*) from o where day = t and q = g) as d, (select count(*) from o where day = t)::double as dt, (select count(*) from o where day >= t)::double as nt from ts, gs),
f as (select *, case when nt > 1 then dt * (nt - dt) / (nt - 1) / (nt * nt) else 0 end as f from ats), oe as (select g, sum(d) - sum(dt * nr / nt) as gap from ats group by 1),
v as (select a.g as i, b.g as j, sum(a.f * a.nr * ((case when a.g = b.g then a.nt else 0 end) - b.nr)) as v from f a join f b using (t) group by 1, 2),
m as (select max(v) filter (where i = 1 and j = 1) as a, max(v) filter (where i = 1 and j = 2) as b, max(v) filter (where i = 1 and j = 3) as c, max(v) filter (where i = 2 and j = 2) as d, max(v) filter (where i = 2 and j = 3) as e, max(v) filter (where i = 3 and j = 3) as f from v),
x as (select max(gap) filter (where g = 1) as x, max(gap) filter (where g = 2) as y, max(gap) filter (where g = 3) as z from oe)
select round((x * x * (d * f - e * e) + y * y * (a * f - c * c) + z * z * (a * d - b * b) + 2 * x * y * (c * e - b * f) + 2 * x * z * (b * e - c * d) + 2 * y * z * (b * c - a * e)) / (a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)), 4) as x2, 3 as df,
  round((select sum(g * gap) from oe) / sqrt((select sum(i * j * v) from v)), 4) as z from m, x"""
_QM = ", ".join(f"avg(case when q = {k} then y end) as q{k}" for k in (1, 2, 3, 4))



def three(rows: str, y: str, xs: tuple[str, str, str], cluster: str) -> str:
    """CTEs of a regression of y on three columns: b (beta of each), v (CR1 variance of each), by centred columns and the adjugate of their 3 x 3 matrix."""
    a, b, c = xs
    s = lambda p, q: f"sum(({p} - m{p}) * ({q} - m{q}))"
    return f"""mm as (select avg({a}) as m{a}, avg({b}) as m{b}, avg({c}) as m{c}, avg({y}) as m{y}, count(*) as n, count(distinct {cluster}) as g from {rows}),
ss as (select {s(a, a)} as aa, {s(a, b)} as ab, {s(a, c)} as ac, {s(b, b)} as bb, {s(b, c)} as bc, {s(c, c)} as cc, {s(a, y)} as ay, {s(b, y)} as by_, {s(c, y)} as cy from {rows}, mm),
iv as (select *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) as det, bb * cc - bc * bc as i11, ac * bc - ab * cc as i12, ab * bc - ac * bb as i13, aa * cc - ac * ac as i22, ab * ac - aa * bc as i23, aa * bb - ab * ab as i33 from ss),
b as (select (i11 * ay + i12 * by_ + i13 * cy) / det as b1, (i12 * ay + i22 * by_ + i23 * cy) / det as b2, (i13 * ay + i23 * by_ + i33 * cy) / det as b3 from iv),
rs as (select {cluster} as cl, {a} - m{a} as a, {b} - m{b} as b, {c} - m{c} as c, {y} - m{y} - b1 * ({a} - m{a}) - b2 * ({b} - m{b}) - b3 * ({c} - m{c}) as e from {rows}, mm, b),
us as (select sum(a * e) as u1, sum(b * e) as u2, sum(c * e) as u3 from rs group by cl),
v as (select max(g / (g - 1.0) * (n - 1) / (n - 4)) * sum(pow((i11 * u1 + i12 * u2 + i13 * u3) / det, 2)) as v1, max(g / (g - 1.0) * (n - 1) / (n - 4)) * sum(pow((i12 * u1 + i22 * u2 + i23 * u3) / det, 2)) as v2,
  max(g / (g - 1.0) * (n - 1) / (n - 4)) * sum(pow((i13 * u1 + i23 * u2 + i33 * u3) / det, 2)) as v3 from us, iv, mm)"""


_MODELS = ("y", "day", "month * 20")

ORACLE = {
    "ols_many_cr1": f"with {ORDERS}, {three('o', 'y', ('q', 'day', 'month'), 'o_custkey')} " + " union all ".join(f"select '{t}' as term, round(b{i}, 6) as beta, round(sqrt(v{i}), 6) as se, round(b{i} / sqrt(v{i}), 4) as z from b, v" for i, t in ((1, "q"), (2, "day"), (3, "month"))),
    "quartile_contrasts": f"""with {ORDERS}, mq as (select q, count(*) as n, avg(y) as m from o group by 1), p as (select o_custkey as c, q, sum((y - m) / n) as psi from o join mq using (q) group by 1, 2),
lv as (select unnest([2, 3, 4]) as level), cl as (select distinct c from p), d as (select level, cl.c, coalesce(max(psi) filter (where q = level), 0) - coalesce(max(psi) filter (where q = 1), 0) as d from lv, cl left join p on p.c = cl.c group by 1, 2),
v as (select level, sum(d * d) * count(*) / (count(*) - 1.0) as s from d group by 1), nn as (select count(*) as all_rows from o)
select level, round(a.m - b.m, 6) as beta, round(sqrt(s * (all_rows - 1) / (all_rows - 4)), 6) as se from v join mq a on a.q = level, mq b, nn where b.q = 1""",
    "mediators_adjusted": f"""with {ORDERS}, md as (select median(day) as m from o where day % 5 <> 0), st as (select y, q, (month > 9)::int::double as late, ln(1 + case when day % 5 <> 0 then day else m end) as days, o_custkey from o, md),
{three('st', 'y', ('q', 'late', 'days'), 'o_custkey')} select round(regr_slope(y, q), 6) as before, round(max(b1), 6) as after, round(sqrt(max(v1)), 6) as se, round(100 * (1 - max(b1) / regr_slope(y, q)), 3) as attenuation from st, b, v""",
    "pooled_wald": f"""with {ORDERS}, st as (select y, q, o_custkey, 0.0::double as second, 0.0::double as inter from o union all select y * 0.5 + day, q, o_custkey, 1.0, q from o),
{three('st', 'y', ('q', 'second', 'inter'), 'o_custkey')} select round(b3, 6) as interaction, round(b3 * b3 / v3, 4) as wald, 1 as df from b, v""",
    "retriever_interaction": f"""with {ORDERS}, st as ({" union all ".join(f"select {m} as v, q::double as x, o_custkey as c, {i} as m from o" for i, m in enumerate(_MODELS))}),
f as (select m, avg(x) as mx, avg(v) as mv, sum(x * x) - sum(x) * avg(x) as xx, (sum(x * v) - sum(x) * avg(v)) / (sum(x * x) - sum(x) * avg(x)) as b from st group by 1),
p as (select c, m, sum((x - mx) * (v - mv - b * (x - mx)) / xx) as psi from st join f using (m) group by 1, 2),
q as (select c, coalesce(max(psi) filter (where m = 1), 0) - coalesce(max(psi) filter (where m = 0), 0) as d1, coalesce(max(psi) filter (where m = 2), 0) - coalesce(max(psi) filter (where m = 0), 0) as d2 from p group by 1),
k as (select count(*) as g, sum(d1 * d1) as a, sum(d1 * d2) as b, sum(d2 * d2) as d from q), t as (select count(*) as n from st),
e as (select max(b) filter (where m = 1) - max(b) filter (where m = 0) as e1, max(b) filter (where m = 2) - max(b) filter (where m = 0) as e2 from f)
select round((e1 * e1 * d - 2 * e1 * e2 * b + e2 * e2 * a) / (a * d - b * b) / (g / (g - 1.0) * (n - 1) / (n - 6)), 4) as wald, 2 as df from e, k, t""",
    "logit_hit": f"""with recursive {ORDERS}, ce as (select q::double as x, count(*)::double as n, sum((y > 250)::int)::double as s from o group by 1),
it as (select 0 as i, 0.0::double as b0, 0.0::double as b1 union all
  select i + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) from (
    select i, b0, b1, sum(s - n * p) as g0, sum(x * (s - n * p)) as g1, sum(n * p * (1 - p)) as h00, sum(n * x * p * (1 - p)) as h01, sum(n * x * x * p * (1 - p)) as h11
    from (select i, b0, b1, x, n, s, 1 / (1 + exp(-(b0 + b1 * x))) as p from it, ce where i < 30) group by i, b0, b1)),
fi as (select b0, b1 from it order by i desc limit 1),
br as (select sum(n * p * (1 - p)) as h00, sum(n * x * p * (1 - p)) as h01, sum(n * x * x * p * (1 - p)) as h11 from (select *, 1 / (1 + exp(-(b0 + b1 * x))) as p from ce, fi)),
us as (select sum(e) as u0, sum(e * q) as u1, count(*) as n from (select o_custkey, q, (y > 250)::int - 1 / (1 + exp(-(b0 + b1 * q))) as e from o, fi) group by o_custkey),
ms as (select count(*) / (count(*) - 1.0) * (sum(n) - 1) / (sum(n) - 2) as f, sum(u0 * u0) as a, sum(u0 * u1) as b, sum(u1 * u1) as d from us),
vv as (select f * (h11 * h11 * a - 2 * h11 * h01 * b + h01 * h01 * d) / pow(h00 * h11 - h01 * h01, 2) as v0, f * (h01 * h01 * a - 2 * h00 * h01 * b + h00 * h00 * d) / pow(h00 * h11 - h01 * h01, 2) as v1 from br, ms)
select 'const' as term, round(b0, 6) as beta, round(sqrt(v0), 6) as se, round(b0 / sqrt(v0), 4) as z from fi, vv union all select 'q', round(b1, 6), round(sqrt(v1), 6), round(b1 / sqrt(v1), 4) from fi, vv""",
    "auroc_interval": f"""with {ORDERS}, rw as (select o_orderkey as k, (q >= 3)::int as y, day as x from o), {weighed("rw")},
j as (select rep, rw.x, sum(mult) as n, sum(mult * y) as pos from w join rw using (k) group by 1, 2),
s as (select rep, pos, n - pos as neg, coalesce(sum(n - pos) over (partition by rep order by x rows between unbounded preceding and 1 preceding), 0) as below from j),
b as (select rep, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) as v from s group by 1),
a as (select y, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as r from rw), p as (select (sum(r) filter (where y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) as p from a)
""" + _ci("(select p from p)", "b", "auroc", 5).format(p=""),
    "logrank_trend": f"with {ORDERS}" + _TREND,
    "series_summary": f"with {ORDERS}" + _SLOPE.format(**_ONE) + f", q as (select {_QM} from o) select tn::bigint as n, round(q1, 5) as q1, round(q2, 5) as q2, round(q3, 5) as q3, round(q4, 5) as q4, round((q4 - q1) / q1, 5) as decline, round(beta, 5) as beta, round(sqrt(g / (g - 1.0) * (tn - 1) / (tn - 2) * meat) / xx, 5) as se, round(beta / q1, 5) as relative from t, m, q",
    "series_by_month": f"with {ORDERS}, q as (select month, count(*) as n, {_QM}, regr_slope(y, q) as beta from o group by 1) select month, n, round(q1, 5) as q1, round(q4, 5) as q4, round((q4 - q1) / q1, 5) as decline, round(beta, 5) as beta from q",
    "mediation_triple": f"with {ORDERS}, s as (select covar_pop(q, day) as qd, var_pop(q) as qq, var_pop(day) as dd, covar_pop(q, y) as qy, covar_pop(day, y) as dy from o) select round(qy / qq, 6) as stratum, round(dy / sqrt(dd), 6) as mediator, round((qy * dd - dy * qd) / (qq * dd - qd * qd), 6) as joint, round(qd / sqrt(qq * dd), 6) as correlation from s",
    "exposure_contrast": f"""with {ORDERS}, {_DRAWS}, per as (select c.k, count(*)::double as n, sum(y) as sy, sum(q) as a, sum(q * q) as aa, sum(q * y) as ay, sum(month) as b, sum(month * month) as bb, sum(month * y) as by_ from o join c using (o_custkey) group by 1),
bb as (select rep, (sum(by_ * mult) - sum(b * mult) * sum(sy * mult) / sum(n * mult)) / (sum(bb * mult) - sum(b * mult) * sum(b * mult) / sum(n * mult)) - (sum(ay * mult) - sum(a * mult) * sum(sy * mult) / sum(n * mult)) / (sum(aa * mult) - sum(a * mult) * sum(a * mult) / sum(n * mult)) as v from w join per using (k) group by 1)
select 'b - a' as contrast, round((select regr_slope(y, month) - regr_slope(y, q) from o), 6) as point, count(v) as b, round(quantile_cont(v, 0.025), 5) as lo, round(quantile_cont(v, 0.975), 5) as hi from bb""",
    "best_in_replicate": f"""with {ORDERS}, {_DRAWS}, per as (select c.k, count(*)::double as n, sum(y) as sy, sum(day) as sd, sum(month * 20) as sm from o join c using (o_custkey) group by 1),
bb as (select rep, (sum(sy * mult) - greatest(sum(sd * mult), sum(sm * mult))) / sum(n * mult) as v from w join per using (k) group by 1)
select 'reference - best' as contrast, round((select avg(y) - greatest(avg(day), avg(month * 20)) from o), 6) as point, count(v) as b, round(quantile_cont(v, 0.025), 5) as lo, round(quantile_cont(v, 0.975), 5) as hi from bb""",
    "endpoints_by_quartile": """with s as (select stay_id, max(los) as los, max((outtime is null)::int) as open from icustays where stay_id is not null group by 1), q as (select *, greatest(1, ceil(4.0 * (row_number() over (order by los, stay_id) - 1) / (count(*) over () - 1)))::int as quartile from s where los is not null)
select quartile, count(*) as n, round(avg(open), 6) as share, round(quantile_cont(los, 0.5), 4) as median, round(quantile_cont(los, 0.25), 4) as p25, round(quantile_cont(los, 0.75), 4) as p75 from q group by 1""",
    "score_without_part": f"""with {ORDERS}, s as (select floor(y / 50) + q as score, q from o), e as (select list_distinct(quantile_cont(score, [0.25, 0.5, 0.75])) as e, min(score) as lo, max(score) as hi, list_distinct(quantile_cont(score - q, [0.25, 0.5, 0.75])) as e2, min(score - q) as lo2, max(score - q) as hi2 from s),
b as (select 1 + len(list_filter(e, lambda x: x > lo and x < hi and score > x)) as whole, 1 + len(list_filter(e2, lambda x: x > lo2 and x < hi2 and score - q > x)) as rest from s, e)
select whole, rest, count(*) as n, round((select avg((whole = rest)::int) from b), 6) as agree from b group by 1, 2""",
    "quartile_by_value": f"with e as ({_EDGES}) select c_custkey, 1 + (c_acctbal > a)::int + (case when b > a then c_acctbal > b else false end)::int + (case when c > b then c_acctbal > c else false end)::int as bin from customer, e",
    "quartile_by_rank": "select o_orderkey, greatest(1, ceil(4.0 * (r - 1) / (n - 1)))::int as bin from (select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) as r, count(*) over () as n from orders)",
    "crosstab_agreement": f"""with e as ({_EDGES}), x as (select 1 + (c_acctbal > a)::int + (c_acctbal > b)::int + (c_acctbal > c)::int as by_value, greatest(1, ceil(4.0 * (row_number() over (order by c_acctbal, c_custkey) - 1) / (count(*) over () - 1)))::int as by_rank from customer, e)
select by_value, by_rank, count(*) as n, round((select avg((by_value = by_rank)::int) from x), 6) as agree from x group by 1, 2""",
    "equal_n_sample": """with d as (select doc_id, genre, row_number() over (partition by genre order by md5(concat('s:', doc_id)), doc_id) as k from documents where genre is not null)
select doc_id, genre from d where k <= (select min(n) from (select count(*) as n from d group by genre))""",
    "cem_length_matched": """with d as (select doc_id, genre, n_chars from documents where genre is not null and n_chars is not null),
e as (select list_distinct(quantile_cont(n_chars, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) as es from d),
inner_e as (select list_filter(es, lambda x: x > lo and x < hi) as es from e, (select min(n_chars) as lo, max(n_chars) as hi from d)),
b as (select doc_id, genre, 1 + len(list_filter(es, lambda x: n_chars > x)) as bin from d, inner_e),
cells as (select bin, genre, count(*) as n from b group by 1, 2),
t as (select bin, min(n) as take from cells group by 1 having count(*) = (select count(distinct genre) from d)),
k as (select b.*, take, row_number() over (partition by b.bin, genre order by md5(concat('s:', doc_id)), doc_id) as k from b join t using (bin))
select doc_id, genre, bin from k where k <= take""",
    "slope_cr1": f"with {ORDERS}" + _SLOPE.format(**_ONE) + "select tn::bigint as n, g as clusters, round(beta, 6) as beta, round(sqrt(g / (g - 1.0) * (tn - 1) / (tn - 2) * meat) / xx, 6) as se, round(beta / (sqrt(g / (g - 1.0) * (tn - 1) / (tn - 2) * meat) / xx), 4) as z from t, m",
    "slope_cr1_by_group": f"with o0 as (with {ORDERS} select * from o), o as (select *, (month <= 6)::int as grp from o0)" + _SLOPE.format(**_GRP) + "select t.grp, tn::bigint as n, g as clusters, round(beta, 6) as beta, round(sqrt(g / (g - 1.0) * (tn - 1) / (tn - 2) * meat) / xx, 6) as se from t join m on t.grp = m.grp",
    "stratum_means_cr1": f"with {ORDERS}{_MEANS}, m as (select per.q, sum((sy - n * tsy / tn) ** 2) as meat from per join t on per.q = t.q group by 1) select t.q as stratum, tn::bigint as n, g as clusters, round(tsy / tn, 6) as mean, round(sqrt(g / (g - 1.0) * (tn - 1) / (tn - 2) * meat) / tn, 6) as se from t join m on t.q = m.q",
    "ols2_cr1": f"""with {ORDERS}, t as (select avg(q) as mq, avg(day) as md, avg(y) as my, count(*)::double as n, count(distinct o_custkey) as g from o),
c as (select o_custkey, q - mq as a, day - md as b, y - my as y from o, t),
s as (select sum(a * a) as aa, sum(a * b) as ab, sum(b * b) as bb, sum(a * y) as ay, sum(b * y) as by_ from c),
f as (select *, aa * bb - ab * ab as det, (bb * ay - ab * by_) / (aa * bb - ab * ab) as b1, (aa * by_ - ab * ay) / (aa * bb - ab * ab) as b2 from s),
u as (select o_custkey, sum(a * (y - b1 * a - b2 * b)) as ua, sum(b * (y - b1 * a - b2 * b)) as ub from c, f group by 1),
m as (select sum(ua * ua) as maa, sum(ua * ub) as mab, sum(ub * ub) as mbb from u),
v as (select b1, b2, g / (g - 1.0) * (n - 1) / (n - 3) * (bb * bb * maa - 2 * bb * ab * mab + ab * ab * mbb) / (det * det) as v1, g / (g - 1.0) * (n - 1) / (n - 3) * (ab * ab * maa - 2 * aa * ab * mab + aa * aa * mbb) / (det * det) as v2 from f, m, t)
select 'q' as term, round(b1, 6) as beta, round(sqrt(v1), 6) as se from v union all select 'day', round(b2, 6), round(sqrt(v2), 6) from v""",
    "linearity_wald": f"""with {ORDERS}{_MEANS}, tt as (select sum(tn) as nn, (select count(distinct o_custkey) from o) as gg from t),
u as (select o_custkey, sum(case when per.q = 1 then (sy - n * tsy / tn) / tn else 0 end) as u1, sum(case when per.q = 2 then (sy - n * tsy / tn) / tn else 0 end) as u2, sum(case when per.q = 3 then (sy - n * tsy / tn) / tn else 0 end) as u3, sum(case when per.q = 4 then (sy - n * tsy / tn) / tn else 0 end) as u4 from per join t on per.q = t.q group by 1),
b as (select sum(case when q = 1 then tsy / tn end) as m1, sum(case when q = 2 then tsy / tn end) as m2, sum(case when q = 3 then tsy / tn end) as m3, sum(case when q = 4 then tsy / tn end) as m4 from t),
w as (select gg / (gg - 1.0) * (nn - 1) / (nn - 4) as f, sum((u3 - 2 * u2 + u1) ** 2) as a, sum((u3 - 2 * u2 + u1) * (u4 - 3 * u2 + 2 * u1)) as c, sum((u4 - 3 * u2 + 2 * u1) ** 2) as d from u, tt group by 1)
select round((r1 * r1 * d - 2 * r1 * r2 * c + r2 * r2 * a) / ((a * d - c * c) * f), 4) as wald, 2 as df from w, (select m3 - 2 * m2 + m1 as r1, m4 - 3 * m2 + 2 * m1 as r2 from b)""",
    "holm_adjust": """with p as (select n_nationkey, n_regionkey, ((n_nationkey * 37 + 11) % 101) / 400.0 as p from nation),
s as (select *, (count(*) over (partition by n_regionkey) - row_number() over (partition by n_regionkey order by p) + 1) * p as s from p)
select n_nationkey, n_regionkey, round(least(1.0, max(s) over (partition by n_regionkey order by p)), 6) as p_holm from s""",
    "logrank_ranks": f"""with {ORDERS}, ts as (select distinct day as t from o), gs as (select distinct q as g from o),
ats as (select t, g, (select count(*) from o where day = t and q = g) as d, (select count(*) from o where day >= t and q = g) as nr, (select count(*) from o where day = t) as dt, (select count(*) from o where day >= t) as nt from ts, gs)
select g as stratum, sum(d)::bigint as n, round(sum(d)::double, 4) as observed, round(sum(dt * nr / nt::double), 4) as expected, round(sum(case when nt > 1 then dt * (nt - dt) / (nt - 1.0) / (nt * nt) * nr * (nt - nr) else 0 end), 4) as variance from ats group by g""",
    "auroc_midrank": f"""with {ORDERS}, x as (select (q >= 3)::int as hit, rank() over (order by day) + (count(*) over (partition by day) - 1) / 2.0 as mr from o)
select sum(hit)::bigint as n1, sum(1 - hit)::bigint as n0, round((sum(hit * mr) - sum(hit) * (sum(hit) + 1) / 2.0) / (sum(hit) * sum(1 - hit)), 6) as auroc from x""",
    "spearman_midrank": f"""with {ORDERS}, x as (select rank() over (order by day) + (count(*) over (partition by day) - 1) / 2.0 as a, rank() over (order by q) + (count(*) over (partition by q) - 1) / 2.0 as b from o) select count(*) as n, round(corr(a, b), 6) as rho from x""",
    "kendall_tau": """with p as (select c_nationkey as k, round(avg(c_acctbal), 2) as a, count(*) as b from customer group by 1)
select count(*) as pairs, round(sum(sign(x.a - y.a) * sign(x.b - y.b)) / sqrt(sum(sign(x.a - y.a) ** 2) * sum(sign(x.b - y.b) ** 2)), 6) as tau from p x join p y on x.k < y.k""",
    "eta2_cube": """with c as (select l_linenumber as a, l_returnflag as b, l_linestatus as c, avg(l_extendedprice) as m from lineitem group by 1, 2, 3),
q as (select (select sum(n * v * v) from (select count(*) as n, avg(m) as v from c)) as q0, (select sum(n * v * v) from (select count(*) as n, avg(m) as v from c group by a)) as qa, (select sum(n * v * v) from (select count(*) as n, avg(m) as v from c group by b)) as qb,
(select sum(n * v * v) from (select count(*) as n, avg(m) as v from c group by c)) as qc, (select sum(n * v * v) from (select count(*) as n, avg(m) as v from c group by a, b)) as qab, (select sum(n * v * v) from (select count(*) as n, avg(m) as v from c group by a, c)) as qac,
(select sum(n * v * v) from (select count(*) as n, avg(m) as v from c group by b, c)) as qbc, (select sum(m * m) from c) as qt)
select effect, round(ss / tot, 6) as share from (
select 'l_linenumber' as effect, qa - q0 as ss, qt - q0 as tot from q union all select 'l_returnflag', qb - q0, qt - q0 from q union all select 'l_linestatus', qc - q0, qt - q0 from q
union all select 'l_linenumber:l_returnflag', qab - qa - qb + q0, qt - q0 from q union all select 'l_linenumber:l_linestatus', qac - qa - qc + q0, qt - q0 from q union all select 'l_returnflag:l_linestatus', qbc - qb - qc + q0, qt - q0 from q
union all select 'l_linenumber:l_returnflag:l_linestatus', qt - qab - qac - qbc + qa + qb + qc - q0, qt - q0 from q)""",
    "vif": f"""with {ORDERS}, c as (select corr(q, day) as a, corr(q, month) as b, corr(day, month) as c from o), d as (select *, 1 + 2 * a * b * c - a * a - b * b - c * c as det from c)
select 'q' as term, round((1 - c * c) / det, 6) as vif from d union all select 'day', round((1 - b * b) / det, 6) from d union all select 'month', round((1 - a * a) / det, 6) from d""",
    "attenuation": f"""with {ORDERS}, s as (select regr_slope(y, q) as b0, count(*) as n, covar_pop(q, day) as qd, covar_pop(q, month) as qm, covar_pop(day, month) as dm, var_pop(q) as qq, var_pop(day) as dd, var_pop(month) as mm, covar_pop(q, y) as qy, covar_pop(day, y) as dy, covar_pop(month, y) as my from o)
select 'none' as given, round(b0, 6) as beta, n from s union all select 'day', round((qy * dd - dy * qd) / (qq * dd - qd * qd), 6), n from s union all select 'month', round((qy * mm - my * qm) / (qq * mm - qm * qm), 6), n from s
union all select 'all', round((qy * (dd * mm - dm * dm) - qd * (dy * mm - my * dm) + qm * (dy * dm - my * dd)) / (qq * (dd * mm - dm * dm) - qd * (qd * mm - qm * dm) + qm * (qd * dm - qm * dd)), 6), n from s""",
    "boot_cluster_mean": f"with {ORDERS}, {_DRAWS}, per as (select c.k, count(*) as n, sum(y) as sy from o join c using (o_custkey) group by 1), b as (select rep, sum(sy * mult) / sum(n * mult) as v from w join per using (k) group by 1) " + _ci("(select avg(y) from o)", "b", "mean", 6).format(p=""),
    "boot_paired_clusters": f"""with {ORDERS}, {_DRAWS}, per as (select c.k, count(*)::double as n, sum(q) as sx, sum(q * q) as sxx, sum(y) as sy_y, sum(q * y) as sxy_y, sum(day) as sy_day, sum(q * day) as sxy_day, sum(case when q = 1 then y else 0 end) as s1_y, sum(case when q = 1 then day else 0 end) as s1_day, sum((q = 1)::int) as n1 from o join c using (o_custkey) group by 1),
b as (select rep, {_SLOPES} from (select *, mult::double as m from w join per using (k)) group by 1), whole as (select {_SLOPES} from (select *, 1.0::double as m from per)),
ba as (select b_day - b_y as v from b), br as (select b_day / m_day - b_y / m_y as v from b)
""" + _ci("(select b_day - b_y from whole)", "ba", "absolute", 5).format(p=", round(least(1.0, greatest(2 * least(avg((v <= 0)::int), avg((v >= 0)::int)), 1.0 / count(v))), 6) as p") + " union all " + _ci("(select b_day / m_day - b_y / m_y from whole)", "br", "relative", 5).format(p=", round(least(1.0, greatest(2 * least(avg((v <= 0)::int), avg((v >= 0)::int)), 1.0 / count(v))), 6) as p"),
}
