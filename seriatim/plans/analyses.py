"""Registered queries: series, accounting, descriptives and sensitivity, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriatim.functions.stats import adjusted_skew
from seriatim.operators import dense, exposure, infer, lexical, resample, strata, studies, text
from seriatim.plans import exposures, inference, retrieval
from seriatim.sources.tables import micros, table


def r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


def hourly_warmup(spark, root):
    """Hours since all three vital signs were first present, of stays with fifty such hours or more."""
    c = table(spark, root, "chartevents", ["stay_id", "itemid", "charttime", "valuenum"]).where("itemid in (220045, 220210, 220277) and stay_id is not null and charttime is not null")
    part = lambda i: F.max(F.when(F.col("itemid") == i, F.col("valuenum")))
    rows = c.groupBy("stay_id", F.floor(micros("charttime") / 3_600_000_000).alias("hour")).agg(part(220045).alias("hr"), part(220210).alias("rr"), part(220277).alias("ox"))
    h = exposure.hourly(rows, "stay_id", "hour", ["hr", "rr", "ox"], least=50)
    return h.groupBy("stay_id").agg(F.count("*").alias("hours"), F.max("rel").alias("last"))


def activity_split(spark, root):
    a = table(spark, root, "inputevents", ["row_id", "stay_id", "starttime"]).where("starttime is not null").dropDuplicates(["row_id"])
    return exposure.activity(a, exposure.windows(table(spark, root, "icustays"), "0 hours"), "stay_id", "starttime").select("stay_id", "early", "late", "total", r("rate", 4))


def provenance_checks(spark, root):
    steps = exposures.scan_attrition(spark, root).select(F.col("name").alias("label"), F.col("n").cast("double").alias("got"))
    declared = table(spark, root, "icustays", ["stay_id"]).agg(F.count_distinct("stay_id")).first()[0]  # an independent count
    return exposure.checks(steps, {"stays": declared, "12 hours": 1, "unheard of": 3})


def extraction_accounting(spark, root):
    notes = retrieval._notes(spark, root)
    p = text.pairs(notes, "note_id", "text", text.narrative_queries(notes, "note_id", "text"))
    return p.groupBy("reason").agg(F.count("*").alias("n"))


def query_descriptives(spark, root):
    """Query words, characters and the share of query words that the target holds, by target length quartile."""
    docs, asked = retrieval._slice(spark, root)
    j = asked.join(docs.select(F.col("doc").alias("target"), F.col("tokens").alias("own")), "target")
    sized = strata.bins_by_value(docs.select(F.col("doc").alias("target"), F.size("tokens").cast("double").alias("size")), "size", 4, "q")
    share = F.size(F.array_intersect("tokens", "own")) / F.size(F.array_distinct("tokens"))
    return j.join(sized, "target").groupBy("q").agg(F.count("*").alias("n"), F.round(F.avg(F.size("tokens")), 6).alias("words"), F.round(F.avg(F.length(F.array_join("tokens", " "))), 6).alias("chars"), F.round(F.avg(share), 6).alias("overlap"))


def equal_pool_df(spark, root):
    """Word document frequencies over pools of equal size per genre."""
    d = table(spark, root, "documents", ["doc_id", "genre", "text"]).where("genre is not null and text is not null")
    return text.word_frequency(strata.equal_n(d, "genre", "doc_id"), "doc_id", "text")


def most_common_words(spark, root):
    d = table(spark, root, "documents", ["doc_id", "text"]).where("text is not null")
    return text.word_frequency(d, "doc_id", "text").orderBy(F.col("documents").desc(), "word").limit(10)


def chunk_windows(spark, root):
    """Windows of 384 words with stride 288 per document, and whether it takes more than one."""
    d = table(spark, root, "documents", ["doc_id", "text"]).where("text is not null").select("doc_id", text.words("text").alias("t"))
    w = d.select("doc_id", F.size(lexical.window_tokens("t", 384, 288)).alias("windows"))
    return w.withColumn("truncated", F.col("windows") > 1)


def truncation_share(spark, root):
    d = table(spark, root, "documents", ["genre", "text"]).where("text is not null").select("genre", F.size(text.words("text")).alias("n"))
    return d.groupBy("genre").agg(F.round(F.avg((F.col("n") > 384).cast("double")), 6).alias("share"), F.max("n").alias("longest"))


def dense_per_cell(spark, root):
    """Each genre its own index, with the random-ranking reference."""
    c, asked = retrieval._chunks(spark, root)
    g = table(spark, root, "documents", ["doc_id", "genre"]).select(F.col("doc_id").alias("d"), F.pmod(F.crc32(F.col("genre").cast("binary")), F.lit(1000003)).cast("double").alias("grp"))
    c = c.drop("grp").join(g, F.col("doc") == F.col("d"), "left").drop("d").where("grp is not null")
    asked = asked.drop("grp").join(g, F.col("target") == F.col("d"), "left").drop("d").where("grp is not null")
    o = lexical.ranked(dense.outcomes(c, asked, within=True))
    return o.select("query", "target", "rank", r("target_score", 5), r("margin", 5), "hit")


def exact_deltas(spark, root):
    """Best-chunk against mean-pooled scores of the same queries: differences of the target's and of the best other's score, and their ratio."""
    c, asked = retrieval._chunks(spark, root)
    a = dense.outcomes(c, asked).select("query", F.col("target_score").alias("ta"), F.col("best_other").alias("ba"))
    b = dense.outcomes(dense.summed(c), asked, pooled=True).select("query", F.col("target_score").alias("tb"), F.col("best_other").alias("bb"))
    dt, db = F.col("tb") - F.col("ta"), F.col("bb") - F.col("ba")
    return a.join(b, "query").select("query", F.round(dt, 5).alias("d_target"), F.round(db, 5).alias("d_best"), F.round(F.when(db > 0, F.abs(dt) / db), 4).alias("ratio"))


def scorer_sensitivity(spark, root):
    """Mean reciprocal rank of every scorer; the random chunk over three seeds by median and range."""
    c, asked = retrieval._chunks(spark, root)
    mrr = lambda o: lexical.ranked(o).agg(F.avg("rr")).first()[0]
    mean = dense.mean_vector(c)
    middle = lambda d: d.withColumn("v", dense.centred(F.col("v"), mean))
    rows = [("best chunk", mrr(dense.outcomes(c, asked)), None, None), ("mean pooled", mrr(dense.outcomes(dense.summed(c), asked, pooled=True)), None, None), ("centred", mrr(dense.outcomes(middle(c), middle(asked))), None, None)]
    seeds = sorted(mrr(dense.outcomes(dense.random_chunk(c, "chunk", s), asked)) or 0.0 for s in ("a", "b", "c"))
    rows = [(n, *(None if x is None else round(x, 6) for x in v)) for n, *v in [*rows, ("random chunk", seeds[1], seeds[0], seeds[-1])]]
    return spark.createDataFrame(rows, "scorer string, mrr double, lo double, hi double")


def code_score_diagnostics(spark, root):
    s = exposures.code_hierarchy_score(spark, root)
    g = s.agg(F.count("*").alias("n"), F.avg((F.col("score") == 1).cast("double")).alias("one"), F.avg((F.col("score") >= 5).cast("double")).alias("five"), F.skewness("score").alias("skew")).first()
    return spark.createDataFrame([(g["n"], round(g["one"], 6), round(g["five"], 6), round(adjusted_skew(g["skew"], g["n"]), 6))], "n bigint, one double, five double, skew double")


def activity_correlations(spark, root):
    li = table(spark, root, "lineitem", ["l_orderkey", "l_quantity", "l_extendedprice", "l_suppkey"]).groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"), F.count_distinct("l_suppkey").alias("suppliers"))
    rows = studies.activity(li, [("lines", "quantity"), ("lines", "suppliers"), ("quantity", "suppliers")])
    return spark.createDataFrame([(a, b, n, round(x, 6)) for a, b, n, x in rows], "a string, b string, n bigint, rho double")


def idf_conditioning(spark, root):
    """The slope of document length on genre strata given mean idf, one at a time and together."""
    d = table(spark, root, "documents", ["doc_id", "text", "genre", "source"]).where("text is not null and genre is not null")
    idf = text.mean_idf(d, "doc_id", "text", text.word_frequency(d, "doc_id", "text"), d.count())
    j = d.select("doc_id", "source", F.length("text").cast("double").alias("y"), F.size(text.words("text")).cast("double").alias("words"), (F.length("genre") % 4 + 1).alias("q")).join(idf, "doc_id")
    half = lambda x: None if x is None else round(x, 5)
    return spark.createDataFrame([(x["given"], half(x["beta"]), x["n"], half(x["attenuation"])) for x in infer.conditioned(j, "y", "q", ["mean_idf", "words"], "source", least=20)], "given string, beta double, n bigint, attenuation double")


def eta2_bootstrap(spark, root):
    """Replicates of a variance share by drawing orders, from sums per order and cell."""
    li = table(spark, root, "lineitem", ["l_orderkey", "l_returnflag", "l_linestatus", "l_extendedprice"])
    cells = [(a, b) for a in ("A", "N", "R") for b in ("F", "O")]
    own = lambda a, b: (F.col("l_returnflag") == a) & (F.col("l_linestatus") == b)
    sums = [f.alias(f"{n}_{a}{b}") for a, b in cells for n, f in (("n", F.sum(F.when(own(a, b), 1).otherwise(0))), ("s", F.sum(F.when(own(a, b), F.col("l_extendedprice")).otherwise(0.0))))]
    reps = resample.replicate(resample.numbered_clusters(li, "l_orderkey", sums), 500, "l_orderkey")
    m = {c: F.try_divide(F.col(f"s_{c[0]}{c[1]}"), F.col(f"n_{c[0]}{c[1]}")) for c in cells}
    grand = sum(m.values(), F.lit(0.0)) / 6
    between = sum((2 * F.pow((m[(a, "F")] + m[(a, "O")]) / 2 - grand, 2) for a in ("A", "N", "R")), F.lit(0.0))
    return resample.interval(reps, F.try_divide(between, sum((F.pow(x - grand, 2) for x in m.values()), F.lit(0.0))), "l_returnflag").select("contrast", "b", r("lo"), r("hi"), r("sd"))


def composite_strata(spark, root):
    o = inference._orders(spark, root)
    c = exposure.composite(o, {"y": False, "day": True}, (F.col("month") > 6).cast("int"))
    return c.groupBy("composite").agg(F.count("*").alias("n"))


def stay_outcomes(spark, root):
    s = table(spark, root, "icustays").dropDuplicates(["stay_id"]).where("stay_id is not null and intime is not null")
    days = (micros("outtime") - micros("intime")) / 86_400_000_000
    return s.select("stay_id", F.round(days, 4).alias("days"), F.col("outtime").isNull().alias("still_in"), F.year("intime").alias("year")).where("year >= 2100")


QUERIES = {f.__name__: f for f in (hourly_warmup, activity_split, provenance_checks, extraction_accounting, query_descriptives, equal_pool_df, most_common_words, chunk_windows, truncation_share, dense_per_cell, exact_deltas, scorer_sensitivity, code_score_diagnostics, activity_correlations, idf_conditioning, eta2_bootstrap, composite_strata, stay_outcomes)}

_WINDOW = exposures._WIN.format(b=0)
_RANK = "rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0"

_CELLS = [(a, b) for a in ("A", "N", "R") for b in ("F", "O")]
_GRAND = "(" + " + ".join(f"m{a}{b}" for a, b in _CELLS) + ") / 6"
_MRR = "avg(case when rank <= 10 then 1.0::double / rank else 0 end)"


def _random(seed: str) -> str:
    return retrieval.ORACLE["dense_random_chunk"].replace("'s:'", f"'{seed}:'")


ORACLE = {
    "eta2_bootstrap": f"""with per as (select l_orderkey as k, {", ".join(f"sum((l_returnflag = '{a}' and l_linestatus = '{b}')::int) as n{a}{b}, sum(case when l_returnflag = '{a}' and l_linestatus = '{b}' then l_extendedprice else 0 end) as s{a}{b}" for a, b in _CELLS)} from lineitem group by 1),
{inference.weighed("per", 500)}, rp as (select rep, {", ".join(f"sum(s{a}{b} * mult) / nullif(sum(n{a}{b} * mult), 0) as m{a}{b}" for a, b in _CELLS)} from w join per using (k) group by 1),
vs as (select ({" + ".join(f"2 * pow((m{a}F + m{a}O) / 2 - {_GRAND}, 2)" for a in "ANR")}) / nullif({" + ".join(f"pow(m{a}{b} - {_GRAND}, 2)" for a, b in _CELLS)}, 0) as v from rp)
select 'l_returnflag' as contrast, count(v) as b, round(quantile_cont(v, 0.025), 6) as lo, round(quantile_cont(v, 0.975), 6) as hi, round(stddev_samp(v), 6) as sd from vs""",
    "idf_conditioning": f"""with i as ({retrieval.ORACLE["word_df_idf"].replace("round(avg(ln((select count(*) from d)::double / (1 + coalesce(documents, 0)))), 6)", "avg(ln((select count(*) from d)::double / (1 + coalesce(documents, 0))))")}),
j as (select length(text)::double as y, (length(genre) % 4 + 1)::double as q, mean_idf as a, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::double as b from documents join i using (doc_id) where text is not null and genre is not null),
c as (select count(*) as n, covar_pop(q, y) as qy, covar_pop(a, y) as ay, covar_pop(b, y) as by_, var_pop(q) as qq, var_pop(a) as aa, var_pop(b) as bb, covar_pop(q, a) as qa, covar_pop(q, b) as qb, covar_pop(a, b) as ab from j),
s as (select n, qy / qq as b0, (qy * aa - ay * qa) / (qq * aa - qa * qa) as b1, (qy * bb - by_ * qb) / (qq * bb - qb * qb) as b2,
  (qy * (aa * bb - ab * ab) - ay * (qa * bb - ab * qb) + by_ * (qa * ab - aa * qb)) / (qq * (aa * bb - ab * ab) - qa * (qa * bb - ab * qb) + qb * (qa * ab - aa * qb)) as b3 from c)
select 'none' as given, round(b0, 5) as beta, n, 0.0::double as attenuation from s union all select 'mean_idf', round(b1, 5), n, round(1 - abs(b1) / abs(b0), 5) from s union all select 'words', round(b2, 5), n, round(1 - abs(b2) / abs(b0), 5) from s union all select 'all', round(b3, 5), n, round(1 - abs(b3) / abs(b0), 5) from s""",
    "scorer_sensitivity": f"""with r as (select {_MRR} as m from ({_random("a")}) union all select {_MRR} from ({_random("b")}) union all select {_MRR} from ({_random("c")}))
select 'best chunk' as scorer, round({_MRR}, 6) as mrr, null::double as lo, null::double as hi from ({retrieval.ORACLE["dense_rank_margin"]}) union all select 'mean pooled', round({_MRR}, 6), null, null from ({retrieval.ORACLE["dense_mean_pool"]})
union all select 'centred', round({_MRR}, 6), null, null from ({retrieval.ORACLE["dense_centered"]}) union all select 'random chunk', round(median(m), 6), round(min(m), 6), round(max(m), 6) from r""",
    "exact_deltas": f"""with a as ({retrieval.unrounded("dense_rank_margin")}), b as ({retrieval.unrounded("dense_mean_pool")}), d as (select query, b.ts - a.ts as dt, b.bo - a.bo as db from a join b using (query))
select query, round(dt, 5) as d_target, round(db, 5) as d_best, round(case when db > 0 then abs(dt) / db end, 4) as ratio from d""",
    "extraction_accounting": retrieval.ORACLE["extraction_accounting"],
    "hourly_warmup": """with x as (select stay_id, epoch_us(charttime) // 3600000000 as hour, max(case when itemid = 220045 then valuenum end) as a, max(case when itemid = 220210 then valuenum end) as b, max(case when itemid = 220277 then valuenum end) as c from chartevents where itemid in (220045, 220210, 220277) and stay_id is not null and charttime is not null group by 1, 2),
s as (select stay_id, min(hour) as h0 from x where a is not null and b is not null and c is not null group by 1)
select stay_id, count(*) as hours, max(hour - h0) as last from x join s using (stay_id) where hour - h0 >= 0 and hour - h0 < 720 group by 1 having count(*) >= 50""",
    "activity_split": f"""with {_WINDOW}, a as (select row_id, any_value(stay_id) as stay_id, any_value(starttime) as t from inputevents where starttime is not null group by 1)
select stay_id, count(*) filter (where t <= t1) as early, count(*) filter (where t > t1) as late, count(*) as total, round(count(*) / nullif((max(epoch_us(t)) - min(epoch_us(t0))) / 3600000000.0, 0), 4) as rate from a join w using (stay_id) where t >= t0 group by 1""",
    "provenance_checks": f"with a as ({exposures.ORACLE['scan_attrition']}), e as (select * from (values ('stays', (select count(distinct stay_id) from icustays)::double), ('12 hours', 1.0), ('unheard of', 3.0)) as t(label, expected)) select label, n::double as got, expected::double as expected, coalesce(n = expected, false) as ok from e left join a on name = label",
    "query_descriptives": f"""with {retrieval._SLICE}, e as (select quantile_cont(len(tokens), [0.25, 0.5, 0.75]) as e from dt), j as (select qs.tokens as t, dt.tokens as o, 1 + (len(dt.tokens) > e[1])::int + (len(dt.tokens) > e[2])::int + (len(dt.tokens) > e[3])::int as q from qs join dt on doc = qs.q, e)
select q, count(*) as n, round(avg(len(t)), 6) as words, round(avg(length(array_to_string(t, ' '))), 6) as chars, round(avg(len(list_intersect(list_distinct(t), list_distinct(o))) / len(list_distinct(t))::double), 6) as overlap from j group by 1""",
    "equal_pool_df": """with d as (select doc_id, genre, text, row_number() over (partition by genre order by md5(concat('s:', doc_id)), doc_id) as k from documents where genre is not null and text is not null),
p as (select * from d where k <= (select min(n) from (select count(*) as n from d group by genre))) select word, count(*) as documents from (select unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) as word from p) group by 1""",
    "most_common_words": "select word, count(*) as documents from (select unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) as word from documents where text is not null) group by 1 order by 2 desc, 1 limit 10",
    "chunk_windows": "with d as (select doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) as n from documents where text is not null) select doc_id, (greatest(0, ceil((n - 384) / 288.0)) + 1)::int as windows, n > 384 as truncated from d",
    "truncation_share": "with d as (select genre, len(regexp_extract_all(lower(text), '[a-z0-9]+')) as n from documents where text is not null) select genre, round(avg((n > 384)::int), 6) as share, max(n)::int as longest from d group by 1",
    "dense_per_cell": retrieval._dense_sql(f", c2 as (select ch.chunk_id, ch.doc, ch.v, genre as grp from ch join documents on doc_id = ch.doc where genre is not null), q2 as (select q, target, v, genre as grp from qs join documents on doc_id = target where genre is not null)", "c2", "q2", where="{chunks}.chunk_id <> q and c2.grp = q2.grp"),
    "code_score_diagnostics": f"with s as ({exposures.ORACLE['code_hierarchy_score']}) select count(*) as n, round(avg((score = 1)::int), 6) as one, round(avg((score >= 5)::int), 6) as five, round(skewness(score), 6) as skew from s",
    "activity_correlations": f"""with x as (select l_orderkey, count(*) as lines, sum(l_quantity) as quantity, count(distinct l_suppkey) as suppliers from lineitem group by 1),
k as (select {_RANK.format(c='lines')} as a, {_RANK.format(c='quantity')} as b, {_RANK.format(c='suppliers')} as c from x)
select 'lines' as a, 'quantity' as b, count(*) as n, round(corr(k.a, k.b), 6) as rho from k union all select 'lines', 'suppliers', count(*), round(corr(k.a, k.c), 6) from k union all select 'quantity', 'suppliers', count(*), round(corr(k.b, k.c), 6) from k""",
    "composite_strata": f"with {inference.ORDERS}, e as (select quantile_cont(y, [0.25, 0.5, 0.75]) as a, quantile_cont(day, [0.25, 0.5, 0.75]) as b from o) select 1 + (y > a[1])::int + (y > a[2])::int + (y > a[3])::int + 4 - (day > b[1])::int - (day > b[2])::int - (day > b[3])::int + (month > 6)::int as composite, count(*) as n from o, e group by 1",
    "stay_outcomes": "select stay_id, round((epoch_us(outtime) - epoch_us(intime)) / 86400000000.0, 4) as days, outtime is null as still_in, year(intime)::int as year from (select stay_id, any_value(intime) as intime, max(outtime) as outtime from icustays where stay_id is not null and intime is not null group by 1) where year(intime) >= 2100",
}
