"""Registered queries: text pipeline, lexical and dense retrieval, with their SQL.

The query set of a search is every row whose id is divisible by 100, against all rows.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seriatim.operators import dense, infer, lexical, strata, studies, text
from seriatim.plans import extraction
from seriatim.session import cut, partitions
from seriatim.sources.tables import table


def r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


def _documents(spark, root, least: int = 400):
    return text.deduplicated(table(spark, root, "documents", ["doc_id", "text"]), "doc_id", "text", least)


def dedup_norm_key(spark, root):
    return _documents(spark, root).select("doc_id")


def sentence_df(spark, root):
    """Sentence keys by plain sentence ends, six words or more, with their number of documents."""
    d = table(spark, root, "documents", ["doc_id", "text"]).where("text is not null")
    s = d.select("doc_id", F.explode(F.split("text", r"(?<=[.!?])[ \n\t]+")).alias("s"))
    keys = s.where(F.size(F.split(F.trim("s"), " +")) >= 6).select("doc_id", text.sentence_key("s").alias("key")).distinct()
    return keys.groupBy("key").agg(F.count("*").alias("documents"))


def word_df_idf(spark, root):
    """Each text as a query on all texts: mean idf of its words."""
    d = table(spark, root, "documents", ["doc_id", "text"]).where("text is not null")
    return text.mean_idf(d, "doc_id", "text", text.word_frequency(d, "doc_id", "text"), d.count()).select("doc_id", r("mean_idf"), r("missing"))


def leak_flag(spark, root):
    """Whether a patient's next note still holds the beginning of a note."""
    n = table(spark, root, "discharge", ["note_id", "subject_id", "text", "charttime"]).where("text is not null")
    n = n.groupBy("note_id").agg(F.min("subject_id").alias("subject_id"), F.min("charttime").alias("charttime"), F.max("text").alias("text"))
    after = F.lead("text").over(Window.partitionBy("subject_id").orderBy(F.col("charttime").asc_nulls_last(), "note_id"))
    return n.withColumn("after", after).where("after is not null").select("note_id", text.leaks(F.col("text"), F.col("after")).alias("leak"))


def _notes(spark, root):
    """Notes once each; the explicit width keeps the Python stage that follows parallel on small files."""
    notes = table(spark, root, "discharge", ["note_id", "text"]).where("text is not null")
    return notes.repartition(partitions(notes), "note_id").dropDuplicates(["note_id"])


def query_extract(spark, root):
    return text.narrative_queries(_notes(spark, root), "note_id", "text")


def query_removed(spark, root):
    n = _notes(spark, root)
    return text.pairs(n, "note_id", "text", text.narrative_queries(n, "note_id", "text")).select("note_id", "reason", F.length("target").alias("target_chars"))


def query_position(spark, root):
    n = _notes(spark, root)
    j = text.located(n.join(text.narrative_queries(n, "note_id", "text"), "note_id"), "text", "query")
    chunk, chunks = text.chunk_at("text", F.col("at"))
    return j.select("note_id", "at", chunk.alias("chunk"), chunks.alias("chunks"))


def sentence_frequency(spark, root):
    """Keys of sentences of six words or more, with the number of notes that hold them."""
    return text.frequent_keys(text.sentence_table(_notes(spark, root), "note_id", "text"), 0)


def prose_runs(spark, root):
    """The runs of neighbouring rare prose sentences of each note, with their first sentence's place."""
    r = text.prose_runs(text.prose(text.sentence_table(_notes(spark, root), "note_id", "text")))
    first = F.min("pos").alias("first")
    return r.groupBy(F.col("id").alias("note_id"), "run").agg(F.count("*").alias("sentences"), first).select("note_id", "sentences", "first")


def eligible_share(spark, root):
    """The share of notes with five windows or more, and how many a note has on average."""
    n = _notes(spark, root)
    w = text.windows(n, "note_id", "text").groupBy("note_id").agg(F.count("*").alias("n"))
    own = F.coalesce("n", F.lit(0))
    return n.select("note_id").join(w, "note_id", "left").agg(F.round(F.avg((own >= 5).cast("double")), 6).alias("share"), F.round(F.avg(own), 6).alias("mean"), F.count("*").alias("notes"))


def eligible_windows(spark, root):
    return text.windows(_notes(spark, root), "note_id", "text").groupBy("note_id").agg(F.count("*").alias("windows"))


def drawn_windows(spark, root):
    return text.drawn_windows(text.windows(_notes(spark, root), "note_id", "text"), "note_id", 2).select("note_id", "window")


def _slice(spark, root):
    """Documents of 40 tokens or more: tokens 21-32 are the query, the rest is the target. The tokens are cut once."""
    d = _documents(spark, root).select(F.col("doc_id").alias("doc"), text.words("text").alias("t")).where(F.size("t") >= 40)
    d = cut(d.repartition(partitions(d), "doc"))
    docs = d.select("doc", F.concat(F.slice("t", 1, 20), F.expr("slice(t, 33, size(t))")).alias("tokens"))
    asked = d.where("doc % 100 = 0").select(F.col("doc").alias("query"), F.col("doc").alias("target"), F.slice("t", 21, 12).alias("tokens"))
    return docs, asked


def _bm25(spark, root, ties: str = "optimistic", **how):
    docs, asked = _slice(spark, root)
    o = lexical.ranked(lexical.outcomes(docs, asked, **how), ties)
    return o.select("query", "rank", r("target_score", 5), r("best_other", 5), r("rr"), "hit")


def bm25_rank_optimistic(spark, root):
    return _bm25(spark, root)


def bm25_rank_pessimistic(spark, root):
    return _bm25(spark, root, "pessimistic", once=True)


def bm25_windowed(spark, root):
    """Word windows of 384 with stride 288."""
    return _bm25(spark, root, window=(384, 288))


def bm25_windowed_narrow(spark, root):
    """Word windows of 192 with stride 144."""
    return _bm25(spark, root, window=(192, 144))


def bm25_windowed_dfdoc(spark, root):
    """Word windows of 192 with stride 144, frequencies and counts of documents."""
    return _bm25(spark, root, window=(192, 144), document_idf=True)


def geo_rank_ratio(spark, root):
    """Geometric mean rank of the targets by document length quartile, relative to the lowest one that has queries."""
    docs, asked = _slice(spark, root)
    o = lexical.ranked(lexical.outcomes(docs, asked))
    sized = strata.bins_by_value(docs.select(F.col("doc").alias("query"), F.size("tokens").cast("double").alias("size")), "size", 4, "q")
    j = o.join(sized, "query").withColumn("ln_rank", F.log("rank"))
    m = infer.stratum_means(j, "ln_rank", "q", "query")
    base = m.agg(F.min_by("mean", "stratum").alias("m1"))
    return m.crossJoin(F.broadcast(base)).select("stratum", "n", F.round(F.exp("mean"), 5).alias("geo_mean"), F.round(F.exp(F.col("mean") - F.col("m1")), 5).alias("ratio"))


def _chunks(spark, root):
    c = dense.sound(table(spark, root, "chunk_vec", ["chunk_id", "did", "dv"]), "dv").where("did is not null")
    owner = table(spark, root, "documents", ["doc_id", "subject_id"]).select(F.col("doc_id").alias("did"), F.col("subject_id").cast("double").alias("grp"))
    c = c.join(owner, "did", "left")
    asked = c.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query"), F.col("did").alias("target"), "grp", F.col("dv").alias("v"))
    return c.select(F.col("chunk_id").alias("chunk"), F.col("did").alias("doc"), "grp", F.col("dv").alias("v")), asked


def _dense(chunks, asked, **how):
    o = lexical.ranked(dense.outcomes(chunks, asked, **how))
    return o.select("query", "target", "rank", r("target_score", 5), r("margin", 5), "hit")


def dense_rank_margin(spark, root):
    return _dense(*_chunks(spark, root))


def dense_same_group_masked(spark, root):
    return _dense(*_chunks(spark, root), masked=True)


def dense_mean_pool(spark, root):
    c, asked = _chunks(spark, root)
    return _dense(dense.summed(c), asked, pooled=True)


def dense_centered(spark, root):
    c, asked = _chunks(spark, root)
    mean = dense.mean_vector(c)
    return _dense(c.withColumn("v", dense.centred(F.col("v"), mean)), asked.withColumn("v", dense.centred(F.col("v"), mean)))


def dense_random_chunk(spark, root):
    c, asked = _chunks(spark, root)
    return _dense(dense.random_chunk(c, "chunk"), asked)


def bm25_rank_by_id(spark, root):
    """Documents as good as the target rank before it if their id is smaller."""
    return _bm25(spark, root, "by_id")


def dense_conditions(spark, root):
    """Query sides on one index of chunks: bare vectors, and vectors moved by an instruction (the mean vector stands in for it)."""
    c, asked = _chunks(spark, root)
    mean = dense.mean_vector(c)
    moved = asked.withColumn("v", F.zip_with(F.transform("v", lambda x: x.cast("double")), F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x + m))
    chunks = c.withColumn("v", F.transform("v", lambda x: x.cast("double")))
    o = studies.by_condition(lambda q: lexical.ranked(dense.outcomes(chunks, q)), {"bare": asked.withColumn("v", F.transform("v", lambda x: x.cast("double"))), "instructed": moved})
    return o.select("condition", "query", "target", "rank", r("target_score", 5), "hit")


def query_draws(spark, root):
    """Three draws of a query from each document, tokens 21-32, 19-30 and 23-34 in part, on one index in one pass: the slope of rank on draw is the reader's."""
    docs, asked = _slice(spark, root)
    draws = None
    for i, (a, n) in enumerate(((1, 12), (1, 8), (5, 8))):
        part = asked.select((F.col("query") * 10 + i).alias("query"), "target", F.slice("tokens", a, n).alias("tokens"))
        draws = part if draws is None else draws.unionByName(part)
    o = lexical.ranked(lexical.outcomes(docs, draws))
    return o.select("target", (F.col("query") % 10).cast("int").alias("draw"), "rank", r("target_score", 5))


def sentence_ends(spark, root):
    return table(spark, root, "documents", ["doc_id", "text"]).where("text is not null").select("doc_id", F.regexp_count("text", F.lit(r"[.!?]\s")).alias("ends"))


def dispersion(spark, root):
    c, _ = _chunks(spark, root)
    return dense.dispersion(c).select("doc", "n", r("pair_cosine"), r("centroid_cosine"), r("effective_rank"))


QUERIES = {f.__name__: f for f in (bm25_rank_by_id, dense_conditions, query_draws, sentence_ends, dedup_norm_key, sentence_df, word_df_idf, leak_flag, sentence_frequency, prose_runs, eligible_share, query_extract, query_removed, query_position, eligible_windows, drawn_windows, bm25_rank_optimistic, bm25_rank_pessimistic, bm25_windowed, bm25_windowed_narrow, bm25_windowed_dfdoc, geo_rank_ratio, dense_rank_margin, dense_same_group_masked, dense_mean_pool, dense_centered, dense_random_chunk, dispersion)}

_KEY = "trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '\\p{{Nd}}', '', 'g'), '[^a-z ]', ' ', 'g'), ' +', ' ', 'g'))"
_DOCS = f"docs as (select min(doc_id) as doc_id, arg_min(text, doc_id) as text from documents where text is not null and length(text) >= 400 group by md5({_KEY.format(c='text')}))"
_SLICE = f"""{_DOCS}, tk as (select doc_id as doc, regexp_extract_all(lower(text), '[a-z0-9]+') as t from docs),
dt as (select doc, t[1:20] || t[33:] as tokens from tk where len(t) >= 40), qs as (select doc as q, t[21:32] as tokens from tk where len(t) >= 40 and doc % 100 = 0)"""


def _bm25_sql(units: str, pessimistic: bool = False, once: bool = False, document_idf: bool = False, last: str = "", by_id: bool = False) -> str:
    """units: doc, u, tokens. Scores of every (query, document), zero where no term is shared."""
    stats = "dt" if document_idf else "un"
    return f"""with {_SLICE}, un as ({units}), st as (select count(*)::double as n from {stats}), ln as (select avg(len(tokens)) as mean from un),
df as (select term, count(*) as df from (select unnest(list_distinct(tokens)) as term from {stats}) group by 1),
raw as (select term, ln(n - df + 0.5) - ln(df + 0.5) as v from df, st), idf as (select term, case when v < 0 then 0.25 * (select avg(v) from raw) else v end as idf from raw),
tf as (select doc, u, term, count(*)::double as tf, any_value(dl) as dl from (select doc, u, len(tokens) as dl, unnest(tokens) as term from un) group by 1, 2, 3),
qt as (select q, term, {'1' if once else 'count(*)'} as m from (select q, unnest(tokens) as term from qs) group by 1, 2),
su as (select q, doc, u, round(sum(m * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 9) as s from qt join tf using (term) join idf using (term), ln group by 1, 2, 3),
al as (select q, un.doc, max(coalesce(s, 0)) as s from qs cross join un left join su using (q, doc, u) group by 1, 2),
tg as (select q, s as ts from al where q = doc),
oc as (select q as query, ts, count(*) filter (where s > ts and doc <> q) as above, count(*) filter (where s = ts and {'doc < q' if by_id else 'doc <> q'}) as eq, max(s) filter (where doc <> q) as bo from al join tg using (q) group by 1, 2),
rk as (select query, above{' + eq' if pessimistic or by_id else ''} + 1 as rank, round(ts, 5) as target_score, round(bo, 5) as best_other from oc)
""" + (last or "select *, round(case when rank <= 10 then 1.0::double / rank else 0 end, 6) as rr, (rank <= 10)::int as hit from rk")


_WHOLE = "select doc, 0 as u, tokens from dt"
def _windows_sql(size: int, stride: int) -> str:
    return f"select doc, i as u, tokens[i * {stride} + 1 : i * {stride} + {size}] as tokens from (select doc, tokens, unnest(range(greatest(0, ceil((len(tokens) - {size}) / {stride}.0))::int + 1)) as i from dt)"


_UNIT = "list_transform({v}::double[], lambda x: x / sqrt(list_dot_product({v}::double[], {v}::double[])))"
_VECTORS = f"""c0 as (select chunk_id, did, {_UNIT.format(v='dv')} as v, subject_id as grp from chunk_vec left join documents on doc_id = did where dv is not null and len(dv) = 64 and list_dot_product(dv::double[], dv::double[]) > 0 and did is not null),
qs as (select chunk_id as q, did as target, v, grp from c0 where chunk_id % 100 = 0), ch as (select chunk_id, did as doc, v, grp from c0)"""


def _dense_sql(prepare: str = "", chunks: str = "ch", asked: str = "qs", masked: bool = False, score: str = "list_dot_product({asked}.v, {chunks}.v)", where: str = "{chunks}.chunk_id <> q") -> str:
    skip = "doc <> target" + (" and (qg is null or dg is null or qg <> dg)" if masked else "")
    return f"""with {_VECTORS}{prepare},
s as (select q, target, doc, any_value({asked}.grp) as qg, any_value({chunks}.grp) as dg, max(round({score.format(asked=asked, chunks=chunks)}, 9)) as s from {asked}, {chunks} where {where.format(chunks=chunks)} group by 1, 2, 3),
tg as (select q, s as ts from s where doc = target),
o as (select q as query, target, ts, count(*) filter (where s > ts and {skip}) + 1 as rank, max(s) filter (where {skip}) as bo from s join tg using (q) group by 1, 2, 3)
select query, target, rank, round(ts, 5) as target_score, round(ts - bo, 5) as margin, (rank <= 10)::int as hit from o"""


_LAST = "select query, target, rank, round(ts, 5) as target_score, round(ts - bo, 5) as margin, (rank <= 10)::int as hit from o"


def unrounded(name: str) -> str:
    """A dense query's SQL down to query, ts (target score) and bo (best other)."""
    return ORACLE[name].replace(_LAST, "select query, ts, bo from o")


_SUM = "(select doc, any_value(grp) as grp, list(x order by k) as v from (select doc, k, sum(v[k]) as x, any_value(grp) as grp from ch, range(1, 65) as r(k) group by 1, 2) group by 1)"
_REST = "list_transform(list_zip(sm, qs.v), lambda x: x[1] - x[2])"
_CENTRE = "(select list(x order by k) as m from (select k, avg(v[k]) as x from ch, range(1, 65) as r(k) group by 1))"

ORACLE = {
    **extraction.oracle(_KEY),
    "dedup_norm_key": f"with {_DOCS} select doc_id from docs",
    "sentence_df": """with s as (select doc_id, unnest(string_split(regexp_replace(text, '([.!?])[ \\n\\t]+', '\\1' || chr(1), 'g'), chr(1))) as s from documents where text is not null),
k as (select distinct doc_id, trim(regexp_replace(regexp_replace(lower(s), '[^a-z ]', ' ', 'g'), ' +', ' ', 'g')) as key from s where len(regexp_split_to_array(trim(s), ' +')) >= 6) select key, count(*) as documents from k group by 1""",
    "word_df_idf": """with d as (select doc_id, text from documents where text is not null), f as (select word, count(*) as documents from (select unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) as word from d) group by 1),
q as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) as word from d)
select doc_id, round(avg(ln((select count(*) from d)::double / (1 + coalesce(documents, 0)))), 6) as mean_idf, round(avg((documents is null)::int), 6) as missing from q left join f using (word) group by 1""",
    "leak_flag": f"with n as (select note_id, min(subject_id) as subject_id, min(charttime) as charttime, max(text) as text from discharge where text is not null group by 1), a as (select note_id, text, lead(text) over (partition by subject_id order by charttime nulls last, note_id) as aft from n), k as (select note_id, substr({_KEY.format(c='text')}, 1, 60) as h, {_KEY.format(c='aft')} as t from a where aft is not null) select note_id, h <> '' and contains(t, h) as leak from k",
    "bm25_rank_optimistic": _bm25_sql(_WHOLE),
    "bm25_rank_by_id": _bm25_sql(_WHOLE, by_id=True),
    "query_draws": "select q // 10 as target, (q % 10)::int as draw, rank, target_score from (" + _bm25_sql(_WHOLE, last="select query as q, rank, target_score from rk").replace(_SLICE, _SLICE.replace("qs as (", "q0 as (") + ", qs as (select q * 10 + i as q, tokens[a:a + n - 1] as tokens from q0, (values (0, 1, 12), (1, 1, 8), (2, 5, 8)) as d(i, a, n))").replace("where q = doc)", "where q // 10 = doc)").replace("doc <> q", "doc <> q // 10") + ")",
    "sentence_ends": "select doc_id, len(regexp_extract_all(text, '[.!?]\\s'))::int as ends from documents where text is not null",
    "dense_conditions": "select 'bare' as condition, query, target, rank, target_score, hit from (" + _dense_sql() + ") union all select 'instructed', query, target, rank, target_score, hit from ("
    + _dense_sql(f", mn as {_CENTRE}, r1 as (select chunk_id as q, did as target, subject_id as grp, list_transform(list_zip(dv::double[], m), lambda x: x[1] + x[2]) as v from chunk_vec left join documents on doc_id = did, mn where chunk_id % 100 = 0 and dv is not null and len(dv) = 64 and list_dot_product(dv::double[], dv::double[]) > 0 and did is not null), r2 as (select q, target, grp, {_UNIT.format(v='v')} as v from r1)", asked="r2") + ")",
    "bm25_rank_pessimistic": _bm25_sql(_WHOLE, True, True),
    "bm25_windowed": _bm25_sql(_windows_sql(384, 288)),
    "bm25_windowed_narrow": _bm25_sql(_windows_sql(192, 144)),
    "bm25_windowed_dfdoc": _bm25_sql(_windows_sql(192, 144), document_idf=True),
    "geo_rank_ratio": _bm25_sql(_WHOLE, last=""", e as (select quantile_cont(len(tokens), [0.25, 0.5, 0.75]) as e from dt), b as (select rk.rank, 1 + (len(tokens) > e[1])::int + (len(tokens) > e[2])::int + (len(tokens) > e[3])::int as q from rk join dt on doc = query, e),
m as (select q, count(*) as n, avg(ln(rank)) as m from b group by 1) select q as stratum, n, round(exp(m), 5) as geo_mean, round(exp(m - (select arg_min(m, q) from m)), 5) as ratio from m"""),
    "dense_rank_margin": _dense_sql(),
    "dense_same_group_masked": _dense_sql(masked=True),
    "dense_mean_pool": _dense_sql(f", p0 as {_SUM}, p as (select doc, grp, v as sm, {_UNIT.format(v='v')} as v from p0)", "p", score="case when doc = target then list_dot_product(qs.v, " + _REST + ") / sqrt(list_dot_product(" + _REST + ", " + _REST + ")) else list_dot_product(qs.v, p.v) end", where="(doc <> target or list_dot_product(" + _REST + ", " + _REST + ") > 1e-12)"),
    "dense_centered": _dense_sql(f", mn as {_CENTRE}, c1 as (select chunk_id, doc, grp, list_transform(list_zip(v, m), lambda x: x[1] - x[2]) as v from ch, mn), q1 as (select q, target, grp, list_transform(list_zip(v, m), lambda x: x[1] - x[2]) as v from qs, mn), c2 as (select chunk_id, doc, grp, {_UNIT.format(v='v')} as v from c1), q2 as (select q, target, grp, {_UNIT.format(v='v')} as v from q1)", "c2", "q2"),
    "dense_random_chunk": _dense_sql(", p as (select doc, arg_min(chunk_id, md5(concat('s:', chunk_id))) as chunk_id, arg_min(grp, md5(concat('s:', chunk_id))) as grp, arg_min(v, md5(concat('s:', chunk_id))) as v from ch group by 1)", "p"),
    "dispersion": f"""with {_VECTORS}, g as (select x.doc, list_dot_product(x.v, y.v) as d from ch x join ch y on x.doc = y.doc), a as (select doc, sqrt(count(*))::bigint as n, sum(d) as s, sum(d * d) as f from g group by 1)
select doc, n, case when n > 1 then round((s - n) / (n * (n - 1)), 6) end as pair_cosine, case when n > 1 then round(sqrt(s) / n, 6) end as centroid_cosine, case when n > 1 then round(n * n / f, 6) end as effective_rank from a""",
}
