"""SQL of the query extraction: lines, sentences, prose runs, queries, and stretches taken out, in plain relational steps."""

from __future__ import annotations

import re

from seriatim.functions import text as tx


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _scrub(c: str) -> str:
    for pattern in tx.BLANKED:
        c = f"regexp_replace({c}, {_quoted(pattern)}, ' ', 'g')"
    for long, short in tx.ABBREVIATIONS.items():
        c = f"regexp_replace({c}, {_quoted('(?i)' + re.escape(long))}, '{short}', 'g')"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def _pieces(c: str, pattern: str, with_: str = "chr(1)") -> str:
    split = f"string_split(regexp_replace({c}, '{pattern}', {with_}, 'g'), chr(1))"
    return f"unnest({split}) as s, generate_subscripts({split}, 1)"


_HEADER = f"regexp_matches(s, {_quoted(tx.HEADER)})"
_WORDS = "(case when s = '' then 0 else len(string_split(s, ' ')) end)"
_BOILERPLATE = f"""(regexp_matches(s, {_quoted(tx.BANNER)}) or len(regexp_extract_all(s, {_quoted(tx.LABEL)})) >= 2
  or length(regexp_replace(s, '[^\\p{{L}}\\s]', '', 'g')) < 0.75 * length(s) or (upper(s) = s and lower(s) <> s and {_WORDS} < 10))"""

NOTES = "nt as (select note_id, max(text) as text from discharge where text is not null and note_id is not null group by 1)"

RUNS = f"""{NOTES},
ln as (select note_id, {_pieces("text", tx.LINE)} as i from nt),
sc as (select note_id, i, {_scrub("s")} as s from ln),
jn as (select *, coalesce(lag(s) over (partition by note_id order by i), '') as b from sc),
gr as (select *, sum(case when s <> '' and b <> '' and not regexp_matches(b, '[.!?:]$') and not {_HEADER} and not regexp_matches(s, '^\\p{{Lu}}') then 0 else 1 end)
  over (partition by note_id order by i rows unbounded preceding) as k from jn),
wl as (select note_id, k, string_agg(s, ' ' order by i) as line from gr group by 1, 2 having string_agg(s, ' ' order by i) <> ''),
se as (select note_id, k, {_pieces("line", "([.!?])" + chr(92) + "s+", "chr(92) || '1' || chr(1)")} as j from wl),
st as (select note_id, row_number() over (partition by note_id order by k, j) as pos, s, trim(regexp_replace(regexp_replace(lower(s), '[^a-z ]', ' ', 'g'), ' +', ' ', 'g')) as key
  from (select note_id, k, j, trim(s) as s from se) where s <> '' and not {_HEADER} and not {_BOILERPLATE}),
fq as (select key, count(*) as documents from (select distinct note_id, key from st where {_WORDS} >= 6) group by 1),
pr as (select * from st where {_WORDS} >= 10 and regexp_matches(s, {_quoted(tx.VERB)}) and key not in (select key from fq where documents > 3)),
rn as (select *, pos - row_number() over (partition by note_id order by pos) as run from pr),
rl as (select *, row_number() over (partition by note_id, run order by pos) - 1 as place, count(*) over (partition by note_id, run) as n from rn)"""

QUERIES = f"""{RUNS},
bq as (select *, row_number() over (partition by note_id order by n desc, run, pos) as r from rl),
qx as (select note_id, string_agg(s, ' ' order by pos) as query from bq where r <= 2 and place < 2 group by 1)"""

_LETTERS = "list_transform(regexp_extract_all({c}, '\\S+'), lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g'))"


def stretches(texts: str) -> str:
    """CTEs over (note_id, text, query): w, c, q per note; g: the good stretches of the first start that has any; f: beginnings that stand somewhere."""
    return f"""cq as (select note_id, text, query, regexp_extract_all(text, '\\S+') as w, {_LETTERS.format(c="text")} as c, list_filter({_LETTERS.format(c="coalesce(query, '')")}, lambda x: length(x) >= 2) as q from {texts}),
sp as (select note_id, c, q, unnest(list_filter(range(1, len(c) + 1), lambda i: c[i] = q[1])) as s from cq where len(q) >= 5),
en as (select note_id, unnest(list_filter(range(1, len(c) + 1), lambda i: c[i] = q[len(q)])) as e from cq where len(q) >= 5),
me as (select note_id, q, s, e, list_filter(c[s:e], lambda x: x <> '') as part from sp join en using (note_id) where e >= s and e < s + floor(2.5 * len(q))::int + 10),
sh as (select note_id, s, e, len(list_filter(part, lambda x: list_contains(q, x))) / len(part)::double as a, len(list_intersect(list_distinct(part), list_distinct(q))) / len(list_distinct(q))::double as b from me),
gd as (select *, min(s) over (partition by note_id) as s0 from sh where a >= 0.6 and b >= 0.6),
g as (select note_id, s, e, row_number() over (partition by note_id order by a + b desc, e) as r from gd where s = s0),
fb as (select note_id, s, unnest(range(5, len(q) + 1)) as n, c, q from sp where note_id not in (select note_id from g)),
f as (select note_id, s, n, row_number() over (partition by note_id order by n desc, s) as r from fb where list_filter(c[s:s + 2 * n - 1], lambda x: x <> '')[1:n] = q[1:n]),
cutout as (select note_id, s, e from g where r = 1 union all select note_id, s, s + 2 * n - 1 from f where r = 1),
rm as (select cq.note_id, query, array_to_string(case when s is null then w else w[1:s - 1] || w[e + 1:] end, ' ') as target from cq left join cutout using (note_id))"""


def reasons(key: str) -> str:
    """CTE of the pairs: note_id, target, reason."""
    a, b = key.format(c="query"), key.format(c="target")
    return f"""rs as (select note_id, target, case when query is null then 'no_query' when length(target) < 100 then 'gutted'
  when substr({a}, 1, 60) <> '' and contains({b}, substr({a}, 1, 60)) then 'leak' else 'ok' end as reason from rm)"""


def oracle(key: str) -> dict[str, str]:
    pairs = f"with {QUERIES}, nq as (select * from nt left join qx using (note_id)), {stretches('nq')}, {reasons(key)}"
    windows = f"""with {RUNS}, wd as (select note_id, run, place // 2 as k, min(pos) as pos, string_agg(s, ' ' order by pos) as query from rl where (place // 2 + 1) * 2 <= n group by 1, 2, 3),
wn as (select note_id, query, row_number() over (partition by note_id order by pos) - 1 as "window", count(*) over (partition by note_id) as c from wd)"""
    return {
        "sentence_frequency": f"with {RUNS} select key, documents from fq",
        "prose_runs": f"with {RUNS} select note_id, sentences, first from (select note_id, run, count(*) as sentences, (min(pos) - 1)::int as first from rl group by 1, 2)",
        "query_extract": f"with {QUERIES} select note_id, query from qx",
        "query_removed": f"{pairs} select note_id, reason, length(target)::int as target_chars from rs",
        "extraction_accounting": f"{pairs} select reason, count(*) as n from rs group by 1",
        "query_position": f"""with {QUERIES}, nq as (select * from nt join qx using (note_id)), {stretches('nq')},
fs as (select note_id, min(s) as s from g group by 1),
ps as (select cq.note_id, s, len(w) as n, regexp_extract_all(text, '\\s*\\S+') as p from cq left join fs using (note_id)),
ch as (select *, case when n = 0 then 0 else 1 + ceil(greatest(0, n - 510) / 384.0)::int end as chunks, coalesce(s - 1, -1) as word from ps)
select note_id, coalesce(length(array_to_string(p[1:s - 1], '')) + length(p[s]) - length(regexp_replace(p[s], '^\\s+', '')), -1)::int as at,
  (case when n = 0 then -1 when word < 510 then 0 else least((word - 510 + 384) // 384, chunks - 1) end)::int as chunk, chunks::int as chunks from ch""",
        "eligible_windows": f"{windows} select note_id, count(*) as windows from wn group by 1",
        "eligible_share": f"{windows} , p as (select note_id, count(*) as n from wn group by 1) select round(avg((coalesce(n, 0) >= 5)::int), 6) as share, round(avg(coalesce(n, 0)), 6) as mean, count(*) as notes from nt left join p using (note_id)",
        "drawn_windows": f"""{windows} select note_id, "window"::int as "window" from (select *, row_number() over (partition by note_id order by md5(concat('s:', note_id, ':', "window"))) as r from wn) where c >= 2 and r <= 2""",
    }
