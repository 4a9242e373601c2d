"""The same results as SQL over the same tables, independent of the operators."""

P4 = """
select labevent_id, row_id from (
  select l.labevent_id, c.row_id, row_number() over (partition by l.labevent_id order by abs(epoch_us(l.charttime) - epoch_us(c.charttime)), c.charttime, c.row_id) as k
  from labevents l join chartevents c on l.subject_id = c.subject_id and c.charttime between l.charttime - interval 2 hour and l.charttime + interval 2 hour
  where l.itemid = 50821 and c.itemid = 223835) where k = 1
"""

_GROUPS = """
with g as (select *, date_trunc('minute', charttime) as minute, coalesce(warning, 2) as w,
    (stay_id is not null)::int + (storetime is not null)::int + (value is not null)::int + (valuenum is not null)::int as filled
  from chartevents where subject_id is not null and itemid is not null and charttime is not null)
"""

P7 = _GROUPS + """
select first_row_id, kept_row_id from (
  select min(row_id) over (partition by subject_id, itemid, minute) as first_row_id, count(*) over (partition by subject_id, itemid, minute) as n, row_id as kept_row_id,
    row_number() over (partition by subject_id, itemid, minute order by w, filled desc, storetime desc nulls last, row_id) as k
  from g) where k = 1 and n >= 2
"""


def _field(c: str) -> str:
    return f"first_value({c}) over (partition by subject_id, itemid, minute order by ({c} is null)::int, w, storetime desc nulls last, row_id) as f_{c}"


P7_SURVIVORS = _GROUPS + f"""
, x as (select subject_id, itemid, minute, row_id, warning,
    row_number() over (partition by subject_id, itemid, minute order by w, filled desc, storetime desc nulls last, row_id) as k,
    count(*) over (partition by subject_id, itemid, minute) as n_copies, min(row_id) over (partition by subject_id, itemid, minute) as first_row_id,
    min(warning) over (partition by subject_id, itemid, minute) as f_warning, {", ".join(_field(c) for c in ("stay_id", "storetime", "value", "valuenum"))}
  from g)
select subject_id, itemid, minute, n_copies, first_row_id, row_id as kept_row_id, f_stay_id as stay_id, f_storetime as storetime, f_value as value, f_valuenum as valuenum, f_warning as warning
from x where k = 1
"""

P1 = """
with d as (select distinct note_id, text from discharge where text is not null and length(text) >= 240),
w as (select distinct note_id, md5(substr(text, i + 1, 240)) as h from (select note_id, text, unnest(range(length(text) - 239)) as i from d))
select distinct a.note_id as note_id_a, b.note_id as note_id_b from w a join w b on a.h = b.h and a.note_id < b.note_id
"""

P1_COVERAGE = """
with d as (select distinct note_id, text from discharge where text is not null),
w as (select note_id, i, md5(substr(text, i + 1, 240)) as h from (select note_id, text, unnest(range(greatest(0, length(text) - 239))) as i from d where length(text) >= 240)),
r as (select h from w group by 1 having count(distinct note_id) > 1), s as (select distinct note_id, i from w join r using (h)),
n as (select *, case when lag(i) over (partition by note_id order by i) + 240 >= i then 0 else 1 end as nw from s), k as (select *, sum(nw) over (partition by note_id order by i rows unbounded preceding) as k from n),
p as (select note_id, k, min(i) as a, max(i) + 240 as z from k group by 1, 2), c as (select note_id, sum(z - a)::bigint as shared_chars, count(*) as n_passages from p group by 1)
select x.note_id, (select max(length(text))::int from d where d.note_id = x.note_id) as n_chars, coalesce(shared_chars, 0) as shared_chars, coalesce(n_passages, 0) as n_passages
from (select distinct note_id from discharge where note_id is not null) x left join c using (note_id)
"""

P6 = """
with v as (select chunk_id, did, list_transform(dv::double[], lambda x: x / sqrt(list_dot_product(dv::double[], dv::double[]))) as v from chunk_vec where dv is not null and chunk_id is not null and did is not null and list_dot_product(dv::double[], dv::double[]) > 0),
s as (select a.chunk_id as a, b.chunk_id as b, round(list_dot_product(a.v, b.v), 9) as s from v a join v b on a.did <> b.did),
k as (select a, b, row_number() over (partition by a order by s desc, b) as k from s)
select distinct least(a, b) as chunk_id_a, greatest(a, b) as chunk_id_b from k where k <= 5
"""

ORACLE = {"p1_found": P1, "p1_coverage": P1_COVERAGE, "p6_found": P6, "p4_found": P4, "p7_found": P7, "p7_survivors": P7_SURVIVORS}
