"""Timetables in JSON, tables in pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import html
from ..sources import timetable as tt
from ..tables import load
from .registry import query

# one text for both engines: a JSON document of each order, every seventeenth cut off
_JSON = """concat('{"courses":[{"course_code":"CSC-', o_custkey % 900 + 100, '","course_title":"', {title}, '","abbreviation":"', substr({title}, 1, 3), case when o_custkey % 2 = 0 then ' (S)' else ' (R)' end, '","program_semester":"BS CS Semester ', {roman}, '","instructors":[', case when o_orderkey % 8 = 0 then '' else concat('"', {who}, '","Guest"') end,
 ']}],"schedule_slots":[{"course_code":"CSC-', o_custkey % 900 + 100, '","course_title":"', {title}, case o_custkey % 3 when 0 then ' (S)' when 1 then ' (R)' else '' end, '","day":"', {day}, '","room":"R', o_custkey % 40, '","time_slot":"', case when o_orderkey % 5 = 0 then 'TBA' else concat(9 + o_orderkey % 8, ':30-', 11 + o_orderkey % 8, ':00') end,
 '"},{"course_code":"PHY-', o_custkey % 90 + 100, '","course_title":"Physics (Rep)","day":"Friday","room":"R1","time_slot":"08:00-09:00"}]}')"""
_title = lambda a: f"concat({a(['Algebra', 'Logic', 'Networks', 'Graphics', 'Compilers'], 'o_custkey % 5')}, ' ', o_custkey % 90)"
_sql_pick = lambda xs, k: f"[{', '.join(map(repr, xs))}][{k} + 1]"
_spark_pick = lambda xs, k: f"array({', '.join(map(repr, xs))})[{k}]"
_PEOPLE, _ROMANS = ["Ann Fox", "Bo Reed", "Cy Hill"], list(tt.ROMAN)


def _document(pick, day: str) -> str:
    whole = _JSON.replace("{title}", _title(pick)).replace("{roman}", pick(_ROMANS, "o_custkey % 8")).replace("{who}", pick(_PEOPLE, "o_custkey % 3")).replace("{day}", day)
    return f"case when o_orderkey % 17 = 0 then left({whole}, 60) else {whole} end"


_SHAPE = '{"courses":[{"course_code":"VARCHAR","course_title":"VARCHAR","abbreviation":"VARCHAR","program_semester":"VARCHAR","instructors":["VARCHAR"]}],"schedule_slots":[{"course_code":"VARCHAR","course_title":"VARCHAR","day":"VARCHAR","room":"VARCHAR","time_slot":"VARCHAR"}]}'
_ENTRIES = f"""j as (select o_orderkey as doc, {_document(_sql_pick, 'dayname(o_orderdate)')} as j from orders), p as (select doc, json_transform(j, '{_SHAPE}') as j from j where json_valid(j)),
s as (select doc, unnest(j.schedule_slots) as s, j.courses as c from p), c as (select doc, s, list_filter(c, lambda x: x.course_code = s.course_code)[-1] as c from s),
e as (select doc, false as corrupt, s.course_code as code, s.day as day, case when contains(s.time_slot, '-') then split_part(s.time_slot, '-', 1) else 'TBA' end as start, case when contains(s.time_slot, '-') then split_part(s.time_slot, '-', 2) else 'TBA' end as "end", s.room as room,
  case regexp_extract(s.course_title, '\\(([^()]*)\\)', 1) when '' then 'Regular' when 'R' then 'Regular' when 'S' then 'Self-Support' else regexp_extract(s.course_title, '\\(([^()]*)\\)', 1) end as section, coalesce(c.instructors[1], 'TBA') as instructor, coalesce(c.course_title, s.course_title) as title,
  list_position([{', '.join(map(repr, _ROMANS))}], regexp_extract(c.program_semester, 'Semester (\\S+)', 1))::int as semester, coalesce(trim(regexp_replace(c.abbreviation, '\\([RS]\\)', '')), '') as abbreviation from c)"""


def _entries(spark, d):
    docs = load(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.expr(_document(_spark_pick, "date_format(o_orderdate, 'EEEE')")).alias("raw"))
    return tt.entries(docs, "doc", "raw")


@query(f"""with {_ENTRIES} select * from e union all select doc, true, null, null, null, null, null, null, null, null, null, null from j where not json_valid(j)""")
def timetable_json(spark, d):
    """A timetable of each order as JSON, read again; those cut off are told apart."""
    return _entries(spark, d)


_kind = "(o_orderkey // 20) % 40"
_ASKED = f"""q as (select o_orderkey as query_id, case when {_kind} < 16 then 'When is CSC-' || (o_custkey % 900 + 100) || ' class' when {_kind} < 20 then 'semester ' || (o_custkey % 8 + 1) || ' classes on ' || dayname(o_orderdate) when {_kind} = 20 then dayname(o_orderdate)
  else 'time table for ' || {_title(_sql_pick)} || ' ' || {_sql_pick(_PEOPLE, 'o_custkey % 3')} || case when {_kind} > 32 then ' on ' || dayname(o_orderdate) else '' end end as text from orders where o_orderkey % 20 = 0)"""


@query(f"""with {_ENTRIES}, {_ASKED}, h as (select distinct code, day, start, section, semester, lower(title || ' ' || code || ' ' || instructor || ' ' || abbreviation) as held from e),
a as (select query_id, nullif(regexp_extract(lower(text), '\\b({'|'.join(tt.DAYS)})\\b', 1), '') as q_day, upper(nullif(regexp_extract(lower(text), '\\b([a-z]{{2,5}}-[0-9]{{3,4}}[a-z]?)\\b', 1), '')) as q_code, nullif(regexp_extract(lower(text), '\\bsemester\\s+([0-9]+)\\b', 1), '')::int as q_semester,
  list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '\\b({'|'.join(tt.FILLERS)})\\b', ' ', 'g'), '\\s+'), lambda w: length(w) > 1)) as tokens from q),
k as (select *, coalesce(len(tokens) = 1 and tokens[1] = q_day, false) as only_day from a), t as (select distinct held from h),
m as (select query_id, held from k join t on len(list_filter(tokens, lambda w: contains(held, w))) >= greatest(1, len(tokens) - 1) where q_semester is null and not only_day),
f as (select k.query_id, k.q_day, 1 as rule, h.* from k join h on q_code = code union all select k.query_id, k.q_day, 2, h.* from k join h on q_semester = semester union all
  select k.query_id, k.q_day, 3, h.* from k join h on lower(h.day) = k.q_day where q_semester is null and only_day union all select k.query_id, k.q_day, 4, h.* from m join k using (query_id) join h using (held))
select query_id, code, day, start, section, min(rule)::int as rule from f where q_day is null or contains(lower(day), q_day) group by 1, 2, 3, 4, 5""")
def timetable_search(spark, d):
    """Questions of every twentieth order by code, semester, day or words, against all entries."""
    kind = "(o_orderkey div 20) % 40"
    day = "date_format(o_orderdate, 'EEEE')"
    text = f"""case when {kind} < 16 then concat('When is CSC-', o_custkey % 900 + 100, ' class') when {kind} < 20 then concat('semester ', o_custkey % 8 + 1, ' classes on ', {day}) when {kind} = 20 then {day}
      else concat('time table for ', {_title(_spark_pick)}, ' ', {_spark_pick(_PEOPLE, 'o_custkey % 3')}, case when {kind} > 32 then concat(' on ', {day}) else '' end) end"""
    asked = load(spark, d, "orders").where("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("query_id"), F.expr(text).alias("text"))
    return tt.search(_entries(spark, d), tt.questions(asked, "query_id", "text"), "query_id")


_TABLE = """concat(html, '<table><caption>Page ', page_id, '</caption><tr><th colspan="2">Where</th><th>Id</th></tr><tr><td>', {host}, '</td><td><a href="', url, '">link | here</a></td><td>', page_id, '</td></tr><tr><td colspan=3> </td></tr>',
 case when page_id % 3 = 0 then '<tr><td colspan="30">wide</td></tr>' else '' end, '</table><table><tr><td>a</td><td></td><td>b ', page_id % 7, '</td></tr><tr><td><table><tr><th>in</th></tr><tr><td>ner</td></tr></table></td></tr></table>')"""
_HOST = "regexp_extract(url, '^https?://([^/]+)', 1)"


@query(f"""with p as (select page_id, {_HOST} as host, url, page_id % 3 = 0 as wide from pages where html is not null), w as (select *, repeat('|   ', case when wide then 5 else 0 end) as pad, case when wide then 8 else 3 end as width from p)
select page_id, 0 as ord, 'Page ' || page_id || chr(10) || '| Where |  | Id |' || repeat('  |', width - 3) || chr(10) || '|' || repeat('---|', width) || chr(10) || '| ' || host || ' | [link / here](' || url || ') | ' || page_id || ' |' || repeat('  |', width - 3) || case when wide then chr(10) || '| wide |' || repeat('  |', 7) else '' end as text from w
union all select page_id, 1, 'a | b ' || page_id % 7 from p union all select page_id, 2, '| in |' || chr(10) || '|---|' || chr(10) || '| ner |' from p""")
def html_tables(spark, d):
    """The tables of each page, to which two are added: one with spans and a link, one without a head and with a table inside."""
    pages = load(spark, d, "pages").where("html is not null").select("page_id", F.expr(_TABLE.replace("{host}", _HOST)).alias("html"))
    return html.tables(pages, "page_id", "html")
