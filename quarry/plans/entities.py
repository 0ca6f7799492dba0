"""Numbers, course rows, statuses, near names and class predicates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import entities as en
from ..functions import text as tx
from ..operators import joins
from ..tables import load
from .registry import query

# Words that say nothing in a question about the department.
EVIDENCE_STOP = """
a an the is are was were be been do does did what which who whom how can could should would i me my you your it its this that
these those and or of for to in on at by with from about tell please show know want need university department computer
sciences hai hain kya ki ka ke ko mein mujhe apko iska aur kitni kitne science cs
""".split()

_stop = "[" + ", ".join(f"'{w}'" for w in EVIDENCE_STOP) + "]"


@query(f"""select doc_id, list_transform(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+(?:-[0-9]{{3}})?'), lambda w: not list_contains({_stop}, w) and (length(w) > 1 or regexp_matches(w, '^[0-9]$'))),
  lambda w: case when length(w) > 4 and ends_with(w, 's') and not ends_with(w, 'ss') then left(w, -1) else w end) as tokens from documents""")
def tokens_g1(spark, d):
    return load(spark, d, "documents").select("doc_id", tx.evidence_tokens(F.col("text"), EVIDENCE_STOP).alias("tokens"))


_known = "MAP {" + ", ".join(f"'{w}': {n}" for w, n in en.VALUES.items()) + "}"
_next = "coalesce({m}[w[i + 1]], {none})"


@query(f"""with t as (select conv_id, turn, translate(text || ' twenty one weeks, ' || turn || ' hundred or two thousand and ninety; 1,500', '{en.OTHER_DIGITS}', '01234567890123456789') as v from conversations),
w as (select conv_id, turn, v, regexp_extract_all(lower(v), '[a-z]+') as w from t),
s as (select *, list_transform(list_filter(range(1, len(w) + 1), lambda i: map_contains({_known}, w[i])), lambda i: case when w[i + 1] = 'hundred' then {_known}[w[i]] * 100 when w[i + 1] = 'thousand' then {_known}[w[i]] * 1000
  when {_known}[w[i]] >= 20 and {_known}[w[i + 1]] < 10 then {_known}[w[i]] + {_known}[w[i + 1]] else {_known}[w[i]] end) as said from w)
select conv_id, turn, list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(v, '[0-9]+(?:[.,][0-9]+)*'), lambda n: replace(n, ',', '')), list_transform(said, lambda n: n::varchar)))) as numbers from s""")
def numbers_in_text(spark, d):
    t = F.concat("text", F.lit(" twenty one weeks, "), F.col("turn").cast("string"), F.lit(" hundred or two thousand and ninety; 1,500"))
    return load(spark, d, "conversations").select("conv_id", "turn", en.numbers(t).alias("numbers"))


@query("""select p_partkey, 'CS-' || lpad((p_partkey % 1000)::varchar, 3, '0') as code, p_name as title, (p_size % 4 + 1)::int as lecture, (p_size % 2)::int as lab, (p_size % 4 + 1 + p_size % 2)::int as total from part where p_name is not null""")
def course_rows(spark, d):
    """A scheme's lines, printed from the columns and read again."""
    line = F.concat_ws(" ", F.format_string("CS-%03d:", F.col("p_partkey") % 1000), "p_name", F.lit("DC"), F.format_string("%d+%d", F.col("p_size") % 4 + 1, F.col("p_size") % 2))
    page = F.concat(F.lit("Semester I\n"), line, F.lit("\nTotal 18 credits"))
    return load(spark, d, "part").where("p_name is not null").select("p_partkey", F.inline(en.course_rows(page)))


_STATUS_SAID = """concat(case p_partkey % 5 when 0 then concat('I''ve passed CS ', p_partkey % 900 + 100, ' and MATH-', p_size + 200, ', but I failed math', p_size + 200, '. I am currently taking PHY-', p_size + 300)
 when 1 then concat('CS-', p_partkey % 900 + 100, ' is passed! PHY-', p_size + 300, ' was failed, and i did not pass BIO ', p_size + 400) when 2 then concat('This semester, I am doing CS-', p_size + 100, ' and CSC-', p_size + 110, '; CSC-', p_size + 110, ' is my current course')
 when 3 then concat('i got a B+ in PHY-', p_size + 300, '; ive received an F in CHM-', p_size + 200, '. i have already done with STA-', p_partkey % 900 + 100) else concat('i could not clear CS ', p_size + 100, ' but CS ', p_size + 100, ' has been successfully completed') end, ' ', p_name)"""
_status = lambda k: "list_concat(" + ", ".join("regexp_extract_all(t, '(?i)" + p.replace("'", "''") + "', 1)" for p in en.STATUS[k]) + ")"
_named = lambda k: tx.code_list_sql(f"array_to_string({_status(k)}, ' ; ')")


@query(f"""with s as (select p_partkey, lower({_STATUS_SAID}) as t from part where p_name is not null), c as (select p_partkey, list_distinct({_named('failed')}) as f, list_distinct({_named('in_progress')}) as g, list_distinct({_named('completed')}) as d from s)
select p_partkey, list_sort(f) as failed, list_sort(list_filter(g, lambda x: not list_contains(f, x))) as in_progress, list_sort(list_filter(d, lambda x: not list_contains(f, x) and not list_contains(g, x))) as completed from c""")
def status_parse(spark, d):
    """What students say of their courses, in five wordings, course first and last."""
    p = load(spark, d, "part").where("p_name is not null").select("p_partkey", F.expr(_STATUS_SAID).alias("said"))
    p = p.repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")  # a small file is one task otherwise, and patterns take long
    return p.select("p_partkey", en.course_status(F.col("said")).alias("s")).select("p_partkey", "s.*")


@query("""with c as (select p_partkey, p_brand as program, [p_size % 8 + 1, (p_size + 1) % 8 + 1] as semesters, [chr((65 + p_size % 4)::int), chr((82 + p_partkey % 2)::int)] as sections from part)
select p_partkey, program = 'Brand#11' and list_contains(semesters, 3) as class_ok, list_has_any(sections, ['R', 'S']) as section_ok from c""")
def tt_class_ok(spark, d):
    """Whether a class is of the program and semester asked for, and open to the sections that RS stands for."""
    s, k = F.col("p_size"), F.col("p_partkey")
    c = load(spark, d, "part").select("p_partkey", F.col("p_brand").alias("program"), F.array(s % 8 + 1, (s + 1) % 8 + 1).alias("semesters"), F.array(F.char(65 + s % 4), F.char(82 + k % 2)).alias("sections"))
    return c.select("p_partkey", ((F.col("program") == "Brand#11") & F.array_contains("semesters", F.lit(3).cast("long"))).alias("class_ok"), F.arrays_overlap("sections", F.array(F.lit("R"), F.lit("S"))).alias("section_ok"))


@query()
def fuzzy_course(spark, d):
    """Names without their last two letters, for every id divisible by 20, against all names."""
    p = load(spark, d, "part").where("p_name is not null")
    asked = p.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.expr("left(p_name, length(p_name) - 2)").alias("text"))
    return en.nearest_name(asked, p.select("p_partkey", F.col("p_name").alias("name")), "query_id", "p_partkey")


@query()
def text_diff(spark, d):
    """Each turn against the one before it in its conversation."""
    c = load(spark, d, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return en.text_diff(c.withColumn("before", before).where("before is not null"), ["conv_id", "turn"], "before", "text")


@query()
def mention_resolve(spark, d):
    """The opening words of benchmark items as names, in every document."""
    opening = lambda n: F.array_join(F.slice(tx.words(F.col("text")), 1, n), " ")
    names = load(spark, d, "benchmark").select("item_id", F.explode(F.array(opening(2), opening(4))).alias("name")).distinct()
    return en.mentions(load(spark, d, "documents"), names, "doc_id", "text", "item_id")


@query()
def ground_sentences(spark, d):
    """What an assistant's turn keeps if the turn before it is the evidence; one sentence in three is made to name what nobody said."""
    c = load(spark, d, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    claim = F.when(F.col("turn") % 3 == 0, " Dr. Nobody of XYZ teaches CS-999. It stays.").otherwise(" It stays.")
    c = c.withColumn("before", before).where("before is not null").select("conv_id", "turn", "before", F.concat("text", F.lit("."), claim).alias("answer"))
    return c.select("conv_id", "turn", F.array_join(en.grounded(F.col("answer"), F.col("before")), " ").alias("kept"))


_SESSIONS = "s as (select event_id, isodow(ts)::int as weekday, hour(ts) * 60 + minute(ts) as start, user_id % 25 as key, chr((65 + event_id % 4)::int) as section from events)"
_CLASSES = "c as (select s_suppkey as class_id, s_suppkey % 25 as key, s_nationkey % 3 as program, s_suppkey % 8 + 1 as semester, [chr((65 + s_suppkey % 4)::int), chr((66 + s_suppkey % 4)::int)] as sections from supplier)"


@query(f"""with {_SESSIONS}, {_CLASSES}, j as (select s.*, c.class_id, c.program, c.semester, list_contains(c.sections, s.section) as ok from s join c using (key) where weekday in (1, 3, 5) and start - 20 <= 660 and 660 < start + 90),
r as (select * from j qualify ok or not bool_or(ok) over (partition by event_id)) select event_id, class_id from r where program = 1 and semester in (1, 2, 3, 4)""")
def tt_select(spark, d):
    """Sessions of the days and minute asked for, with the classes of their section (all of the course, if none has it), of the program and semesters asked for."""
    s = load(spark, d, "events").select("event_id", ((F.dayofweek("ts") + 5) % 7 + 1).alias("weekday"), (F.hour("ts") * 60 + F.minute("ts")).alias("start"), (F.col("user_id") % 25).alias("key"), F.char(65 + F.col("event_id") % 4).alias("section"))
    k = F.col("s_suppkey")
    c = load(spark, d, "supplier").select(k.alias("class_id"), (k % 25).alias("key"), (F.col("s_nationkey") % 3).alias("program"), (k % 8 + 1).alias("semester"), F.array(F.char(65 + k % 4), F.char(66 + k % 4)).alias("sections"))
    asked = s.where("weekday in (1, 3, 5) and start - 20 <= 660 and 660 < start + 90")
    rows = joins.fallback_alike(asked, c, ["key"], F.array_contains("sections", F.col("section")), ["section"])
    return rows.where("program = 1 and semester in (1, 2, 3, 4)").select("event_id", "class_id")


_ASKED = """n as (select p_partkey, p_name || ' ' || translate(lpad(p_partkey::varchar, 12, '0'), '0123456789', 'abcdefghij') as name from part where p_name is not null),
q as (select p_partkey as query_id, case when p_partkey % 40 = 0 then 'Who is Dr. ' || name when p_partkey % 60 = 20 then 'Show me ' || name else 'Show me the ' || upper(name) || ' and small red gear' end as text from n where p_partkey % 20 = 0)"""
_found = lambda c, n, skip: f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z]+'), lambda w: length(w) >= {n} and not list_contains([{', '.join(map(repr, skip))}], w)))"


@query(f"""with {_ASKED}, nw as (select p_partkey, unnest({_found('name', 3, tx.TITLE_WORDS)}) as word from n), o as (select word, count(*) as n from nw group by 1),
qw as (select query_id, unnest({_found('text', 3, tx.TITLE_WORDS)}) as word from q),
s as (select query_id, p_partkey, sum(case when o.n = 1 then 2 else 1 end)::int as score, bool_or(o.n = 1) as own, count(*) as c from qw join nw using (word) join o using (word) group by 1, 2),
r as (select *, row_number() over (partition by query_id order by score desc, p_partkey) as k from s where own or c >= 3),
pn as (select p_partkey, {_found('name', 4, tx.STOP_WORDS)} as held from n), pq as (select query_id, {_found('text', 4, tx.STOP_WORDS)} as said from q),
f as (select query_id, p_partkey, count(*) over (partition by query_id) as k from pq join pn on len(said) >= 2 and list_has_all(held, said))
select query_id, 'person' as kind, p_partkey, score from r where k <= 3 union all select query_id, 'partial', p_partkey, null from f where k <= 2""")
def entity_match(spark, d):
    """People by the words of their names and things by a part of theirs, for every id divisible by 20, against all names."""
    k = F.col("p_partkey")
    own = F.translate(F.lpad(k.cast("string"), 12, "0"), "0123456789", "abcdefghij")
    n = load(spark, d, "part").where("p_name is not null").select("p_partkey", F.concat_ws(" ", "p_name", own).alias("name"))
    text = F.when(k % 40 == 0, F.concat(F.lit("Who is Dr. "), "name")).when(k % 60 == 20, F.concat(F.lit("Show me "), "name")).otherwise(F.concat(F.lit("Show me the "), F.upper("name"), F.lit(" and small red gear")))
    q = n.where("p_partkey % 20 = 0").select(k.alias("query_id"), text.alias("text"))
    who = en.people(q, n, "query_id", "p_partkey").select("query_id", F.lit("person").alias("kind"), "p_partkey", "score")
    return who.union(en.partial_names(q, n, "query_id", "p_partkey", tx.STOP_WORDS).select("query_id", F.lit("partial"), "p_partkey", F.lit(None).cast("int")))


_SCHEDULE = """i as (select l_orderkey as o_orderkey, list_sort(list(distinct s_name)) as instructors from lineitem join supplier on s_suppkey = l_suppkey where s_acctbal > 0 group by 1),
v as (select o_orderkey, o_orderpriority as session, dayname(o_orderdate) as day_of_week, o_orderkey % 8 as slot, 'R' || o_custkey % 50 as room, 'CSC-' || (o_custkey % 900 + 100) as code, coalesce(instructors, []) as instructors
  from orders left join i using (o_orderkey) where o_orderstatus <> 'P')"""


def _schedule(spark, d):
    """The active entries of a timetable with their active instructors' names, sorted; none for an entry without."""
    names = load(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    links = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").join(names, "l_suppkey")
    taught = links.groupBy("o_orderkey").agg(F.sort_array(F.collect_set("s_name")).alias("instructors"))  # the few of one entry
    room, code = F.concat(F.lit("R"), (F.col("o_custkey") % 50).cast("string")), F.concat(F.lit("CSC-"), (F.col("o_custkey") % 900 + 100).cast("string"))
    o = load(spark, d, "orders").where("o_orderstatus <> 'P'")
    o = o.select("o_orderkey", F.col("o_orderpriority").alias("session"), F.date_format("o_orderdate", "EEEE").alias("day_of_week"), (F.col("o_orderkey") % 8).alias("slot"), room.alias("room"), code.alias("code"))
    return o.join(taught, "o_orderkey", "left").withColumn("instructors", F.coalesce("instructors", F.array().cast("array<string>")))


@query(f"with {_SCHEDULE} select * from v")
def v_schedule(spark, d):
    return _schedule(spark, d)


@query(f"with {_SCHEDULE} select code, slot, room, list_sort(list_distinct(flatten(list(instructors)))) as instructors from v where day_of_week = 'Monday' and session = '2-HIGH' group by 1, 2, 3")
def courses_by_day(spark, d):
    """The courses of one day and session; entries of one course, slot and room are one row."""
    day = _schedule(spark, d).where("day_of_week = 'Monday' and session = '2-HIGH'")
    return day.groupBy("code", "slot", "room").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("instructors")))).alias("instructors"))


@query(f"with {_SCHEDULE} select day_of_week, slot, code, room, session from v where code ilike '%r1%' or room ilike '%r1%'")
def search_schedule(spark, d):
    """Entries whose code or room holds the term, whatever its case."""
    held = F.col("code").ilike("%r1%") | F.col("room").ilike("%r1%")
    return _schedule(spark, d).where(held).select("day_of_week", "slot", "code", "room", "session")
