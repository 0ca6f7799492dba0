"""Answer checking, query rewriting and small text analyses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import answers as an
from ..functions import text as tx
from ..operators import windows
from ..tables import load
from .registry import query

_W = "regexp_extract_all(lower(text), '[a-z0-9]+')"


@query("select conv_id, turn, regexp_matches(lower(text), '^(hi|hello|thanks|thank you|ok|bye)[ .!]*$') as smalltalk from conversations")
def smalltalk_flag(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", F.lower("text").rlike("^(hi|hello|thanks|thank you|ok|bye)[ .!]*$").alias("smalltalk"))


@query("select doc_id, case when lang = 'en' then left(text, 80) when n_chars < 500 then source end as view from documents where case when lang = 'en' then left(text, 80) when n_chars < 500 then source end is not null")
def typed_view(spark, d):
    view = F.when(F.col("lang") == "en", F.left("text", F.lit(80))).when(F.col("n_chars") < 500, F.col("source"))
    return load(spark, d, "documents").select("doc_id", view.alias("view")).where("view is not null")


@query("""select doc_id from documents where lang in ('en', 'de') and n_chars between 300 and 6000 and source <> 'src0' and not exists (select 1 from labels l where l.doc_id = documents.doc_id and l.toxic = 1)""")
def eligible_scope(spark, d):
    toxic = load(spark, d, "labels").where("toxic = 1").select("doc_id")
    docs = load(spark, d, "documents").where("lang in ('en', 'de') and n_chars between 300 and 6000 and source <> 'src0'").select("doc_id")
    return docs.join(toxic, "doc_id", "left_anti")


@query("""select p_partkey from part where p_size % 8 in (2, 4) and list_has_any(string_split(lower(p_type), ' '), ['steel', 'brass', 'economy', 'standard'])""")
def eligible_g1(spark, d):
    words = F.array(*map(F.lit, ("steel", "brass", "economy", "standard")))
    return load(spark, d, "part").where((F.col("p_size") % 8).isin(2, 4) & F.arrays_overlap(F.split(F.lower("p_type"), " "), words)).select("p_partkey")


@query("""select kind, name, arg_min(url, (case when regexp_matches(url, '[0-9]') then 1 else 0 end, length(url), url)) as url from (select regexp_extract(url, '^https?://([^/]+)', 1) as kind, length(html) // 500 as name, url from pages) group by 1, 2""")
def dedupe_entities(spark, d):
    p = load(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("kind"), F.expr("cast(length(html) as bigint) div 500").alias("name"), "url")
    return windows.first_per(p, ["kind", "name"], [F.when(F.col("url").rlike("[0-9]"), 1).otherwise(0), F.length("url"), F.col("url")])


@query("select page_id, url from pages where not regexp_matches(url, '^https') or url is null")
def pages_failed(spark, d):
    return load(spark, d, "pages").where(~F.col("url").rlike("^https") | F.col("url").isNull()).select("page_id", "url")


@query("""with t as (select vec_id, label from embeddings), p as (select a.vec_id as a, b.vec_id as b from t a join t b on a.label = b.label and a.vec_id < b.vec_id where abs(a.vec_id - b.vec_id) <= 12) select a, b from p""")
def close_pairs(spark, d):
    t = load(spark, d, "embeddings").select("vec_id", "label")
    # ids at most 12 apart are in the same range of 13 or in neighbouring ones, so no label's pairs are made
    cell = F.expr("vec_id div 13")
    a = t.select("label", F.col("vec_id").alias("a"), F.explode(F.array(cell, cell + 1)).alias("cell"))
    b = t.select("label", F.col("vec_id").alias("b"), cell.alias("cell"))
    return a.join(b, ["label", "cell"]).where("a < b and b - a <= 12").select("a", "b")


@query("""with n as (select lower(s_name) as w from supplier) select a.w as a, b.w as b from n a join n b on a.w < b.w where levenshtein(a.w, b.w) <= 1 and least(length(a.w), length(b.w)) >= 5""")
def close_names(spark, d):
    """Names one edit apart: such names are equal, or have a common form with one letter left out."""
    n = load(spark, d, "supplier").select(F.lower("s_name").alias("w")).where(F.length("w") >= 5)
    shorter = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.concat(F.left("w", i - 1), F.substr("w", i + 1)))
    form = n.select("w", F.explode(F.array_distinct(F.concat(F.array("w"), shorter))).alias("form"))
    met = form.withColumnRenamed("w", "a").join(form.withColumnRenamed("w", "b"), "form").where("a < b").select("a", "b").distinct()
    return met.where(F.levenshtein("a", "b", 1) >= 0)


# Student wording and the wording of the regulations that is added to it.
SYNONYMS = [
    (r"(start|starts|starting|begin|begins|beginning)", "commence commences commencement"),
    (r"(end|ends|ending|finish)", "ends conclude"),
    (r"(final|finals|final exams?)", "terminal examination exams"),
    (r"(mid ?terms?|mids?)", "sessional mid-term"),
    (r"(exam|exams)", "examination"),
    (r"(deadline|last day)", "last date"),
    (r"(hod|head of (the )?department|chairman|chair)", "chairperson"),
    (r"(teacher|teachers|sir|madam|lecturer|instructor)", "faculty instructor taught"),
    (r"(subject|subjects)", "course courses"),
    (r"(pre ?req|pre-?requisites?|prereqs?)", "prerequisites"),
    (r"(cgpa|gpa)", "grade point average cgpa"),
    (r"(freeze|freezing|defer|deferment)", "freezing semester"),
    (r"(drop|withdraw)", "dropping change courses"),
    (r"(fail|failed|failing)", "repeat probation"),
    (r"(credit hours?|cr\.? ?hrs?|credits)", "credit hours"),
    (r"(fees?|tuition)", "fee structure dues"),
    (r"(apply|applying|application)", "admission apply online"),
    (r"(eligib\w+|requirements?|qualif\w+)", "eligibility minimum admission requirements"),
    (r"(phone|call|number)", "phone contact"),
    (r"(mail|email|e-mail)", "email"),
    (r"(office|room|sit|sits|sitting)", "office room"),
    (r"(timetable|time ?table|schedule)", "timetable schedule"),
    (r"(bscs|bs cs|bs\s*\(?cs\)?|undergrad\w*)", "BS Computer Science"),
    (r"(mphil|m\.phil)", "MPhil"),
    (r"(ms ?ds|data science masters?)", "MS Data Science"),
    (r"(ist)", "Information Science Technology"),
    (r"(ai)", "Artificial Intelligence"),
    (r"(ml)", "Machine Learning"),
    (r"(nlp)", "Natural Language Processing"),
    (r"(os)", "Operating Systems"),
    (r"(dbs|dbms|database)", "Database Systems"),
    (r"(oop)", "Object Oriented Programming"),
    (r"(ds)", "Data Structures"),
    (r"(hci)", "Human Computer Interaction"),
    (r"(fyp|final year project)", "Final Year Project"),
    (r"(coa|coal)", "Computer Organization Assembly Language"),
]
# How semesters are counted before and after the word.
BEFORE = {"first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "1st": 1, "2nd": 2, "3rd": 3, "4th": 4, "5th": 5, "6th": 6, "7th": 7, "8th": 8}
AFTER = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "viii": 8, "vii": 7, "vi": 6, "iv": 4, "v": 5, "iii": 3, "ii": 2, "i": 1}
SEMESTERS = [(rf"\b({'|'.join(BEFORE)})\s+(?:semester|sem)\b", BEFORE), (rf"\b(?:semester|sem)\s+({'|'.join(AFTER)})\b", AFTER)]
_BORDER = "(^|[^\\p{L}\\p{N}_])%s($|[^\\p{L}\\p{N}_])"  # a word border that every engine takes alike
_RULES = [(_BORDER % p, words) for p, words in SYNONYMS]
_SAID = "text || case item_id % 4 when 0 then ' fees in the 3rd semester and Semester iv' when 1 then ' what is OOP; prereqs, FYP deadline' else '' end"
_counted = lambda p, names: f"coalesce(array_to_string(list_transform(regexp_extract_all(lower(t), '{p}', 1), lambda w: ' semester ' || (MAP {{{', '.join(f'{k!r}: {v}' for k, v in names.items())}}})[w]), ''), '')"


@query(f"select item_id, t || {' || '.join(_counted(p, names) for p, names in SEMESTERS)} || " + " || ".join(f"case when regexp_matches(lower(t), '{p}') then ' {words}' else '' end" for p, words in _RULES) + f" as expanded from (select item_id, {_SAID} as t from benchmark)")
def expand_query(spark, d):
    """Every item as a question, some with a semester or a course's short name in it."""
    k = F.col("item_id") % 4
    said = F.concat("text", F.when(k == 0, " fees in the 3rd semester and Semester iv").when(k == 1, " what is OOP; prereqs, FYP deadline").otherwise(""))
    return load(spark, d, "benchmark").select("item_id", an.expand(said, _RULES, SEMESTERS).alias("expanded"))


@query("""select item_id, trim(regexp_replace(regexp_replace(lower(translate(text, '٠١٢٣٤٥٦٧٨٩', '0123456789')), '\\bu\\b', 'you', 'g'), '[ \\n]+', ' ', 'g'), ' ') as question from benchmark""")
def normalize_query(spark, d):
    return load(spark, d, "benchmark").select("item_id", an.normalize(F.col("text"), {"u": "you"}).alias("question"))


@query(f"""with e as (select doc_id, {_W} as w from documents), b as (select item_id, list_distinct(list_filter({_W}, lambda x: length(x) >= 4)) as t from benchmark)
select item_id, doc_id, len(t) as n, round(len(list_intersect(t, w)) / len(t), 6) as support from b join e on doc_id % 400 = item_id % 400 where len(t) >= 3""")
def support_ratio(spark, d):
    """How much of an item's words its evidence has; the evidence of an item is the documents of its number, modulo 400."""
    e = load(spark, d, "documents").select("doc_id", (F.col("doc_id") % 400).alias("k"), tx.words(F.col("text")).alias("evidence"))
    t = F.array_distinct(F.filter(tx.words(F.col("text")), lambda x: F.length(x) >= 4))
    b = load(spark, d, "benchmark").select("item_id", (F.col("item_id") % 400).alias("k"), t.alias("t")).where("size(t) >= 3").join(e, "k")
    return b.select("item_id", "doc_id", F.size("t").cast("long").alias("n"), F.round(F.size(F.array_intersect("t", "evidence")) / F.size("t"), 6).alias("support"))


@query("""with n as (select doc_id, source, list_distinct(regexp_extract_all(text, '[0-9]+')) as nums from documents), e as (select doc_id, nums, lag(nums) over (partition by source order by doc_id) as before from n)
select doc_id, list_sort(list_filter(nums, lambda x: not list_contains(coalesce(before, []), x))) as unsupported from e where len(nums) > 0""")
def numeric_provenance(spark, d):
    """Numbers of a document that the one before it of its source does not have."""
    nums = F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)))
    e = load(spark, d, "documents").select("doc_id", "source", nums.alias("nums")).withColumn("before", F.lag("nums").over(Window.partitionBy("source").orderBy("doc_id")))
    return e.where("size(nums) > 0").select("doc_id", F.sort_array(F.array_except("nums", F.coalesce("before", F.array().cast("array<string>")))).alias("unsupported"))


@query("select event_id, case when event_id % 3 = 0 then '[1][2]' when event_id % 3 = 1 then '[2]' else '' end as citations from events")
def citations(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, "see [1, 2] and [9]").when(F.col("event_id") % 3 == 1, "see [2][7]").otherwise("see nothing")
    return load(spark, d, "events").select("event_id", an.citations(raw, 5).alias("citations"))


@query()
def rouge_l(spark, d):
    c = load(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = c.withColumn("reference", F.lag("text").over(w)).where("reference is not null")
    return an.rouge_l(pairs, ["conv_id", "turn"], "text", "reference")


@query("""with t as (select label % 3 as label, vec_id, (embedding[1] > 0)::int as f1, (embedding[2] > 0)::int as f2 from embeddings), c as (select label, count(*) as n, sum(f1) as a, sum(f2) as b from t group by 1), n as (select sum(n) as total from c),
s as (select vec_id, c.label, ln(n / total) + ln(case f1 when 1 then (a + 1) / (n + 2) else (n - a + 1) / (n + 2) end) + ln(case f2 when 1 then (b + 1) / (n + 2) else (n - b + 1) / (n + 2) end) as score from t, c, n) select vec_id, arg_max(label, (round(score, 9), -label)) as label from s group by 1""")
def nb_intent(spark, d):
    e = load(spark, d, "embeddings").select((F.col("label") % 3).alias("label"), "vec_id", F.array((F.get("embedding", F.lit(0)) > 0).cast("int"), (F.get("embedding", F.lit(1)) > 0).cast("int")).alias("f"))
    return an.naive_bayes(e, "vec_id", "label", "f", 2)


@query("""select conv_id, turn, case when regexp_matches(lower(text), 'how|why') then 'explain' when regexp_matches(lower(text), 'what|which') then 'lookup' when regexp_matches(text, '\\?') then 'question' else 'other' end as intent from conversations where role = 'user'""")
def intent_rules(spark, d):
    t = F.lower("text")
    intent = F.when(t.rlike("how|why"), "explain").when(t.rlike("what|which"), "lookup").when(t.rlike("\\?"), "question").otherwise("other")
    return load(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", intent.alias("intent"))


@query("""select p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '\\([^)]*\\)', ' ', 'g'), '&', ' and ', 'g'), '[^a-z0-9]+', ' ', 'g'), ' ') as title from part""")
def norm_title(spark, d):
    return load(spark, d, "part").select("p_partkey", an.norm_title(F.col("p_name")).alias("title"))


@query()
def fix_mojibake(spark, d):
    return an.fix_mojibake(load(spark, d, "documents"), "doc_id", "text")


@query("""with s as (select doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as n_terms, upper(source) as up from documents) select doc_id, n_terms, [up, replace(up, 'SRC', 'SRC-'), replace(up, 'SRC', 'SRC ')] as aliases from s""")
def code_aliases(spark, d):
    up = F.upper("source")
    alias = [up, F.replace(up, F.lit("SRC"), F.lit("SRC-")), F.replace(up, F.lit("SRC"), F.lit("SRC "))]
    return load(spark, d, "documents").select("doc_id", F.size(F.array_distinct(tx.words(F.col("text")))).cast("long").alias("n_terms"), F.array(*alias).alias("aliases"))


@query("""select event_id, case when h = 0 then 12 when h > 12 then h - 12 else h end || ':' || lpad(m::varchar, 2, '0') || case when h < 12 then ' AM' else ' PM' end as shown from (select event_id, hour(ts) as h, minute(ts) as m from events)""")
def fmt_range(spark, d):
    return load(spark, d, "events").select("event_id", an.clock(F.hour("ts"), F.minute("ts")).alias("shown"))


@query("select n_nationkey, case n_nationkey % 100 when 11 then n_nationkey || 'th' when 12 then n_nationkey || 'th' when 13 then n_nationkey || 'th' else n_nationkey || case n_nationkey % 10 when 1 then 'st' when 2 then 'nd' when 3 then 'rd' else 'th' end end as shown from nation")
def ordinal(spark, d):
    return load(spark, d, "nation").select("n_nationkey", an.ordinal(F.col("n_nationkey")).alias("shown"))


@query(r"""select doc_id, regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', 0) as mail, regexp_extract(text, '\+[0-9][0-9 ().-]+[0-9]', 0) as phone from documents where regexp_matches(text, '@|\+[0-9]')""")
def contacts(spark, d):
    docs = load(spark, d, "documents").where(F.col("text").rlike(r"@|\+[0-9]"))
    return docs.select("doc_id", F.regexp_extract("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", 0).alias("mail"), F.regexp_extract("text", r"\+[0-9][0-9 ().-]+[0-9]", 0).alias("phone"))


@query("""select source, string_agg(left(text, 40), ' / ' order by n_chars, doc_id) as body from documents where lang = 'en' and n_chars < 200 group by 1""")
def assemble_text(spark, d):
    docs = load(spark, d, "documents").where("lang = 'en' and n_chars < 200").select("source", F.struct("n_chars", "doc_id", F.left("text", F.lit(40)).alias("t")).alias("s"))
    return docs.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), " / ").alias("body"))


@query("""select conv_id, turn, regexp_matches(text, 'th') and regexp_matches(text, 'e') as has_facts, not regexp_matches(lower(text), 'license') as clean, regexp_matches(lower(text), 'not (found|sure)') as abstains from conversations where role = 'assistant'""")
def grade_rules(spark, d):
    t = F.col("text")
    return load(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", an.all_match(t, ["th", "e"]).alias("has_facts"), (~an.any_match(F.lower(t), ["license"])).alias("clean"), F.lower(t).rlike("not (found|sure)").alias("abstains"))


@query("""select lang, count(*) as total, count(*) filter (quality = 1) as passed, round(avg(quality), 6) as share from documents join labels using (doc_id) group by 1""")
def eval_by_cat(spark, d):
    j = load(spark, d, "documents").select("doc_id", "lang").join(load(spark, d, "labels"), "doc_id")
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("quality") == 1).alias("passed"), F.round(F.avg("quality"), 6).alias("share"))


@query("""with recursive e as (select p_partkey as child, p_partkey // 2 as parent from part where p_partkey >= 1), w(start, node) as (select child, parent from e union all select w.start, e.parent from w join e on e.child = w.node),
g as (select l_partkey as node, max(l_discount) as best from lineitem group by 1) select start, count(*) as n, count(*) filter (coalesce(best, -1) < 0.05) as failing from w left join g using (node) group by 1""")
def grade_check(spark, d):
    from ..operators import graph

    e = load(spark, d, "part").where("p_partkey >= 1").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 2").alias("parent"))
    g = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.max("l_discount").alias("best"))
    c = graph.closure(e).join(g, "node", "left")
    return c.groupBy("start").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("best", F.lit(-1.0)) < 0.05).alias("failing"))


@query("""with f as (select min(s_suppkey) as k from supplier where s_name ilike '%#00000000%') select l_orderkey, l_linenumber, l_shipdate::date as day from lineitem, f where l_suppkey = k""")
def instructor_schedule(spark, d):
    first = load(spark, d, "supplier").where(F.col("s_name").ilike("%#00000000%")).agg(F.min("s_suppkey").alias("l_suppkey"))
    return load(spark, d, "lineitem").join(F.broadcast(first), "l_suppkey").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("day"))  # one row


@query("select p_brand, l_shipdate::date as day, count(*) as n from lineitem join part on l_partkey = p_partkey where p_brand = 'Brand#11' group by 1, 2")
def room_schedule(spark, d):
    rooms = load(spark, d, "part").where("p_brand = 'Brand#11'").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return load(spark, d, "lineitem").join(rooms, "l_partkey").groupBy("p_brand", F.to_date("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query()
def extractive_top4(spark, d):
    q = F.array(*map(F.lit, ("the", "of", "and", "in", "der", "de")))
    return load(spark, d, "documents").select("doc_id", an.extract(F.col("text"), q, 4, 700).alias("summary"))


@query()
def hash_embed(spark, d):
    return an.hash_embed(load(spark, d, "benchmark"), "item_id", "text", 384)
