"""Text, URL and page queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunks
from ..functions import text as tx
from ..functions import urls
from ..operators import metrics, windows
from ..sources import csvio, html
from ..tables import load
from .registry import query

_TOK = tx.tokens_sql("text")
_ENDS = " ".join(f"when ends_with(w, '{e}') and length(w) >= {len(e) + 3} then left(w, -{len(e)}) || '{r}'" for e, r in tx.ENDINGS)


@query(f"select doc_id, {_TOK} as tokens from documents")
def tokenize(spark, d):
    return load(spark, d, "documents").select("doc_id", tx.tokens(F.col("text")).alias("tokens"))


@query(f"""with w as (select distinct unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from documents)
select w as word, case when length(w) <= 4 or regexp_matches(w, '[0-9]') or ends_with(w, 'ss') then w {_ENDS} else w end as stem from w""")
def stem(spark, d):
    words = load(spark, d, "documents").select(F.explode(tx.words(F.col("text"))).alias("word")).distinct()
    return words.select("word", tx.stem(F.col("word")).alias("stem"))


@query("select doc_id, sha1(lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'), ' '))) as text_sha1, left(sha1(concat_ws(chr(31), source, doc_id)), 16) as row_id from documents")
def stable_ids(spark, d):
    return load(spark, d, "documents").select("doc_id", tx.normal_hash(F.col("text")).alias("text_sha1"), tx.stable_id(F.col("source"), F.col("doc_id")).alias("row_id"))


@query("select min(doc_id) as doc_id, count(*) as n from documents group by sha1(lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'), ' ')))")
def dedupe_chunks(spark, d):
    h = load(spark, d, "documents").select("doc_id", tx.normal_hash(F.col("text")).alias("h"))
    return h.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).drop("h")


@query("""select page_id, url from (select *, row_number() over (partition by html order by length(url), page_id) as rn from pages) where rn = 1""")
def dedupe_pages(spark, d):
    pages = load(spark, d, "pages").select("page_id", "url", F.sha2("html", 256).alias("h"))
    return windows.keep_first_duplicate(pages, F.col("h"), [F.length("url"), F.col("page_id")]).select("page_id", "url")


@query("select doc_id, left(trim(regexp_replace(regexp_replace(text, '[*#|`]', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g'), ' '), 240) as snippet from documents")
def snippet(spark, d):
    return load(spark, d, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


@query(r"""select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', '[redacted]', 'g'), '\b[0-9]{5}-[0-9]{7}-[0-9]\b', '[redacted]', 'g'), '[0-9]{10,}', '[redacted]', 'g') as text from documents""")
def pii_redact(spark, d):
    return load(spark, d, "documents").select("doc_id", tx.redact(F.col("text")).alias("text"))


@query(r"""with c as (select doc_id, text, unnest(range(0, greatest(ceil((length(text) - 180) / 1020.0)::bigint, 1))) as k from documents) select doc_id, (k * 1020)::int as start, substr(text, k * 1020 + 1, 1200) as piece from c""")
def chunk_fixed(spark, d):
    return load(spark, d, "documents").select("doc_id", F.inline(tx.fixed_chunks(F.col("text"), 1200, 180)))


@query()
def chunk_sentence(spark, d):
    s = load(spark, d, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("ord", "sentence"))
    return s.withColumn("chunk", F.expr("ord div 5")).groupBy("doc_id", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "sentence"))), lambda x: x["sentence"]), " ").alias("text"))


@query()
def clean_text(spark, d):
    return load(spark, d, "documents").select("doc_id", tx.drop_repeated_lines(F.col("text")).alias("text"))


@query("""with l as (select source, doc_id, unnest(string_split(text, chr(10))) as line from documents), n as (select source, count(*) as docs from documents group by 1),
r as (select source, line from l join n using (source) where length(line) < 90 and trim(line, ' ') <> '' group by source, line, docs having count(distinct doc_id) >= greatest(2, 0.05 * docs)) select source, line from r""")
def strip_repeated(spark, d):
    """The lines that are headers or footers of their source."""
    docs = load(spark, d, "documents").select("source", "doc_id", "text")
    n = docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"))
    lines = docs.select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line")).where((F.length("line") < 90) & (F.trim("line") != "")).distinct()
    seen = lines.groupBy("source", "line").agg(F.count(F.lit(1)).alias("n"))
    return seen.join(n, "source").where(F.col("n") >= F.greatest(F.lit(2.0), 0.05 * F.col("docs"))).select("source", "line")


@query(r"""select doc_id, lang, case when letters = 0 then 'none' when (letters - plain) / letters > 0.012 then 'accented' else 'plain' end as script from (select doc_id, lang, length(regexp_replace(text, '[^\p{L}]', '', 'g')) as letters, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as plain from documents)""")
def detect_lang(spark, d):
    share = tx.script_share(F.col("text"))
    none = F.length(F.regexp_replace("text", "[^\\p{L}]", "")) == 0
    return load(spark, d, "documents").select("doc_id", "lang", F.when(none, "none").when(share > 0.012, "accented").otherwise("plain").alias("script"))


_PRED = r"case when letters = 0 or (letters - plain) / letters <= 0.012 then 'en' when text ~ '[äöüß]' then 'de' when text ~ '[ñóí]' then 'es' else 'fr' end"
_CLF = rf"c as (select lang, {_PRED} as pred from (select lang, text, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) as letters, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as plain from documents))"
_CLF = _CLF.replace("text ~ '[äöüß]'", "regexp_matches(text, '[äöüß]')").replace("text ~ '[ñóí]'", "regexp_matches(text, '[ñóí]')")


def _predicted(spark, d):
    t = F.col("text")
    pred = F.when(tx.script_share(t) <= 0.012, "en").when(t.rlike("[äöüß]"), "de").when(t.rlike("[ñóí]"), "es").otherwise("fr")
    return load(spark, d, "documents").select("lang", pred.alias("pred"))


@query(f"with {_CLF} select lang, pred, count(*) as n from c group by 1, 2")
def confusion(spark, d):
    return metrics.confusion(_predicted(spark, d), "lang", "pred")


@query(f"""with {_CLF}, a as (select lang as label, count(*) as na, count(*) filter (lang = pred) as tp from c group by 1), p as (select pred as label, count(*) as np from c group by 1),
m as (select coalesce(a.label, p.label) as label, coalesce(tp, 0) as tp, coalesce(na, 0) as na, coalesce(np, 0) as np from a full join p on a.label = p.label),
r as (select label, tp, case when np > 0 then tp / np else 0 end as pr, case when na > 0 then tp / na else 0 end as re from m)
select label, tp, round(pr, 6) as precision, round(re, 6) as recall, round(case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end, 6) as f1 from r""")
def clf_metrics(spark, d):
    return metrics.class_metrics(_predicted(spark, d), "lang", "pred")


@query("""with u as (select page_id, regexp_replace(trim(url, ' '), '#.*$', '') as u from pages), p as (select page_id, regexp_replace(lower(regexp_extract(u, '^[A-Za-z]+://([^/?]+)', 1)), '^(www|m)\\.', '') as host,
regexp_replace(regexp_extract(u, '^[A-Za-z]+://[^/?]+(.*)$', 1), '([?&])(ref|utm_[a-z]+|fbclid|gclid|session)=[^&]*', '\\1', 'g') as rest from u)
select page_id, 'https://' || host || regexp_replace(regexp_replace(regexp_replace(rest, '&+', '&', 'g'), '\\?&', '?', 'g'), '[?&/]+$', '') as url from p""")
def canonical_url(spark, d):
    return load(spark, d, "pages").select("page_id", urls.canonical(F.col("url")).alias("url"))


@query("""select page_id, case when regexp_matches(lower(url), 'faculty|people|staff') then 'people' when regexp_matches(lower(url), 'course|program|catalog') then 'course' when regexp_matches(lower(url), 'news|blog|event') then 'news'
when regexp_matches(lower(url), '\\.(pdf|docx?|xlsx?)$') then 'file' when regexp_matches(lower(url), '^https?://[^/]+/?$') then 'home' else 'page' end as kind from pages""")
def classify_url(spark, d):
    return load(spark, d, "pages").select("page_id", urls.kind(F.col("url")).alias("kind"))


@query("""select page_id, regexp_matches(url, '^https?://') and not regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '\\.(jpg|png|gif|zip|mp4|css|js)$|/(login|calendar|cart)(/|$)') and len(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) <= 2 as allowed from pages""")
def url_policy(spark, d):
    return load(spark, d, "pages").select("page_id", urls.allowed(F.col("url")).alias("allowed"))


@query("""select regexp_extract(url, '^https?://([^/]+)', 1) as host, count(*) as n, count(distinct html) as n_distinct from pages where length(html) > 0 group by 1""")
def pages_ok(spark, d):
    return load(spark, d, "pages").where(F.length("html") > 0).groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("html").alias("n_distinct"))


@query()
def html_to_text(spark, d):
    return html.page_text(load(spark, d, "pages"))


@query()
def html_text_simple(spark, d):
    return html.page_text(load(spark, d, "pages"), hide=html.FURNITURE, marks=False)


_trimmed = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


@query(rf"""with recursive t as (select doc_id, {_trimmed('text')} as t from documents where text is not null),
p(doc_id, t, ord, start, n) as (select doc_id, t, -1, 0, 0 from t union all
  select doc_id, t, ord + 1, onward, case when length(t) - onward <= 1000 then length(t) - onward when length(regexp_extract(w, '^(.*(?:\n|\. ))', 1, 's')) > 500 then length(regexp_extract(w, '^(.*(?:\n|\. ))', 1, 's')) when length(regexp_extract(w, '^(.* )', 1, 's')) > 500 then length(regexp_extract(w, '^(.* )', 1, 's')) else 1000 end
  from (select *, t[onward + 1 : onward + 1000] as w from (select *, case when n = 0 then 0 when instr(t[start + n - 139 : start + n], ' ') between 1 and 139 then start + n - 140 + instr(t[start + n - 139 : start + n], ' ') else start + n end as onward from p where ord < 0 or start + n < length(t))) where onward < length(t))
select doc_id, (row_number() over (partition by doc_id order by ord) - 1)::int as ord, x as text from (select doc_id, ord, {_trimmed('t[start + 1 : start + n]')} as x from p where ord >= 0) where x <> ''""")
def split_passages(spark, d):
    return load(spark, d, "documents").select("doc_id", F.posexplode(chunks.passages(F.col("text"))).alias("ord", "text"))


def _page_blocks(spark, d):
    return html.page_text(load(spark, d, "pages")).select("page_id", chunks.blocks(F.col("text")).alias("blocks"))


@query()
def md_blocks(spark, d):
    """Pages as Markdown, by heading path."""
    b = _page_blocks(spark, d).select("page_id", F.posexplode("blocks").alias("ord", "b"))
    return b.select("page_id", "ord", "b.heading", "b.text")


def _chunks(df, key, found):
    c = df.select(key, F.posexplode(chunks.pack(found)).alias("ord", "c"))
    return c.select(key, "ord", "c.heading", "c.text")


@query()
def chunk_blocks(spark, d):
    return _chunks(_page_blocks(spark, d), "page_id", F.col("blocks"))


@query()
def chunk_documents(spark, d):
    """Documents as one block each."""
    return _chunks(load(spark, d, "documents"), "doc_id", chunks.blocks(F.col("text")))


@query(rf"""with c as (select conv_id, turn, role, text, regexp_extract_all(text, '\b[A-Z]{{2,4}}[- ]?[0-9]{{3}}[A-Z]?\b') as codes from (select conv_id, turn, role, text || case when turn % 2 = 1 then ' CSC 211 and PHY-30' || turn % 10 else '' end as text from conversations where text is not null)),
f as (select *, list_transform(codes, lambda c: regexp_extract(c, '^[A-Z]+')) as a, list_transform(codes, lambda c: regexp_extract(c, '[0-9].*$')) as n from c),
s as (select *, flatten(list_transform(range(1, len(codes) + 1), lambda i: list_sort(list_distinct([a[i] || '-' || n[i], a[i] || n[i], case a[i] when 'CS' then 'CSC' when 'CSC' then 'CS' else a[i] end || '-' || n[i], case a[i] when 'CS' then 'CSC' when 'CSC' then 'CS' else a[i] end || n[i]])))) as every from f)
select conv_id, turn, role || ' › turn ' || turn || chr(10) || text || case when len(every) > 0 then chr(10) || 'Course code forms: ' || array_to_string(list_filter(every, lambda x, i: list_position(every, x) = i)[:12], ' ') else '' end as text from s""")
def chunk_index(spark, d):
    """What a search reads of each turn; every second turn names two courses."""
    said = F.concat("text", F.when(F.col("turn") % 2 == 1, F.concat(F.lit(" CSC 211 and PHY-30"), F.col("turn") % 10)).otherwise(""))
    return load(spark, d, "conversations").where("text is not null").select("conv_id", "turn", chunks.index_text(F.col("role"), F.concat(F.lit("turn "), "turn"), said).alias("text"))


@query()
def html_sections(spark, d):
    return html.sections(load(spark, d, "pages"))


_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
_DAMAGED = "case doc_id % 11 when 0 then concat(' ', chr(10), ' ') when 1 then concat('  %PDF-1.4 ', left(text, 50)) when 2 then concat(left(text, 90), ' endobj ') when 3 then concat(chr(2), chr(3), left(text, 120)) when 4 then concat(chr(2), text) else text end"


@query(rf"""select doc_id, case when starts_with(ltrim(t, chr(32) || chr(10)), '%PDF-') or regexp_matches(t, '\b(endobj|FlateDecode)\b') then 'pdf' when t is null or trim(t, chr(32) || chr(10)) = '' then 'empty'
  when length(t) - length(replace(t, chr(65533), '')) > 0.005 * length(t) then 'replacement' when len(regexp_extract_all(t, '{_CONTROL}')) > 0.01 * length(t) then 'control' end as problem from (select doc_id, {_DAMAGED} as t from documents)""")
def text_problem(spark, d):
    """Why a text is none: PDF source, nothing, characters lost in decoding, or control characters; some documents are damaged so."""
    t = F.col("t")
    bad = F.length(t) - F.length(F.replace(t, F.lit("�"), F.lit("")))
    bare = F.regexp_replace(t, r"^[ \n]+", "")
    pdf = F.startswith(bare, F.lit("%PDF-")) | t.rlike(r"\b(endobj|FlateDecode)\b")
    problem = F.when(pdf, "pdf").when(t.isNull() | (bare == ""), "empty").when(bad > 0.005 * F.length(t), "replacement").when(F.regexp_count(t, F.lit(_CONTROL)) > 0.01 * F.length(t), "control")
    return load(spark, d, "documents").select("doc_id", F.expr(_DAMAGED).alias("t")).select("doc_id", problem.alias("problem"))


@query(r"""select doc_id, len(regexp_extract_all(text, '[0-9]+')) as n_numbers, case when len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) > 0 then 'contact' when len(regexp_extract_all(text, '[0-9]+')) >= 3 then 'table' else 'prose' end as kind from documents""")
def classify_doc(spark, d):
    n = lambda p: F.regexp_count("text", F.lit(p))
    mail = n(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    return load(spark, d, "documents").select("doc_id", n("[0-9]+").cast("long").alias("n_numbers"), F.when(mail > 0, "contact").when(n("[0-9]+") >= 3, "table").otherwise("prose").alias("kind"))


@query(r"""select doc_id, list_distinct(regexp_extract_all(text, '[0-9]{2,}')) as numbers, list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+')) as mails from documents where false""".replace(" where false", " where regexp_matches(text, '[0-9]{2}')").replace("list_distinct(", "list_sort(list_distinct(").replace("')) as", "'))) as"))
def extract_entities(spark, d):
    every = lambda p: F.sort_array(F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(0))))
    return load(spark, d, "documents").where(F.col("text").rlike("[0-9]{2}")).select("doc_id", every("[0-9]{2,}").alias("numbers"), every(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+").alias("mails"))


@query("""select o_orderkey, h * 60 + m as minutes from (select o_orderkey, o_orderkey % 24 as h, o_orderkey % 60 as m from orders)""")
def parse_clock(spark, d):
    k = F.col("o_orderkey")
    h, half = (k % 24), F.when(k % 24 >= 12, "PM").otherwise("AM")
    shown = F.format_string("%d:%02d %s", F.when(h % 12 == 0, 12).otherwise(h % 12), k % 60, half)
    return load(spark, d, "orders").select("o_orderkey", tx.clock_minutes(shown).cast("long").alias("minutes"))


@query("""select p_partkey, case when p_partkey % 3 = 0 then '''=' || p_name when p_partkey % 3 = 1 then '''-' || p_name else '-' || p_size end as cell from part""")
def csv_safe_export(spark, d):
    k = F.col("p_partkey") % 3
    cell = F.when(k == 0, F.concat(F.lit("="), "p_name")).when(k == 1, F.concat(F.lit("-"), "p_name")).otherwise(F.concat(F.lit("-"), "p_size"))
    return load(spark, d, "part").select("p_partkey", tx.csv_safe(cell).alias("cell"))


@query("""select event_id, list_filter([case when event_id % 7 = 6 then 'day' end, case when event_id % 5 = 0 then 'start' end, case when event_id % 5 <> 0 and event_id % 3 = 0 then 'order' end, case when event_id % 4 = 0 then 'room' end], lambda x: x is not null) as errors from events""")
def csv_import_validate(spark, d):
    i = F.col("event_id")
    days = F.array(*map(F.lit, [*csvio.DAYS[:6], "NODAY"]))
    rows = load(spark, d, "events").select(
        "event_id", F.get(days, (i % 7).cast("int")).alias("day"), F.when(i % 5 == 0, "soon").otherwise("10:30").alias("start"), F.when(i % 3 == 0, "9.15").otherwise("1:35 PM").alias("end"),
        F.when(i % 4 == 0, " ").otherwise("R1").alias("room"), F.lit("CS-101").alias("code"),
    )
    return csvio.validate(rows).select("event_id", "errors")


@query("""with b(item_id, text) as (select item_id, text from benchmark where text is not null) select item_id, doc_id from b join documents d on contains(d.text, b.text)""")
def gold_contains(spark, d):
    """Benchmark texts that stand in documents, first met by their opening words."""
    lead = lambda c: F.array_join(F.slice(F.split(c, "[ \\n]+"), 1, 4), " ")
    b = load(spark, d, "benchmark").where("text is not null").select("item_id", F.col("text").alias("gold")).withColumn("k", lead("gold"))
    words = load(spark, d, "documents").select("doc_id", "text", F.split("text", "[ \\n]+").alias("w"))
    grams = words.select("doc_id", "text", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 4, F.lit(0))), lambda i: F.array_join(F.slice("w", i + 1, 4), " ")))).alias("k"))
    met = grams.select("doc_id", "k").join(b, "k").join(words.select("doc_id", "text"), "doc_id")
    return met.where(F.contains("text", "gold")).select("item_id", "doc_id").distinct()


_CODED = "text || ' See CS-' || lpad((doc_id % 900 + 100)::varchar, 3, '0') || ', math ' || (doc_id % 7 + 200) || ' and csc' || (doc_id % 900 + 100) || ' in ROOM 101.'"


@query(f"""with c as (select doc_id, {tx.code_list_sql(_CODED)} as c from documents) select doc_id, list_filter(c, lambda x, i: list_position(c, x) = i) as codes from c""")
def extract_codes(spark, d):
    """Codes of every text, each of which names a course twice, another once and a room."""
    k = F.col("doc_id")
    said = F.concat("text", F.format_string(" See CS-%03d, math %d and csc%d in ROOM 101.", k % 900 + 100, k % 7 + 200, k % 900 + 100))
    return load(spark, d, "documents").select("doc_id", tx.codes(said).alias("codes"))


@query()
def sentences(spark, d):
    return load(spark, d, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))


_clause, _ends = (x.replace("'", "''") for x in (chunks.CLAUSE_START, chunks.SENTENCE_END))
_caps = lambda x: f"({x} = upper({x}) and {x} <> lower({x}))"
_goes_on = f"""b <> '' and x <> '' and not (regexp_matches(x, '{_clause}') or {_caps('x')} or {_caps('b')} or contains(x, '  ') or (regexp_matches(b, '{chunks.CELL_END}') and length(b) < 50) or (regexp_matches(b, '{_ends}') and regexp_matches(x, '^[A-Z]')))"""


@query(rf"""with l as (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
p as (select doc_id, i, x, lag(x) over (partition by doc_id order by i) as b from (select doc_id, i, {_trimmed('x')} as x from l)),
j as (select doc_id, string_agg(case when i = 1 then '' when not ({_goes_on}) then chr(10) when ends_with(b, '-') and regexp_matches(x, '^[a-z]') then chr(1) else ' ' end || x, '' order by i) as t from p group by 1)
select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '-\x01', '', 'g'), '^\n+', ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '\n+$', chr(10)) as text from j""")
def reflow(spark, d):
    return load(spark, d, "documents").where("text is not null").select("doc_id", chunks.reflow(F.col("text")).alias("text"))


_SCRIPTS = "case doc_id % 6 when 0 then 'مجھے فیس کے بارے میں بتائیں ' || left(text, 20) when 1 then 'mujhe fees batao ' || left(text, 60) when 2 then 'داخلہ ' || left(text, 80) else text end"
_hints = "[" + ", ".join(f"'{w}'" for w in tx.ROMAN_URDU) + "]"


@query(rf"""with t as (select doc_id, {_SCRIPTS} as t from documents where text is not null), n as (select doc_id, regexp_replace(t, '\P{{L}}', '', 'g') as letters, len(list_filter(regexp_extract_all(lower(t), '[a-z]+'), lambda w: list_contains({_hints}, w))) as hints from t)
select doc_id, case when length(letters) > 0 and length(regexp_replace(letters, '[^\x{{0600}}-\x{{06FF}}]', '', 'g')) / length(letters) > 0.3 then 'ur' when hints >= 2 then 'roman-ur' else 'en' end as lang from n""")
def detect_lang(spark, d):
    """Urdu by its script, romanised Urdu by two of its words, else English; half of the documents begin with some."""
    k, left = F.col("doc_id") % 6, lambda n: F.left("text", F.lit(n))
    said = F.when(k == 0, F.concat(F.lit("مجھے فیس کے بارے میں بتائیں "), left(20))).when(k == 1, F.concat(F.lit("mujhe fees batao "), left(60))).when(k == 2, F.concat(F.lit("داخلہ "), left(80))).otherwise(F.col("text"))
    return load(spark, d, "documents").where("text is not null").select("doc_id", said.alias("said")).select("doc_id", tx.language(F.col("said")).alias("lang"))
