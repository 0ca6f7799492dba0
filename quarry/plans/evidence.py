"""Spelling against the corpus, quotes, citations and claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import entities as en
from ..operators import quotes, spelling
from ..tables import load
from .registry import query

_WORDS = "regexp_extract_all(lower({c}), '[a-z]+')"
_words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))


@query(f"""with v as (select word, count(*) as freq from (select unnest({_WORDS.format(c='text')}) as word from documents) group by 1),
a as (select distinct left(w, 2) || 'q' || substr(w, 4) as asked from (select unnest({_WORDS.format(c='text')}) as w from benchmark where item_id % 20 = 0) where length(w) >= 4),
u as (select asked from a where asked not in (select word from v)), n as (select asked, word, levenshtein(asked, word)::int as distance, freq from u join v on abs(length(asked) - length(word)) <= 2 and levenshtein(asked, word) <= 2),
c as (select *, round(1 / (distance + 1) * (ln(freq + 1) / 5), 9) as raw from n)
select asked, word as fix, distance, round(least(raw, 1), 6) as confidence, raw >= 0.8 as sure from c qualify row_number() over (partition by asked order by raw desc, distance, word) = 1""")
def spell_fix(spark, d):
    """The words of every twentieth benchmark item with their third letter wrong, against every word of the corpus."""
    asked = load(spark, d, "benchmark").where("item_id % 20 = 0").select(F.explode(_words(F.col("text"))).alias("w")).where(F.length("w") >= 4)
    asked = asked.select(F.concat(F.left("w", F.lit(2)), F.lit("q"), F.expr("substr(w, 4)")).alias("asked"))
    return spelling.corrections(asked, spelling.vocabulary(load(spark, d, "documents"), _words(F.col("text"))))


_NORMAL = "lower(trim(regexp_replace({c}, '[ \\t\\n\\r]+', ' ', 'g')))"
_QUOTES = "q as (select item_id, substr(text, 9, 60) as quote from benchmark)"


@query(f"""with {_QUOTES}, n as (select item_id, {_NORMAL.format(c='quote')} as q from q), s as (select doc_id, {_NORMAL.format(c='text')} as t from documents) select item_id, doc_id from n join s on contains(t, q) where length(q) >= 12""")
def quote_sources(spark, d):
    """Every document that holds the quote of each benchmark item, which begins inside a word."""
    q = load(spark, d, "benchmark").select("item_id", F.substring("text", 9, 60).alias("quote"))
    return quotes.find(q, load(spark, d, "documents"), "item_id", "quote", "doc_id", "text")


_CITED = """src as (select doc_id as source, text from documents where text is not null),
cit as (select doc_id % 50 as answer, case when doc_id % 11 = 0 then -doc_id - 1 else doc_id end as source, case when doc_id % 7 = 0 then sha256(text || '.') else sha256(text) end as sha256,
  case doc_id % 6 when 0 then [substr(text, 3, 30), replace(substr(text, 40, 25), ' ', chr(10) || ' ')] when 1 then [substr(text, 5, 40) || '#'] when 2 then []::varchar[] else [substr(text, 21, 50)] end as quotes from documents where length(text) >= 100)"""


@query(f"""with {_CITED}, c as (select answer, s.source is not null and sha256(s.text) = c.sha256 and len(quotes) > 0 and len(list_filter(quotes, lambda q: length({_NORMAL.format(c='q')}) > 0 and contains({_NORMAL.format(c='s.text')}, {_NORMAL.format(c='q')}))) = len(quotes) as ok from cit c left join src s using (source))
select answer, count(*) as citations, count(*) filter (ok) as valid, round(count(*) filter (ok) / count(*), 6) as integrity from c group by 1""")
def citation_integrity(spark, d):
    """Each document cited once; some by a source that isn't there, by the hash of other text, or with quotes it doesn't hold."""
    docs, k = load(spark, d, "documents"), F.col("doc_id")
    sub = lambda a, n: F.substring("text", a, n)
    said = F.when(k % 6 == 0, F.array(sub(3, 30), F.replace(sub(40, 25), F.lit(" "), F.lit("\n ")))).when(k % 6 == 1, F.array(F.concat(sub(5, 40), F.lit("#")))).when(k % 6 == 2, F.array().cast("array<string>")).otherwise(F.array(sub(21, 50)))
    sha = F.sha2(F.when(k % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")).cast("binary"), 256)
    cited = docs.where(F.length("text") >= 100).select((k % 50).alias("answer"), F.when(k % 11 == 0, -k - 1).otherwise(k).alias("source"), sha.alias("sha256"), said.alias("quotes"))
    return quotes.citation_integrity(cited, docs.where("text is not null").select(k.alias("source"), "text"))


_known = "MAP {" + ", ".join(f"'{w}': {n}" for w, n in en.VALUES.items()) + "}"


def _numbers_sql(t: str) -> str:
    """``entities.numbers`` in the SQL that checks it."""
    v = f"translate({t}, '{en.OTHER_DIGITS}', '01234567890123456789')"
    w = f"regexp_extract_all(lower({v}), '[a-z]+')"
    one = f"case when {w}[i + 1] = 'hundred' then {_known}[{w}[i]] * 100 when {w}[i + 1] = 'thousand' then {_known}[{w}[i]] * 1000 when {_known}[{w}[i]] >= 20 and {_known}[{w}[i + 1]] < 10 then {_known}[{w}[i]] + {_known}[{w}[i + 1]] else {_known}[{w}[i]] end"
    said = f"list_transform(list_filter(range(1, len({w}) + 1), lambda i: map_contains({_known}, {w}[i])), lambda i: ({one})::varchar)"
    return f"list_concat(list_transform(regexp_extract_all({v}, '[0-9]+(?:[.,][0-9]+)*'), lambda n: replace(n, ',', '')), {said})"


_CLAIMS = """src as (select doc_id as source, coalesce(source, '') || ' ' || doc_id % 3 as title, text from documents where text is not null),
cl as (select doc_id as claim, case when doc_id % 13 = 0 then -doc_id - 1 else doc_id end as source, left(text, 90) || ' [1, 2]' || case doc_id % 4 when 0 then ' in ' || doc_id % 3 || ' years' when 1 then ' of seven weeks' else '' end as text,
  case doc_id % 5 when 0 then substr(text, 2, 11) when 1 then substr(text, 10, 40) || 'zz' else left(text, 100) end as quote from documents where text is not null)"""


@query(f"""with {_CLAIMS} select claim, case when s.title is null then 'unknown source' when length(trim(quote)) < 12 then 'no quote' when length({_NORMAL.format(c='quote')}) < 12 or not contains({_NORMAL.format(c='s.text')}, {_NORMAL.format(c='quote')}) then 'quote not in source'
  when not list_has_all({_numbers_sql("(quote || ' ' || title)")}, {_numbers_sql("regexp_replace(c.text, '\\[[0-9]+(?:,\\s*[0-9]+)*\\]', '', 'g')")}) then 'number without support' end as problem from cl c left join src s using (source)""")
def claim_validation(spark, d):
    """A claim from each document; some name another source, quote too little or what isn't there, or bring a number of their own."""
    docs, k = load(spark, d, "documents").where("text is not null"), F.col("doc_id")
    own = F.when(k % 4 == 0, F.concat(F.lit(" in "), k % 3, F.lit(" years"))).when(k % 4 == 1, " of seven weeks").otherwise("")
    quote = F.when(k % 5 == 0, F.substring("text", 2, 11)).when(k % 5 == 1, F.concat(F.substring("text", 10, 40), F.lit("zz"))).otherwise(F.left("text", F.lit(100)))
    claims = docs.select(k.alias("claim"), F.when(k % 13 == 0, -k - 1).otherwise(k).alias("source"), F.concat(F.left("text", F.lit(90)), F.lit(" [1, 2]"), own).alias("text"), quote.alias("quote"))
    return quotes.claim_problems(claims, docs.select(k.alias("source"), F.concat_ws(" ", F.coalesce("source", F.lit("")), k % 3).alias("title"), "text"))
