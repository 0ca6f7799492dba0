"""Queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, licenses, linededup, minhash, mixing, pii, quality, ranking, sstable, suffix, vectorcodes, vectordedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    trained = langid.train(docs.where(~held_out))
    found = langid.predict(docs, trained).withColumn("held_out", held_out)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query
def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


@query
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans",
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op8_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.rate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _quality_sql() -> str:
    """Measures by plain counting, then both rounds of sketches and fences as tables."""
    space = r"[^ \t\n\x0B\f\r]"

    def fenced(name: str, rows: str, names: list[str], zeros: bool, low: str, high: str) -> str:
        q = lambda p: f"(case when min(bin) filter (upto >= {p} * every) = {quality.ZERO} then 0.0::double else pow({quality.GAMMA}::double, min(bin) filter (upto >= {p} * every)) end)"
        each = " union all ".join(f"select lang, source, '{x}' as measure, case when {x} > 0 then ceil(round(ln({x}) / {math.log(quality.GAMMA)!r}, 6))::int else {quality.ZERO} end as bin from {rows}" for x in names)
        out = [f"c_{name} as (select lang, source, measure, bin, count(*) as n from ({each}) {'' if zeros else f'where bin <> {quality.ZERO}'} group by all)"]
        for level, keys in (("all", ""), ("lang", "lang, "), ("own", "lang, source, ")):
            out.append(f"""{name}_{level} as (select {keys}measure, max(every) ** 2 / (max(every) ** 2 + {quality.PRIOR**2}) as w, {low.format(a=q(0.25), b=q(0.75))} as low, {high.format(a=q(0.25), b=q(0.75), m=q(0.5), t=q(quality.TAIL))} as high
  from (select {keys}measure, bin, sum(n) over (partition by {keys}measure order by bin) as upto, sum(n) over (partition by {keys}measure) as every from (select {keys}measure, bin, sum(n) as n from c_{name} group by {keys}measure, bin)) group by {keys}measure)""")
        drawn = lambda c: f"coalesce(o.w, 0) * coalesce(o.{c}, 0) + (1 - coalesce(o.w, 0)) * (coalesce(l.w, 0) * coalesce(l.{c}, 0) + (1 - coalesce(l.w, 0)) * a.{c})"
        out.append(f"""f_{name} as (select g.lang, g.source, a.measure, {drawn('low')} as low, {drawn('high')} as high from (select distinct lang, source from c_{name}) g cross join {name}_all a
  left join {name}_lang l on l.lang is not distinct from g.lang and l.measure = a.measure left join {name}_own o on o.lang is not distinct from g.lang and o.source is not distinct from g.source and o.measure = a.measure)""")
        inside = " and ".join(f"coalesce({x} between (select low from f_{name} f where f.lang is not distinct from m.lang and f.source is not distinct from m.source and measure = '{x}') and (select high from f_{name} f where f.lang is not distinct from m.lang and f.source is not distinct from m.source and measure = '{x}'), true)" for x in names)
        out.append(f"in_{name} as (select r, {inside} as ok from m)")
        return ", ".join(out)

    spread = f"{quality.REACH} * greatest({{b}} - {{a}}, {quality.LEAST})"
    return rf"""
with d as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select r, i, count(*) over (partition by r, x) as times from (select r, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as x from d where len(w) > 2)),
rep as (select r, count(distinct i + k) as n from g, range(3) t(k) where times > 1 group by 1),
b as (select r, doc_id, lang, source, len(w) as n_words, length(array_to_string(w, '')) as word_chars, len(regexp_extract_all(text, '{quality.SYMBOLS}')) as n_symbols, len(regexp_extract_all(text, '[^\p{{L}}\p{{N}} \t\n\x0B\f\r]')) as n_marks,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{space}')) as lines, coalesce(n, 0) as n_repeat_words from d left join rep using (r)),
m as materialized (select *, len(lines) - len(list_distinct(lines)) as n_dup_lines, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words as base_failed, coalesce(n_symbols / nullif(word_chars, 0), 0) as symbol_share, coalesce(n_marks / nullif(word_chars, 0), 0) as mark_share,
  coalesce((len(lines) - len(list_distinct(lines))) / nullif(len(lines), 0), 0) as dup_line_share, coalesce(n_repeat_words / nullif(n_words, 0), 0) as repeat_share, coalesce(word_chars / nullif(n_words, 0), 0) as mean_word_chars from b),
base as (select * from m where not base_failed), {fenced('shape', 'base', quality.SHAPE, True, "{a} - " + spread, "{b} + " + spread)},
plain as (select base.* from base join in_shape using (r) where ok), {fenced('tails', 'plain', quality.TAILS, False, "0.0", "2 * {t} - {m}")}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and s.ok and t.ok as kept from m join in_shape s using (r) join in_tails t using (r)
"""


ORACLE["op4_quality_rules"] = _quality_sql()


@query
def op10_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, pii.KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS[:4])), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.clean(table(spark, sf_dir, "documents"))


ORACLE["op1_line_dedup"] = f"""
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos, source from documents where text is not null),
boilerplate as (
  select lower(trim(line, ' ')) as k from lines where length(trim(line, ' ')) >= {linededup.MIN_CHARS} and source is not null group by 1 having count(distinct source) >= {linededup.MIN_SITES}),
marked as (
  select doc_id, line, pos, length(trim(line, ' ')) >= {linededup.MIN_CHARS} and lower(trim(line, ' ')) in (select k from boilerplate) as cut from lines),
cleaned as (
  select doc_id, count(*) as n_lines, count(*) filter (cut) as n_cut, coalesce(string_agg(line, chr(10) order by pos) filter (not cut), '') as text from marked group by doc_id)
select d.doc_id, coalesce(c.n_lines, 0) as n_lines, coalesce(c.n_cut, 0) as n_cut, c.text from documents d left join cleaned c using (doc_id)
"""


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


ORACLE["op3_license_scan"] = f"""
with recursive given(template, license, body) as (values {', '.join(f'({k}, {_quoted(n)}, {_quoted(t)})' for k, (n, t) in enumerate(licenses.TEMPLATES))}),
w as (select row_number() over () as row, doc_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') as w from documents where text is not null),
d as (select row, doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) as g from w where len(w) > 1),
tw as (select template, license, list_filter(string_split(regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') as w from given),
t as (select template, license, len(w) as n, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as tg from tw),
c as (select row, doc_id, g, template, license, n, tg from d join t on len(list_intersect(g, tg)) >= len(tg) * {licenses.THRESHOLD / (2 - licenses.THRESHOLD)!r}),
p as (select *, unnest(list_filter(range(1, len(g) + 1), lambda i: list_contains(tg, g[i]))) as p, list_distinct([ceil(n / {licenses.STRETCH})::int, n::int, floor(n * {licenses.STRETCH})::int]) as ns from c),
l as (select *, unnest(ns) as n2 from p),
u as (select row, doc_id, template, license, tg, p, least(p + n2 - 2, len(g)) + 2 as e, list_distinct(g[p : p + n2 - 2]) as u from l),
s as (select distinct row, doc_id, template, license, p, e, 2 * len(list_intersect(u, tg)) / (len(u) + len(tg)) as dice from u),
r as (select *, row_number() over (partition by row order by p, dice desc, e, license, template) as k from s where dice >= {licenses.THRESHOLD}),
walk(row, k, last, gone) as (select row, k, k, null::bigint from r where k = 1 union all
  select r.row, r.k, case when r.p >= l.e or r.dice > l.dice then r.k else l.k end, case when r.p >= l.e then l.k end from walk w join r on r.row = w.row and r.k = w.k + 1 join r l on l.row = w.row and l.k = w.last),
picked as (select row, gone as k from walk where gone is not null union select row, arg_max(last, k) from walk group by 1), kept as (select r.* from r join picked using (row, k))
select doc_id, list_sort(list(distinct license)) as licenses, first(license order by dice desc, license) as best, round(max(dice), 6) as best_dice, count(*) as n_units from kept group by row, doc_id
"""

#: Weights of the mix: source families, then languages, then single sources.
MIX_WEIGHTS = [("web", 4), ("books", 3), ("code", 2), ("talk", 1), *((f"{d}/en", 3) for d in ("web", "books", "code", "talk")), ("web/en/src0", 2), ("talk/en/src19", 0)]
MIX_EPOCHS, MIX_SEED = 2, 1


def with_domain(docs: DataFrame, name: str = "domain") -> DataFrame:
    """A domain for each source by its number; the tables have none."""
    number = F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int"), F.lit(0))
    return docs.withColumn(name, F.element_at(F.array(*map(F.lit, ("web", "books", "code", "talk"))), (number % 4 + 1).cast("int")))


@query
def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = spark.createDataFrame(MIX_WEIGHTS, "path string, weight long")
    return mixing.mix(with_domain(table(spark, sf_dir, "documents")), weights, epochs=MIX_EPOCHS, seed=MIX_SEED).drop("h")


def _mix_sql() -> str:
    levels = ["domain", "lang", "source"]
    steps = []
    for depth in (1, 2, 3):
        keys, above = levels[:depth], levels[: depth - 1]
        over = f"partition by {', '.join(above)}" if above else ""
        tokens, source = ("tokens", "leaf") if depth == 1 else ("l.tokens", f"leaf l join share{depth - 1} p using ({', '.join(above)})")
        steps.append(f"""
node{depth} as (select {', '.join(keys)}, sum({tokens}) as tokens, {'(select sum(tokens) from leaf)' if depth == 1 else 'min(p.share)'} as given, {" || '/' || ".join(keys)} as path from {source} group by {', '.join(keys)}),
cap{depth} as (select n.*, coalesce(w.weight, 1) as w, c.cap from node{depth} n join caps{depth} c using ({', '.join(keys)}) left join weights w using (path)),
run{depth} as (select *, sum(cap) over (a rows unbounded preceding) as cap_upto, sum(w) over (a rows unbounded preceding) as w_upto, sum(w) over (b) as w_all from cap{depth}
  window a as ({over} order by case when w > 0 then cap / w else -1 end, path), b as ({over})),
full{depth} as (select *, cap_upto * w + cap * (w_all - w_upto) <= given * w or w <= 0 as filled from run{depth}),
rest{depth} as (select *, sum(case when filled then cap else 0 end) over (b) as cap_full, sum(case when filled then 0 else w end) over (b) as w_rest from full{depth} window b as ({over})),
share{depth} as (select {', '.join(keys)}, cast(case when filled then cap else least(cap, ((given - cap_full) * w) // w_rest) end as bigint) as share from rest{depth})""")
    names = ", ".join(_quoted(x) for x in ("web", "books", "code", "talk"))
    return f"""
with weights(path, weight) as (values {', '.join(f'({_quoted(p)}, {w})' for p, w in MIX_WEIGHTS)}),
docs as (select doc_id, lang, source, [{names}][cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 4 + 1] as domain, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as tokens from documents),
leaf as (select domain, lang, source, cast(sum(tokens) as bigint) as tokens from docs group by all),
caps3 as (select domain, lang, source, case when coalesce(weight, 1) > 0 then tokens * {MIX_EPOCHS} else 0 end as cap from leaf left join weights on path = domain || '/' || lang || '/' || source),
caps2 as (select domain, lang, case when coalesce(any_value(weight), 1) > 0 then sum(cap) else 0 end as cap from caps3 left join weights on path = domain || '/' || lang group by 1, 2),
caps1 as (select domain, case when coalesce(any_value(weight), 1) > 0 then sum(cap) else 0 end as cap from caps2 left join weights on path = domain group by 1), {','.join(steps)},
planned as (select l.*, s.share, least({MIX_EPOCHS}, coalesce(s.share // nullif(l.tokens, 0), 0)) as whole from leaf l join share3 s using (domain, lang, source)),
ordered as (select d.doc_id, d.domain, d.lang, d.source, d.tokens, p.share, p.whole, p.share - p.whole * p.tokens as spare,
  sum(d.tokens) over (partition by d.domain, d.lang, d.source order by md5('{MIX_SEED}|' || p.whole || '|' || d.doc_id) rows unbounded preceding) as upto from docs d join planned p using (domain, lang, source))
select domain, lang, source, doc_id, tokens, share, cast(whole + case when whole < {MIX_EPOCHS} and upto <= spare and spare > 0 then 1 else 0 end as bigint) as copies from ordered
"""


ORACLE["op5_source_mixing"] = _mix_sql()


@query
def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.passages(table(spark, sf_dir, "documents"))


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vectorcodes.compress(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(books.text().encode()).hexdigest()
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _codes_sql(parts: int = vectorcodes.PARTS, entries: int = vectorcodes.ENTRIES, rounds: int = vectorcodes.ROUNDS, scale: int = vectorcodes.SCALE) -> str:
    """Codebooks of each round as a table (part, entry, c), the assignment to them as another."""
    square = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"near{k} as materialized (select r, part, x, entry, d::bigint as d from (select r, part, x, entry, {square} as d from p join book{k} using (part)) qualify row_number() over (partition by r, part order by d, entry) = 1)")
        if k < rounds:
            steps.append(f"sum{k} as (select part, entry, pos, sum(v)::bigint as s, count(*) as n from (select part, entry, unnest(x) as v, generate_subscripts(x, 1) as pos from near{k}) group by 1, 2, 3)")
            steps.append(f"mean{k} as (select part, entry, list((s - ((s % n) + n) % n) // n order by pos) as m from sum{k} group by 1, 2)")
            steps.append(f"book{k + 1} as materialized (select part, entry, coalesce(m, c) as c from book{k} left join mean{k} using (part, entry))")
    return f"""
with kept as (select row_number() over (order by vec_id nulls last, embedding) as r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
p as materialized (select r, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] as x from kept, range({parts}) t(part)),
book0 as (select part, r - 1 as entry, x as c from p where r <= {entries}), {", ".join(steps)},
coded as (select r, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from near{rounds} group by 1),
digest as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) as codebooks_sha256 from book{rounds})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from kept join coded using (r), digest
"""


ORACLE["op11_vector_codes"] = _codes_sql()


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE["op12_ranked_search"] = f"""
with d as (select row_number() over () as r, doc_id, {_TERMS} as w from documents), held as (select * from d where len(w) > 0),
st as (select count(*) as n_docs, sum(len(w)) as n_terms from held),
post as (select r, term, count(*) as tf from (select r, unnest(w) as term from held) group by 1, 2), df as (select term, count(*) as df from post group by 1),
norm as (select r, doc_id, ({100 - ranking.B} + (({ranking.B} * len(w) * n_docs) // n_terms))::bigint as m from held, st),
weight as (select term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::bigint as w from df, st),
asked as (select item_id, term, count(*) as times from (select item_id, unnest({_TERMS}) as term from benchmark) group by 1, 2),
s as (select item_id, r, any_value(doc_id) as doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from asked join weight using (term) join post using (term) join norm using (r) group by 1, 2),
t as (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last, r)::int as rank from s where score > 0)
select item_id, rank, doc_id, score from t where rank <= 10
"""


@query
def op13_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordedup.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE["op13_vector_near_dedup"] = """
with recursive rows as (select row_number() over () as r, vec_id, embedding::double[] as v from embeddings),
good as (select r, vec_id, v from rows where vec_id is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
links as materialized (select a.r as a, b.r as b from good a join good b on a.r <> b.r and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.95),
reach(a, b) as (select r, r from rows union select reach.a, links.b from reach join links on links.a = reach.b),
n as (select a, count(*) as n from links group by 1),
c as (select a, min(vec_id) as component_id from reach join rows on r = b group by 1)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id is not distinct from component_id as kept from rows join c on c.a = r left join n on n.a = r
"""
