"""Stores that are written and read back: objects, builds; and a model trained and applied."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bayes
from ..sources import bundle, objects
from ..store import fresh_path, materialize
from ..tables import load
from .registry import query


@query("""select sha256(html) as sha256, octet_length(encode(html)) as bytes, count(*) * 2 as rows, true as intact, 1::bigint as n_stored from pages where html <> '' group by 1, 2""")
def object_store(spark, d):
    """Every page put twice: an object for each content, stored once, and as it was when read back."""
    root, pages = fresh_path(spark, "store"), load(spark, d, "pages")
    twice = [objects.put(pages, root, "html", ".html"), objects.put(pages, root, "html", ".html")]
    put = twice[0].union(twice[1]).groupBy("sha256", "bytes").agg(F.sum("rows").alias("rows"), F.count_if("stored").alias("n_stored"))
    return objects.read(spark, root).join(put, "sha256").select("sha256", F.octet_length("content").cast("long").alias("bytes"), "rows", "intact", "n_stored")


@query("""with p as (select regexp_extract(url, '^https?://([^/]+)', 1) as host, page_id, url, sha256(html) as sha256 from pages) select host, arg_max(sha256, page_id) as sha256, arg_max(url, page_id) as url, min(page_id) as first_seen from p group by 1""")
def object_catalogue(spark, d):
    """The last page of each host and where the host was first seen."""
    k = F.col("page_id")
    p = load(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), "url", objects.sha256(F.col("html")).alias("sha256"), k.alias("seen"), k.alias("first_seen"))
    return objects.catalogue(p, "host", "seen", "first_seen").drop("seen")


@query("""select lang, count(*) as n, sum(n_chars)::bigint as n_chars, 0::bigint as n_problems, 2::bigint as n_builds, 'b2' as build from documents where text is not null and n_chars >= 200 group by 1""")
def bundle_builds(spark, d):
    """Three builds published, the oldest pruned, and what the current one holds after its files are checked."""
    root, docs = fresh_path(spark, "bundle"), load(spark, d, "documents")
    for name, build in (("b0", docs.limit(0)), ("b1", docs), ("b2", docs.where("text is not null and n_chars >= 200"))):
        bundle.publish(build, root, name)
    bundle.prune(spark, root, keep=2)
    bad = sum(bundle.problems(spark, root, b).count() for b in ("b1", "b2"))
    held = bundle.current(spark, root).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))
    return held.select("lang", "n", "n_chars", F.lit(bad).cast("long").alias("n_problems"), F.lit(len(bundle.builds(spark, root))).cast("long").alias("n_builds"), F.lit("b2").alias("build"))


_GRAMS = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"


@query(f"""with d as (select doc_id, toxic as label, regexp_extract_all(lower(text), '[a-z]+') as w from documents join labels using (doc_id)), g as (select doc_id, label, {_GRAMS} as grams from d where w is not null),
t as (select * from g where doc_id % 5 <> 0), seen as (select label, gram, count(*) as n from (select label, unnest(grams) as gram from t) group by 1, 2), v as (select count(distinct gram) as v from seen),
l as (select label, ln(count(*) / (select count(*) from t)) as prior, -ln((select sum(n) from seen s where s.label = t.label) + any_value(v)) as absent from t, v group by 1),
asked as (select doc_id, label as actual, grams from g where doc_id % 5 = 0), met as (select doc_id, gram, count(*) as n from (select doc_id, unnest(grams) as gram from asked) group by 1, 2),
gained as (select doc_id, label, sum(met.n * ln(seen.n + 1)) as gained from met join seen using (gram) group by 1, 2),
s as (select a.doc_id, a.actual, l.label, round(prior + len(grams) * absent + coalesce(gained, 0), 6) as score from asked a cross join l left join gained g on g.doc_id = a.doc_id and g.label = l.label),
b as (select *, max(score) over (partition by doc_id) as best from s)
select doc_id, any_value(actual) as actual, arg_min(label, (-score, label)) as label, round(1 / sum(exp(score - best)), 4) as confidence from b group by 1""")
def nb_ngrams(spark, d):
    """Toxic or not, from words and pairs of words: learned from four fifths of the labelled documents, told of the others."""
    labelled = load(spark, d, "documents").where("text is not null").join(load(spark, d, "labels"), "doc_id")
    labelled = materialize(labelled.select("doc_id", "toxic", "text"), "labelled")  # read six times
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    rows = labelled.select("doc_id", F.col("toxic").alias("label"), words.alias("words")).select("doc_id", "label", bayes.ngrams(F.col("words")).alias("grams"))
    model, labels = bayes.train(rows.where("doc_id % 5 <> 0"))
    asked = rows.where("doc_id % 5 = 0")
    return bayes.predict(asked, model, labels, "doc_id").join(asked.select("doc_id", F.col("label").alias("actual")), "doc_id")
