"""Retrieval queries: benchmark items against documents, vectors against vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import metrics
from ..operators import search as op
from ..store import materialize
from ..tables import load
from .registry import query

_W = tx.tokens_sql("text")
_BASE = f"""docs as (select doc_id, {_W} as w from documents), stats as (select count(*) as n, avg(len(w)) as avg_len from docs),
post as (select doc_id, term, count(*) as tf, any_value(l) as len from (select doc_id, len(w) as l, unnest(w) as term from docs) group by 1, 2), df as (select term, count(*) as df from post group by 1),
asked as (select item_id, term, count(*) as qtf from (select item_id, unnest({_W}) as term from benchmark where item_id % 20 = 0) group by 1, 2)"""

_ALL = _BASE.replace(" where item_id % 20 = 0", "")  # asked by every item


def _bm25_sql(k1: float, b: float, bonus: str, name: str) -> str:
    return f"""{name} as (select item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * {bonus} * tf * {k1 + 1} / (tf + {k1} * ({1 - b} + {b} * len / avg_len))), 6) as score from asked join df using (term) join post using (term), stats group by 1, 2)"""


_G3 = _bm25_sql(1.4, 0.72, "(1 + 0.15 * least(qtf - 1, 2))", "g3")
_G1 = _bm25_sql(1.5, 0.75, "1", "g1")


def _top(name: str, k: int, out: str, score: str = "score") -> str:
    return f"{out} as (select item_id, doc_id, {score} as score, rank from (select *, row_number() over (partition by item_id order by {score} desc, doc_id)::int as rank from {name}) where rank <= {k})"


def _docs(spark, d):
    return op.prepare(load(spark, d, "documents"), "doc_id", tx.tokens(F.col("text")))


def _asked(spark, d):
    return load(spark, d, "benchmark").where("item_id % 20 = 0").select("item_id", F.col("text").alias("question"))  # the query set


def _bm25(spark, d, variant=op.G3, k=10, docs=None):
    scores = op.bm25(docs or _docs(spark, d), "doc_id", _asked(spark, d), "item_id", tx.tokens(F.col("question")), variant)
    return op.rank(scores, "item_id", "doc_id", k)


@query(f"with {_BASE} select term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as idf from df, stats")
def term_stats(spark, d):
    docs = _docs(spark, d)
    return op.term_stats(op.postings(docs, "doc_id"), op.corpus_stats(docs)).withColumn("idf", F.round("idf", 6))


@query(f"with {_BASE}, {_G3}, {_top('g3', 10, 'r')} select item_id, doc_id, score, rank from r")
def bm25_topk(spark, d):
    return _bm25(spark, d)


@query(f"with {_BASE}, {_G1}, {_top('g1', 10, 'r')} select item_id, doc_id, score, rank from r")
def bm25_g1(spark, d):
    return _bm25(spark, d, op.G1)


_KW = f"kw as (select item_id, doc_id, sum(tf)::double / any_value(len) as score from asked join post using (term) group by 1, 2), kwn as (select item_id, doc_id, round(score / max(score) over (partition by item_id), 6) as score from kw)"


def _keyword(spark, d, docs=None):
    asked = _asked(spark, d).select("item_id", F.explode(F.array_distinct(tx.tokens(F.col("question")))).alias("term"))
    post = op.postings(docs or _docs(spark, d), "doc_id", asked.select("term").distinct())
    kw = asked.join(post, "term").groupBy("item_id", "doc_id").agg((F.sum("tf") / F.first("len")).alias("score"))
    return kw.withColumn("score", F.round(F.col("score") / F.max("score").over(Window.partitionBy("item_id")), 6))


@query(f"with {_BASE}, {_KW}, {_top('kwn', 10, 'r')} select item_id, doc_id, score, rank from r")
def keyword_norm(spark, d):
    return op.rank(_keyword(spark, d), "item_id", "doc_id", 10)


def _rrf_sql(constant: str, w3: str, wk: str) -> str:
    return f"""with {_BASE}, {_G3}, {_KW}, {_top('g3', 80, 'a')}, {_top('kwn', 80, 'b')}, f as (select item_id, doc_id, round(sum(p), 6) as score from (select item_id, doc_id, {w3} / ({constant}) as p from a union all select item_id, doc_id, {wk} / ({constant}) from b) group by 1, 2), {_top('f', 24, 'r')} select item_id, doc_id, score, rank from r"""


def _two(spark, d):
    docs = _docs(spark, d)
    return _bm25(spark, d, k=80, docs=docs), op.rank(_keyword(spark, d, docs), "item_id", "doc_id", 80)


@query(_rrf_sql("60 + rank - 1", "1.0::double", "1.0::double"))
def rrf_fuse(spark, d):
    a, b = _two(spark, d)
    return op.rank(op.rrf([(a, 1), (b, 1)], "item_id", "doc_id"), "item_id", "doc_id", 24)


@query(_rrf_sql("60 + rank", "1.0::double", "1.0::double"))
def rrf_g1(spark, d):
    a, b = _two(spark, d)
    return op.rank(op.rrf([(a, 1), (b, 1)], "item_id", "doc_id", zero_based=False), "item_id", "doc_id", 24)


@query(_rrf_sql("40 + rank", "1.0::double", "2.0::double"))
def rrf_weighted(spark, d):
    a, b = _two(spark, d)
    return op.rank(op.rrf([(a, 1), (b, 2)], "item_id", "doc_id", constant=40, zero_based=False), "item_id", "doc_id", 24)


@query(f"""with {_BASE}, {_G3}, {_top('g3', 30, 'a')}, r as (select item_id, doc_id, round(0.6 * 1 / (1 + exp(-(doc_id % 7 - 3))) + 0.4 * score / max(score) over (partition by item_id), 6) as blended from a where rank <= 12) select item_id, doc_id, blended from r""")
def rerank_blend(spark, d):
    raw = (F.col("doc_id") % 7 - 3).cast("double")  # scores of a model stand in for it
    return op.rerank(_bm25(spark, d, k=30), "item_id", raw, F.lit(0.6)).select("item_id", "doc_id", F.round("blended", 6).alias("blended"))


@query(f"""with {_BASE}, {_G3}, {_top('g3', 80, 'a')}, b as (select a.item_id, a.doc_id, round(a.score * case d.lang when 'en' then 1.0 else 0.55 end * case when d.n_chars > 5000 then 0.6 else 1.0 end + case when d.source = 'src0' then 0.045 else 0 end, 6) as score from a join documents d using (doc_id)), {_top('b', 10, 'r')} select item_id, doc_id, score, rank from r""")
def boosted_rank(spark, d):
    facts = load(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    f = F.when(F.col("lang") == "en", 1.0).otherwise(0.55) * F.when(F.col("n_chars") > 5000, 0.6).otherwise(1.0)
    boosted = _bm25(spark, d, k=80).drop("rank").join(facts, "doc_id").withColumn("score", F.col("score") * f + F.when(F.col("source") == "src0", 0.045).otherwise(0.0))
    return op.rank(boosted, "item_id", "doc_id", 10)


@query(f"""with {_BASE}, qi as (select item_id, term, coalesce(ln(1 + (n - df + 0.5) / (df + 0.5)), 3.0) as idf from asked left join df using (term), stats), t as (select item_id, sum(idf) as total, count(*) as n from qi group by 1),
m as (select item_id, doc_id, sum(idf) as matched, count(*) as k from qi join post using (term) group by 1, 2) select item_id, doc_id, round(matched / total, 6) as coverage from m join t using (item_id) where matched / total >= 0.22 and k >= least(2, n)""")
def coverage_gate(spark, d):
    docs = _docs(spark, d)
    asked = _asked(spark, d).select("item_id", F.explode(F.array_distinct(tx.tokens(F.col("question")))).alias("term"))
    post = op.postings(docs, "doc_id", asked.select("term").distinct())
    asked = asked.join(op.term_stats(post, op.corpus_stats(docs)), "term", "left").withColumn("idf", F.coalesce("idf", F.lit(3.0)))
    total = asked.groupBy("item_id").agg(F.sum("idf").alias("total"), F.count(F.lit(1)).alias("n"))
    m = asked.join(post.select("doc_id", "term"), "term").groupBy("item_id", "doc_id").agg(F.sum("idf").alias("matched"), F.count(F.lit(1)).alias("k")).join(total, "item_id")
    return m.where((F.col("matched") / F.col("total") >= 0.22) & (F.col("k") >= F.least(F.lit(2), F.col("n")))).select("item_id", "doc_id", F.round(F.col("matched") / F.col("total"), 6).alias("coverage"))


_WORDS = lambda c: f"regexp_extract_all(lower({c}), '[a-z0-9]+')"


@query(f"""with f as (select doc_id, {_WORDS('split_part(text, chr(10), 1)')} as a, {_WORDS('source')} as b, {_WORDS('text')} as c from documents), n as (select doc_id, len(a) + len(b) + len(c) as len from f), st as (select count(*) as n, avg(len) as avg_len from n),
t as (select doc_id, unnest(a) as term, 3 as w from f union all select doc_id, unnest(b), 2 from f union all select doc_id, unnest(c), 1 from f), post as (select doc_id, term, sum(w) as tf from t group by 1, 2), df as (select term, count(*) as df from post group by 1),
asked as (select distinct item_id, unnest({_WORDS('text')}) as term from benchmark where item_id % 20 = 0),
s as (select item_id, doc_id, round(sum(greatest(ln(1 + (n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) as score from asked join df using (term) join post using (term) join n using (doc_id), st group by 1, 2), {_top('s', 100, 'r')} select item_id, doc_id, score, rank from r""")
def bm25_fielded(spark, d):
    """First line as title (weight 3), source as section (2), text as content (1)."""
    docs = load(spark, d, "documents")
    fields = [(op.prepare(docs, "doc_id", tx.words(c)), w) for c, w in ((F.split_part("text", F.lit("\n"), F.lit(1)), 3), (F.col("source"), 2), (F.col("text"), 1))]
    return op.rank(op.bm25_fielded(fields, "doc_id", _asked(spark, d), "item_id", tx.words(F.col("question"))), "item_id", "doc_id", 100)


@query()
def context_select(spark, d):
    ranked = _bm25(spark, d, k=30).join(load(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return op.select_context(ranked, "item_id", "doc_id", "n_chars", 9000)


@query(f"""with {_BASE}, {_G3}, {_top('g3', 10, 'r')}, good as (select doc_id from labels where quality = 1), j as (select item_id, rank, g.doc_id is not null as rel from r left join good g using (doc_id))
select item_id, round(count(*) filter (rel) / 10, 6) as p_at_k, round(count(*) filter (rel) / (select count(*) from good), 6) as recall, coalesce(round(1 / min(case when rel then rank end), 6), 0) as rr, count(*) filter (rel) > 0 as hit from j group by 1""")
def retrieval_metrics(spark, d):
    good = load(spark, d, "labels").where("quality = 1").select("doc_id")
    return metrics.retrieval_metrics(_bm25(spark, d), good, "item_id", "doc_id", "rank", 10)


_COS = "cs as (select q.vec_id as item_id, v.vec_id as doc_id, list_cosine_similarity(v.embedding::double[], q.embedding::double[]) as c from embeddings v, embeddings q where q.vec_id % 20 = 0 and v.vec_id <> q.vec_id)"


def _knn(spark, d, k, score=None, least=-2.0):
    e = load(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))  # the query set
    return op.rank(op.knn(e, q, "vec_id", "embedding", "query_id", "query_vector", k, score, least), "query_id", "vec_id", k)


@query(f"with {_COS}, s as (select item_id, doc_id, round(greatest(c, 0), 6) as score from cs), {_top('s', 10, 'r')} select item_id as query_id, doc_id as vec_id, score, rank from r")
def knn_topk(spark, d):
    return _knn(spark, d, 10, lambda c: np.maximum(c, 0.0))


@query(f"with {_COS}, s as (select item_id, doc_id, round(1 - (1 - c) / 2, 6) as score from cs where 1 - c <= 2 * (1 - 0.55)), {_top('s', 10, 'r')} select item_id as query_id, doc_id as vec_id, score, rank from r")
def knn_half_cos(spark, d):
    return _knn(spark, d, 10, lambda c: 1 - (1 - c) / 2, 1 - 2 * (1 - 0.55) - 1e-12)


@query(f"with {_COS}, s as (select item_id, doc_id, round(c, 6) as score from cs where c > 0.2), {_top('s', 30, 'r')} select item_id as query_id, doc_id as vec_id, score, rank from r")
def knn_threshold(spark, d):
    return _knn(spark, d, 30, None, 0.2)


@query("select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 4) as squared, len(embedding) = 64 as fits from embeddings")
def l2_normalize(spark, d):
    v = F.col("embedding")
    n = op.norm(v)
    unit = F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
    return load(spark, d, "embeddings").select("vec_id", F.round(op.dot(unit, unit), 4).alias("squared"), (F.size(v) == 64).alias("fits"))


@query(f"""with {_ALL}, {_G3}, {_KW}, {_top('g3', 20, 'a')}, k as (select item_id, doc_id, score / max(score) over (partition by item_id) as kw from a), f as (select coalesce(k.item_id, s.item_id) as item_id, coalesce(k.doc_id, s.doc_id) as doc_id, round(0.6 * coalesce(kw, 0) + 0.4 * coalesce(greatest(s.score, 0), 0), 6) as score from k full join (select * from kwn where score > 0.5) s on k.item_id = s.item_id and k.doc_id = s.doc_id), {_top('f', 10, 'r')} select item_id, doc_id, score, rank from r""")
def weighted_fuse(spark, d):
    asked = load(spark, d, "benchmark").select("item_id", F.col("text").alias("question"))  # every item
    scores = op.bm25(_docs(spark, d), "doc_id", asked, "item_id", tx.tokens(F.col("question")), share=F.sum("tf") / F.first("len"))
    scores = materialize(scores, "scores")  # words are met once for both
    best = scores.groupBy("item_id").agg(F.max("share").alias("best"))
    share = scores.join(best, "item_id").select("item_id", "doc_id", F.round(F.col("share") / F.col("best"), 6).alias("score")).where("score > 0.5")
    fused = op.weighted_fuse(op.rank(scores, "item_id", "doc_id", 20), share, "item_id", "doc_id")
    return op.rank(fused, "item_id", "doc_id", 10)


@query("""with w as (select lower(text) as t, doc_id from documents), q(term) as (values ('license'), ('with'), ('token')), s as (select doc_id, sum(case when length(term) > 2 then (length(t) - length(replace(t, term, ''))) // length(term) else 0 end)::bigint as score from w, q group by 1) select doc_id, score from s where score > 0 order by score desc, doc_id limit 20""")
def term_count_search(spark, d):
    t = F.lower("text")
    n = sum(((F.length(t) - F.length(F.replace(t, F.lit(w), F.lit("")))) / len(w)).cast("long") for w in ("license", "with", "token"))
    return load(spark, d, "documents").select("doc_id", n.alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(20)


@query("""select label, cast(count(*) as bigint) as n, count(*) filter (rn <= least(3, greatest(0, n_all - 2))) as n_test from (select label, row_number() over (partition by label order by md5(vec_id::varchar), vec_id) as rn, count(*) over (partition by label) as n_all from embeddings) group by 1""")
def stratified_split(spark, d):
    w = Window.partitionBy("label")
    e = load(spark, d, "embeddings").select("label", "vec_id", F.row_number().over(w.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id")).alias("rn"))
    n = e.groupBy("label").agg(F.count(F.lit(1)).alias("n_all"))
    return e.join(n, "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rn") <= F.least(F.lit(3), F.greatest(F.lit(0), F.col("n_all") - 2))).alias("n_test"))
