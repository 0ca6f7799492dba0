"""Lexical, dense and fused ranking. Queries are the small side; the corpus is scanned once."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import materialize

#: (k1, b, whether a query word counts once) of the two scorings.
G3, G1 = (1.4, 0.72, False), (1.5, 0.75, True)
#: Vectors or queries in a cell of the exact neighbour search.
ROWS = 4096
#: Queries or rows of one text in a block of ``containing``: a task holds the pairs of two blocks before it hands them on.
BLOCK = 256


def prepare(docs: DataFrame, doc: str, words: Column) -> DataFrame:
    """(doc, words, len), written once: statistics and postings read it, so texts are cut into words once."""
    return materialize(docs.select(doc, words.alias("words")).withColumn("len", F.size("words")), "words")


def postings(prepared: DataFrame, doc: str, wanted: DataFrame | None = None) -> DataFrame:
    """(doc, term, tf, len); only of the terms in ``wanted(term)``, if given, which are picked before anything is shuffled by document."""
    t = prepared.select(doc, "len", F.explode("words").alias("term"))
    if wanted is not None:
        t = t.join(wanted, "term")
    return t.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))


def corpus_stats(prepared: DataFrame) -> DataFrame:
    """One row: (n, avg_len)."""
    return prepared.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))


def term_stats(post: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf)"""
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(stats)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))  # one row


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(prepared: DataFrame, doc: str, queries: DataFrame, query: str, query_words: Column, variant: tuple[float, float, bool] = G3, **more: Column) -> DataFrame:
    """(query, doc, score) of every document with a query word, and ``more`` sums over the words met, of tf and len."""
    k1, b, once = variant
    asked = queries.select(query, F.explode(query_words).alias("term")).groupBy(query, "term").agg(F.count(F.lit(1)).alias("qtf"))
    post = postings(prepared, doc, asked.select("term").distinct())
    stats = corpus_stats(prepared)
    hit = asked.join(term_stats(post, stats).drop("df"), "term").join(post, "term").crossJoin(F.broadcast(stats))  # one row
    bonus = F.lit(1.0) if once else 1 + 0.15 * F.least(F.col("qtf") - 1, F.lit(2))
    part = F.col("idf") * bonus * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return hit.groupBy(query, doc).agg(F.sum(part).alias("score"), *(c.alias(name) for name, c in more.items()))


def bm25_fielded(fields: list[tuple[DataFrame, float]], doc: str, queries: DataFrame, query: str, query_words: Column, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, doc, score): BM25 of prepared fields as one, each occurrence counting by its field's weight.

    A document's length is that of all fields; a term's documents are those with it in any field.
    """
    asked = queries.select(query, F.explode(F.array_distinct(query_words)).alias("term"))
    wanted = asked.select("term").distinct()
    post = reduce(DataFrame.unionByName, (postings(f, doc, wanted).withColumn("tf", F.col("tf") * w) for f, w in fields))
    post = post.groupBy(doc, "term").agg(F.sum("tf").alias("tf"))
    lens = reduce(DataFrame.unionByName, (f.select(doc, "len") for f, _ in fields)).groupBy(doc).agg(F.sum("len").alias("len"))
    stats = lens.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    hit = asked.join(term_stats(post, stats).drop("df"), "term").join(post, "term").join(lens, doc).crossJoin(F.broadcast(stats))  # one row
    part = F.greatest("idf", F.lit(1e-6)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return hit.groupBy(query, doc).agg(F.sum(part).alias("score"))


def rank(scores: DataFrame, query: str, item: str, k: int, score: str = "score", digits: int = 6) -> DataFrame:
    """(query, item, score, rank): the best k of each query, 1-based; ties by item.

    Scores are rounded first, so that sums in another order rank alike.
    """
    w = Window.partitionBy(query).orderBy(F.desc(score), item)
    r = scores.withColumn(score, F.round(score, digits)).withColumn("rank", F.row_number().over(w))
    return r.where(F.col("rank") <= k).select(query, item, score, "rank")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def knn(vectors: DataFrame, queries: DataFrame, item: str, vector: str, query: str, query_vector: str, k: int, score=None, least: float = -2.0) -> DataFrame:
    """(query, item, score): the k best items of each query in each cell, for ``rank`` to choose from.

    A cell is a chunk of ROWS vectors and a block of ROWS queries, multiplied as
    matrices; no pair leaves it but the best. ``score`` maps cosines to scores,
    and cosines up to ``least`` count for nothing.
    """
    parts = lambda df: max(1, -(-df.count() // ROWS))
    chunks, blocks = parts(vectors), parts(queries)
    cell = lambda df, key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    v = vectors.select(F.col(item).alias("item"), F.col(vector).cast("array<double>").alias("v"), cell(vectors, item, chunks).alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    q = queries.select(F.col(query).alias("query"), F.col(query_vector).cast("array<double>").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), cell(queries, query, blocks).alias("block"))
    kind = {c: d.schema[c].dataType.simpleString() for d, c in ((v, "item"), (q, "query"))}

    def unit(rows: pd.DataFrame) -> np.ndarray:
        m = np.stack(rows["v"].to_numpy())
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, size, out=np.zeros_like(m), where=size > 0)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            items, at = a["item"].to_numpy(), unit(a).T
            for start in range(0, len(b), 256):
                part = b.iloc[start : start + 256]
                for name, cos in zip(part["query"], unit(part) @ at):
                    fits = np.flatnonzero((cos > least) & (items != name))
                    s = np.floor((score(cos[fits]) if score else cos[fits]) * 1e6 + 0.5) / 1e6
                    keep = np.lexsort([items[fits], -s])[:k]
                    out.append(pd.DataFrame({"query": name, "item": items[fits[keep]], "score": s[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "item": [], "score": []})

    found = v.groupBy("chunk", "block").cogroup(q.groupBy("chunk", "block")).applyInPandas(best, f"query {kind['query']}, item {kind['item']}, score double")
    return found.withColumnRenamed("query", query).withColumnRenamed("item", item)


def _blocks(rows: DataFrame, key: str, ident: str, name: str, most: int = BLOCK) -> DataFrame:
    """(key, name): the ``ident`` of each key's rows as arrays of about ``most``, however many rows a key has."""
    size = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / most).alias("_blocks"))
    dealt = rows.join(size, key).withColumn("_block", F.pmod(F.xxhash64(ident), F.col("_blocks")))
    return dealt.groupBy(key, "_block").agg(F.collect_list(ident).alias(name)).drop("_block")


def containing(items: DataFrame, asked: DataFrame, item: str, query: str, size: int = 3) -> DataFrame:
    """(query, item): the rows of ``items(item, name)`` whose name contains the text of ``asked(query, text)``, case set aside.

    A text meets names by the rarest of its runs of ``size`` letters, or by all of it if it is shorter, so names are
    indexed by their runs of up to that many; what meets is then compared in full. Texts asked twice and names that
    several rows have are compared once, and no row of a result is shuffled: blocks of queries and of rows are dealt
    out, and a task pairs them as it hands them on. Nulls and empty texts find nothing; a name may hold a run often
    and counts once.
    """
    runs = lambda c, n: F.array_distinct(F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: i + n - 1 <= F.length(c)), lambda i: F.substring(c, i, F.lit(n))))
    named = items.where("name is not null").select(item, F.lower("name").alias("name"))
    wanted = asked.where("text <> ''").select(query, F.lower("text").alias("text"))
    index = named.select("name").distinct().select("name", F.explode(F.flatten(F.array(*(runs(F.col("name"), n) for n in range(1, size + 1))))).alias("run"))
    words = wanted.select("text").distinct()
    of = words.select("text", F.explode(F.when(F.length("text") < size, F.array("text")).otherwise(runs(F.col("text"), size))).alias("run"))
    held = index.join(of.select("run").distinct(), "run", "left_semi").groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    rare = of.join(held, "run", "left").groupBy("text").agg(F.min_by("run", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("run"))
    met = rare.join(index, "run").where(F.contains("name", "text")).select("text", "name")
    cells = met.join(_blocks(wanted, "text", query, "_asked"), "text").join(_blocks(named, "name", item, "_found"), "name")
    cells = cells.repartition(F.xxhash64("text", "name", F.get("_asked", F.lit(0)), F.get("_found", F.lit(0)))).select("_asked", "_found")
    return cells.select("_found", F.explode("_asked").alias(query)).select(query, F.explode("_found").alias(item))


def rrf(rankings: list[tuple[DataFrame, float]], query: str, item: str, constant: int = 60, zero_based: bool = True) -> DataFrame:
    """(query, item, score): sum of weight / (constant + rank) over rankings of 1-based ranks."""
    shift = 1 if zero_based else 0
    parts = None
    for ranked, weight in rankings:
        one = ranked.select(query, item, (F.lit(float(weight)) / (constant + F.col("rank") - shift)).alias("part"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy(query, item).agg(F.sum("part").alias("score"))


def weighted_fuse(lexical: DataFrame, dense: DataFrame, query: str, item: str, w_lexical: float = 0.6, w_dense: float = 0.4) -> DataFrame:
    """w x score / best lexical score of the query + w x max(0, cosine); the weights are made to sum to 1."""
    total = w_lexical + w_dense
    best = F.max("score").over(Window.partitionBy(query))
    kw = lexical.withColumn("kw", F.col("score") / F.nullif(best, F.lit(0.0))).select(query, item, "kw")
    both = kw.join(dense.select(query, item, F.greatest("score", F.lit(0.0)).alias("sem")), [query, item], "full")
    return both.select(query, item, (w_lexical / total * F.coalesce("kw", F.lit(0.0)) + w_dense / total * F.coalesce("sem", F.lit(0.0))).alias("score"))


def rerank(ranked: DataFrame, query: str, raw: Column, weight: Column, top: int = 12) -> DataFrame:
    """weight x sigmoid(raw) + (1 - weight) x score / best score, of the first ``top`` of each query."""
    best = F.max("score").over(Window.partitionBy(query))
    sig = 1 / (1 + F.exp(-raw))
    return ranked.where(F.col("rank") <= top).withColumn("blended", weight * sig + (1 - weight) * F.col("score") / best)


def select_context(ranked: DataFrame, query: str, item: str, size: str, budget: int, per_doc: int = 8, doc: str | None = None) -> DataFrame:
    """The items taken best first while they fit the budget; one that doesn't fit is passed over, the first always fits.

    ``ranked`` holds the best few of each query, so a query's rows are a small
    group; the choice depends on those before and runs in its order.
    """
    if doc:
        w = Window.partitionBy(query, doc).orderBy("rank")
        ranked = ranked.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_doc).drop("_k")
    rows = F.array_sort(F.collect_list(F.struct("rank", F.col(size).cast("long").alias("size"), F.col(item).alias("item"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<rank:int,size:bigint,item:bigint>>").alias("taken"))

    def step(acc, x):
        fits = (F.size(acc["taken"]) == 0) | (acc["used"] + x["size"] <= budget)
        return F.when(fits, F.struct((acc["used"] + x["size"]).alias("used"), F.concat(acc["taken"], F.array(x)).alias("taken"))).otherwise(acc)

    taken = ranked.groupBy(query).agg(rows.alias("rows")).select(query, F.aggregate("rows", start, step)["taken"].alias("taken"))
    return taken.select(query, F.inline("taken")).select(query, F.col("item").alias(item), "rank", "size")
