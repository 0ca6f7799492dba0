"""What took too long or left work out: findings of the fourth review."""

import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from quarry import store
from quarry.operators import graph, quotes, search, walks
from quarry.plans import ORACLE, QUERIES


def reached(pairs):
    """{(start, node): depth} by a plain walk from each start."""
    ahead, want = {}, {}
    for a, b in pairs:
        ahead.setdefault(a, set()).add(b)
    for start in ahead:
        level, depth, seen = {start}, 0, {start}
        while level:
            level, depth = set().union(*(ahead.get(x, ()) for x in level)) - seen, depth + 1
            seen |= level
            want |= {(start, x): depth for x in level}
    return want


def crowded():
    rng = random.Random(8)
    return sorted({(a, rng.randrange(200)) for a in range(200) for _ in range(2)} | {(1000 + i, 999 + i) for i in range(1, 12)} | {(1000, 3), (5, 1011)})


def test_cells_send_on_what_leaves_their_chunk(spark):
    """Chunks of 90 nodes: ways cross them often, and a longer way may come first. One chunk tells the same in one round."""
    edges = [p for p in crowded() if p[0] != p[1]]
    want = reached(edges)
    e = spark.createDataFrame(edges, "start long, node long")
    nodes = walks.numbered(e)
    ends = nodes.select("num", "node")
    for chunk in (90, walks.CHUNK):
        told = walks.walk(e, nodes, chunk).where("depth > 0").mapInArrow(walks.pairs, "num long, node long, depth int")
        got = told.withColumnRenamed("node", "end").join(ends.withColumnRenamed("node", "start"), "num").join(ends.select(F.col("num").alias("end"), "node"), "end").collect()
        assert len(got) == len(want) and {(r["start"], r["node"]): r["depth"] for r in got} == want


def test_texts_of_a_graph_are_told_without_a_row_for_each_pair(spark):
    edges = [p for p in crowded() if p[0] != p[1]]
    e = spark.createDataFrame(edges, "child long, parent long")
    names = spark.createDataFrame([(n,) for n in sorted({x for p in edges for x in p})], "concept long").withColumn("name", F.concat(F.lit("n"), "concept"))
    want = {}
    for (start, node), depth in reached(edges).items():
        want.setdefault(start, []).append((-depth, node))
    want = {(s, k // 7): f"n{s} sequence: " + " > ".join(f"n{n}" for _, n in sorted(v)[k : k + 7]) for s, v in want.items() for k in range(0, len(v), 7)}
    before = set(store._written)
    got = graph.documents(e, names, 7).where("kind = 'sequence'")
    assert not any("quarry-closure-" in p for p in set(store._written) - before)  # nor a round for each few levels
    assert {(r["concept"], r["block"]): r["text"] for r in got.collect()} == want
    hop = e.select(F.col("child").alias("start"), F.col("parent").alias("node"))
    nodes = walks.numbered(hop)
    known = walks.listed(walks.bits(graph.closure(e), nodes), nodes, names, " > ", 7)  # the way of graphs that are not crowded
    assert {(r["concept"], r["block"]): f"{r['name']} sequence: {r['text']}" for r in known.collect()} == want


def test_a_task_holds_few_pairs_of_a_text_that_many_ask_and_have(spark):
    n = 900
    items = spark.range(n).select("id", F.lit("red ring").alias("name"))
    asked = spark.range(n).select(F.col("id").alias("q"), F.lit("RING").alias("text"))
    largest = lambda rows, key, ident: search._blocks(rows, key, ident, "b").agg(F.max(F.size("b"))).first()[0]
    assert largest(items, "name", "id") * largest(asked, "text", "q") < n * n / 4
    assert search.containing(items, asked, "id", "q").distinct().count() == n * n


def test_short_quotes_are_looked_for_too(spark, tmp_path):
    text = "The fee of the programme is 5,000 rupees for eighteen weeks."
    sha = hashlib.sha256(text.encode()).hexdigest()
    sources = spark.createDataFrame([(1, text)], "source long, text string")
    cited = [("fee", ["FEE"]), ("two", ["5,000", "weeks."]), ("gone", ["fees"]), ("part", ["fee", "fees"]), ("blank", [" \n"]), ("null", [None])]
    got = quotes.citation_integrity(spark.createDataFrame([(a, 1, sha, q) for a, q in cited], "answer string, source long, sha256 string, quotes array<string>"), sources)
    assert {r["answer"]: r["valid"] for r in got.collect()} == {"fee": 1, "two": 1, "gone": 0, "part": 0, "blank": 0, "null": 0}
    rows = [(k, "ab" + " " * 60 + "cd" + "e" * 60) for k in range(1, 40)]  # quotes of few letters once spaces are single
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = {(r["answer"], r["citations"], r["valid"], r["integrity"]) for r in QUERIES["citation_integrity"](spark, str(tmp_path)).collect()}
    assert got == set(c.execute(ORACLE["citation_integrity"]).fetchall()) and sum(r[2] for r in got) > 10


def test_weighted_fuse_is_asked_by_every_item(spark, sf):
    asked = {r["item_id"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    before = set(store._written)
    assert {r["item_id"] for r in QUERIES["weighted_fuse"](spark, sf).select("item_id").collect()} == asked
    assert len([p for p in set(store._written) - before if "quarry-scores-" in p]) == 1  # words are met once for both scores
    assert "% 20" not in ORACLE["weighted_fuse"]
