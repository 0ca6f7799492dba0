"""Near words, quotes, citations and claims against plain Python."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import quotes, spelling


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_near_words_against_brute_force(spark):
    rng = np.random.default_rng(6)
    word = lambda low, high: "".join(rng.choice(list("abc"), int(rng.integers(low, high))))
    words = sorted({word(1, 16) for _ in range(250)} | {"abcabcabcabcabcabc", "abcabcabcabcabcabd"})
    asked = sorted({word(3, 16) for _ in range(60)} | {"abcabcabcabcabcabca"})
    v = spark.createDataFrame([(w, k + 1) for k, w in enumerate(words)] + [(None, 1)], "word string, freq long")
    a = spark.createDataFrame([(w,) for w in asked] + [(None,), (asked[0],)], "asked string")
    for edits in (1, 2):
        got = {(r["asked"], r["word"], r["distance"]) for r in spelling.near_words(a, v, edits).collect()}
        assert got == {(x, w, distance(x, w)) for x in asked for w in words if distance(x, w) <= edits}
    assert spelling.near_words(a, v.limit(0)).count() == 0


def test_corrections(spark):
    v = spark.createDataFrame([("course", 4000), ("coarse", 3), ("source", 9000), ("known", 5)], "word string, freq long")
    a = spark.createDataFrame([("courze",), ("known",), ("zzzzzz",)], "asked string")
    assert [tuple(r) for r in spelling.corrections(a, v).collect()] == [("courze", "course", 1, 0.82943, True)]


def test_long_words_have_few_forms(spark):
    n = spark.range(1).select(F.size(spelling.forms(F.lit("abcdefghijklmnopqrstuvwxyz" * 10_000), 2))).first()[0]
    assert n == 56


def test_quotes_against_brute_force(spark):
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(["Ab", "ba", "éa\n", "b"], 60)) for _ in range(40)] + ["", None, "short", "x" * 200_000 + " tail of it all"]
    asked = [(k, t[j : j + n]) for k in range(60) if (t := texts[k % 40]) for j, n in [(int(rng.integers(0, 60)), int(rng.integers(5, 50)))]]
    asked += [(100, None), (101, ""), (102, "tiny"), (103, "x tail  OF it all"), (104, "x" * 12), (105, "not in any of them at all")]
    plain = lambda t: " ".join((t or "").lower().split())
    s = spark.createDataFrame(list(enumerate(texts)), "sid long, text string")
    q = spark.createDataFrame(asked, "qid long, quote string")
    got = {tuple(r) for r in quotes.find(q, s, "qid", "quote", "sid", "text").collect()}
    assert got == {(k, i) for k, x in asked for i, t in enumerate(texts) if len(plain(x)) >= 12 and plain(x) in plain(t)}
    assert quotes.find(q.limit(0), s, "qid", "quote", "sid", "text").count() == quotes.find(q, s.limit(0), "qid", "quote", "sid", "text").count() == 0


def test_citations_and_claims(spark):
    text = "The fee of the programme is 5,000 rupees for eighteen weeks."
    sha = hashlib.sha256(text.encode()).hexdigest()
    sources = spark.createDataFrame([(1, "Fees 2024", text), (2, "Other", "Nothing of that kind is here.")], "source long, title string, text string")
    cited = [("a", 1, sha, ["fee of the Programme", "eighteen weeks"]), ("a", 1, sha, ["fee of the programme", "nineteen weeks"]), ("a", 1, "0" * 64, ["fee of the programme"]), ("a", 9, sha, ["fee of the programme"]), ("a", 1, sha, []), ("b", 2, sha, ["fee of the programme"]), ("a", 1, None, None)]
    got = quotes.citation_integrity(spark.createDataFrame(cited, "answer string, source long, sha256 string, quotes array<string>"), sources).collect()
    assert sorted(map(tuple, got)) == [("a", 6, 1, 0.166667), ("b", 1, 0, 0.0)]
    claims = [(1, "It is 5000 in 2024 [1, 2]", 1, "programme is 5,000 rupees"), (2, "It is 6000", 1, "programme is 5,000 rupees"), (3, "x", 1, "fee"), (4, "x", 1, "is not printed there"), (5, "x", 7, "programme is 5,000 rupees"), (6, "18 weeks", 1, "rupees for eighteen weeks"), (7, "x", 1, None), (8, None, 1, "programme is 5,000 rupees")]
    told = dict(map(tuple, quotes.claim_problems(spark.createDataFrame(claims, "claim long, text string, source long, quote string"), sources).collect()))
    assert told == {1: None, 2: "number without support", 3: "no quote", 4: "quote not in source", 5: "unknown source", 6: None, 7: "no quote", 8: None}


def test_quotes_meet_the_sources_they_name_alone(spark):
    n, text = 500, "the same words stand in each of these texts"
    sources = spark.range(n).select(F.col("id").alias("source"), F.lit("t").alias("title"), F.lit(text).alias("text"))
    cited = spark.range(n).select((F.col("id") % 2).alias("answer"), F.col("id").alias("source"), F.sha2(F.lit(text).cast("binary"), 256).alias("sha256"), F.array(F.lit("SAME  words stand"), F.lit("SAME  words stand")).alias("quotes"))
    claims = spark.range(n).select(F.col("id").alias("claim"), F.lit("x").alias("text"), F.col("id").alias("source"), F.lit("in each of these").alias("quote"))
    for got, want in ((quotes.citation_integrity(cited, sources), {(0, 250, 250, 1.0), (1, 250, 250, 1.0)}), (quotes.claim_problems(claims, sources), {(k, None) for k in range(n)})):
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 1 and "quote_id" not in plan and "-held" not in plan  # 500 quotes by 500 copies met before
        assert {tuple(r) for r in got.collect()} == want
