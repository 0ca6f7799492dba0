"""Records, stores and lookups against small cases and plain Python."""

import json
import random

from pyspark.sql import functions as F

from quarry.functions import entities as en
from quarry.functions import records as rec
from quarry.operators import metrics, search, windows
from quarry.sources import csvio


def one(spark, column, *values, schema="t string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column.alias("x")).collect()]


def test_profile_takes_the_first_of_each_and_nothing_where_none_is(spark):
    text = "Chairperson\nDr. Ann B. Lee, Lecturer, Professor\nOffice: \nResearch Interests: sets; graphs, sets,\nmail a.b@c.d.org or x@y.zz call +1 (22) 333 444"
    full, bare, head, none = one(spark, rec.profile(F.col("t")), text, "", "Chairperson", None)
    assert full["name"] == "Dr. Ann B. Lee" and full["rank"] == "Lecturer" and full["email"] == "a.b@c.d.org" and full["phone"] == "+1 (22) 333 444"
    assert full["office"] is None and full["interests"] == ["sets", "graphs"]
    assert list(bare)[:5] == [None] * 5 and bare["interests"] == [] and head["rank"] == "Chairperson" and none is None


def test_faq(spark):
    got = one(spark, rec.faq(F.lit("Help"), F.col("t")), "intro\n**Q: Why?** so\nand so\n**Q: open\n\n", "**Q: a**", "no **Q: here", "plain", "")
    assert [tuple(b) for b in got[0]] == [("Help", "intro", False), ("Help › FAQ: Why?", "**Q: Why?** so\nand so", True), ("Help › FAQ", "**Q: open", True)]
    assert [tuple(b) for b in got[1]] == [("Help › FAQ: a", "**Q: a**", True)]
    assert [tuple(b[0]) for b in got[2:]] == [("Help", "no **Q: here", False), ("Help", "plain", False), ("Help", "", False)]


def test_fee_rows_and_their_figures(spark):
    text = "9 | Before | 1 | 2\n**A | B**\n(a) | Tuition: | 1,200/- | **3,400**\nTotal | 10 | –\nNote | one | 5\nlone | 7"
    shown = rec.labelled_rows(F.col("t"), r"^A\s*\|\s*B$", ["Day", "Night"], "EUR")
    (got,) = one(spark, shown, text)
    assert got.split("\n") == ["9 | Before | 1 | 2", "**A | B**", "Tuition: Day = 1,200 EUR; Night = 3,400 EUR", "Total: Day = 10 EUR; Night = – EUR", "Note | one | 5", "lone | 7"]
    figure = lambda head, label: one(spark, rec.row_figure(shown, head, label), text)[0]
    assert figure("Total", "Day") == 10 and figure("Total", "Night") is None and figure("Tuition", "Night") == 3400 and figure("Other", "Day") is None
    assert one(spark, rec.row_figure(shown, "Total", "Day"), text + "\nTotal | 11 | 1", None) == [None, None]


def test_kinds_codes_and_kept_fields(spark):
    table = "CS101 | Mon | 9:30 AM\nCS102 | TUESDAY | 10:00\nCS103 | mon | 11:15"
    scheme = "\n".join(f"Semester {k} | CODE{k} | {k} credits | WORD{k} 2 Cr" for k in range(1, 6))
    assert [k and k["kind"] for k in one(spark, rec.document_kind(F.col("t")), table, table.replace("|", ","), scheme, "", None)] == ["timetable", "generic", "scheme_of_study", "generic", None]
    assert one(spark, rec.printed_code(F.col("t")), " cs 413 ", "CSC-413b", "math413", "physics101", "", None) == ["CS-413", "CSC-413B", "MATH-413", "", "", ""]
    keys = spark.createDataFrame([("cs 413L", "x"), ("odd", "The  Art, of It!"), ("Odd 1", None), (None, "")], "c string, t string").select(rec.code_key(F.col("c"), F.col("t")))
    assert [r[0] for r in keys.collect()] == ["CSC-413", "MANUAL-the-art-of-it", "MANUAL-odd-1", "MANUAL-"]
    assert one(spark, rec.keep_meta(F.col("t")), {"day": "Mon", "x": "y", "room": "", "term": None}, schema="t map<string,string>") == [{"day": "Mon"}]


def test_metadata_loses_optional_fields_in_order(spark):
    df = spark.createDataFrame([(1, "r" * 10, "f" * 10), (2, "r" * 90, "f" * 10), (3, "r" * 90, "f" * 90), (4, "é" * 40, None)], "id long, room string, faculty string")
    got = {x["id"]: set(x) - {"id"} for x in (json.loads(r[0]) for r in df.select(rec.fit_json(["id"], ["room", "faculty"], 80)).collect())}
    assert got == {1: {"room", "faculty"}, 2: {"faculty"}, 3: set(), 4: set()}


def test_keyed_upsert_and_children(spark):
    old = spark.createDataFrame([("a", 1, "x", True), ("b", 1, "y", False)], "k string, at long, title string, active boolean")
    new = spark.createDataFrame([("b", 3, None, True), ("b", 2, "z", True), ("c", 1, "w", True), ("c", 2, "v", False)], old.schema)
    got = sorted(map(tuple, windows.keyed_upsert(old, new, ["k"], "at", ["active"]).collect()))
    assert got == [("a", 1, "x", True), ("b", 3, None, False), ("c", 2, "v", True)]
    assert windows.keyed_upsert(old.limit(0), new.limit(0), ["k"], "at", ["active"]).count() == 0
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v string")
    left = windows.replace_children(rows(("a", "1"), ("b", "2"), ("b", "3")), rows(("b", ""), ("b", ""), ("c", "")), rows(("c", "4")), ["k"])
    assert sorted(map(tuple, left.collect())) == [("a", "1"), ("c", "4")]


def test_percentiles_are_elements_whatever_the_cuts(spark):
    rng = random.Random(5)
    rows = [(k, float(rng.choice([1, 2, rng.random() * 100]))) for k in "abc" for _ in range(700)] + [("d", None), ("e", 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    for parts in (2, 64):
        got = {r["k"]: (r["p"], r["q"], r["z"]) for r in metrics.index_percentiles(df, ["k"], "v", {"p": 0.5, "q": 0.99, "z": 0.0}, parts).collect()}
        for k in "abce":
            v = sorted(x for j, x in rows if j == k and x is not None)
            assert got.pop(k) == tuple(v[min(len(v) - 1, int(len(v) * p))] for p in (0.5, 0.99, 0.0))
        assert got == {}


def test_mentions_of_long_names(spark):
    docs = spark.createDataFrame([(1, "the red big old grey wolf ran to red big old house"), (2, None), (3, "")], "d long, t string")
    names = spark.createDataFrame([(1, "Red Big Old Grey Wolf"), (2, "red big"), (3, "old house"), (4, "grey wolf ran"), (5, "red big old grey cat"), (6, None)], "e long, name string")
    assert sorted(map(tuple, en.mentions(docs, names, "d", "t", "e").collect())) == [(1, 1, 1, 5), (1, 2, 8, 2), (1, 3, 10, 2)]


def test_containing_equals_every_pair(spark):
    rng = random.Random(2)
    names = [(k, "".join(rng.choice("abC ") for _ in range(rng.randint(0, 9)))) for k in range(150)] + [(200, None)]
    asked = [(k, "".join(rng.choice("ABc") for _ in range(rng.randint(1, 5)))) for k in range(40)] + [(90, ""), (91, None), (92, "zzz")]
    got = search.containing(spark.createDataFrame(names, "i long, name string"), spark.createDataFrame(asked, "q long, text string"), "i", "q")
    assert sorted(map(tuple, got.collect())) == sorted((q, i) for q, t in asked for i, n in names if t and n and t.lower() in n.lower())


def test_registry_keeps_one_row_a_key(spark, tmp_path):
    path = str(tmp_path / "r.csv")
    (tmp_path / "r.csv").write_text('url,title\nHTTP://A.b/,"say ""x"",\nnow"\n ,gone\nhttp://a.b/,zz\nc,\n')
    got = csvio.registry(spark, path, "url", F.lower(F.trim("url"))).collect()
    assert sorted(map(tuple, got), key=repr) == [("c", None), ("http://a.b/", "zz")]
    (tmp_path / "h.csv").write_text("url,title\n")
    assert csvio.registry(spark, str(tmp_path / "h.csv"), "url").count() == 0


def test_containing_pairs_blocks_and_shuffles_no_result(spark):
    items = spark.range(3000).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, "Ash").otherwise("Oak").alias("name"))
    asked = spark.range(2500).select(F.col("id").alias("q"), F.when(F.col("id") % 2 == 0, "AS").otherwise("none").alias("text"))
    got = search.containing(items, asked, "i", "q")
    assert got.agg(F.count(F.lit(1)), F.countDistinct("q"), F.countDistinct("i"), F.sum(F.col("i") % 3 + F.col("q") % 2)).first() == (1250 * 1000, 1250, 1000, 0)
    assert search._blocks(asked, "text", "q", "b").agg(F.max(F.size("b"))).first()[0] < 2 * search.BLOCK
    plan = got._jdf.queryExecution().optimizedPlan().toString()  # both lists are spread out after the last join
    assert plan.index("Generate explode(_found") < plan.index("Generate explode(_asked") < plan.index("Join")
