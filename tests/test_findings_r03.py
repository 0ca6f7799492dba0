"""What grew with copies, or told otherwise than its SQL: findings of the third review."""

import random

import duckdb
from pyspark.sql import functions as F

from quarry import store
from quarry.functions import entities as en
from quarry.functions import records as rec
from quarry.operators import bayes, graph, joins, metrics
from quarry.plans import ORACLE, QUERIES
from quarry.sources import html
from quarry.sources import timetable as tt


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_word_borders_are_those_of_ascii_words(spark):
    k = spark.createDataFrame([("3 cr\u00e8me, \u00e912:30 and x12:30, 5 credits",)], "t string").select(rec.document_kind(F.col("t")).alias("k")).first()["k"]
    assert (k["credits"], k["times"], k["semesters"]) == (2, 1, 3)


def test_cuts_are_written_down(spark):
    df = spark.range(2000).select(F.lit("a").alias("k"), (F.col("id") * 7 % 2000).cast("double").alias("v"))
    got = metrics.index_percentiles(df, ["k"], "v", {"p": 0.95})
    assert "percentile_approx" not in plan(got)  # it was worked out twice, and may cut elsewhere the second time
    assert got.first()["p"] == 1900.0


def test_candidates_are_cut_before_the_join(spark, sf):
    p = plan(QUERIES["candidates"](spark, sf))
    assert p.rindex("Window") > p.index("Join")


def test_equal_questions_are_answered_once(spark):
    e = spark.createDataFrame([(False, "AB-123", "Monday", "09:30", "R", 3, "Logic", "Ann", "L"), (False, "AB-124", "Friday", "09:30", "R", 3, "Graphs", "Bo", "G")], "corrupt boolean, code string, day string, start string, section string, semester int, title string, instructor string, abbreviation string")
    asked = spark.range(60).select(F.col("id").alias("q"), F.when(F.col("id") % 2 == 0, "class ab-123").otherwise("logic Ann").alias("text"))
    got = tt.search(e, tt.questions(asked, "q", "text"), "q")
    assert sorted(map(tuple, got.select("q", "code", "rule").collect())) == [(k, "AB-123", 1 if k % 2 == 0 else 4) for k in range(60)]
    assert plan(got).splitlines()[1].lstrip().startswith("+- Join") or plan(got).index("Join") < plan(got).index("Aggregate")  # questions come in after all else


def test_fallback_alike_equals_fallback_join(spark):
    rng = random.Random(3)
    left = spark.createDataFrame([(i, rng.choice("xyz") if i % 9 else None, rng.choice("RST") if i % 7 else None) for i in range(200)], "id int, k string, want string")
    right = spark.createDataFrame([(rng.choice("xyw"), rng.choice("RSU"), v) for v in range(12)] + [(None, "R", 99)], "k string, sec string, v int")
    ok = F.col("want") == F.col("sec")
    alike = joins.fallback_alike(left, right, ["k"], ok, ["want"])
    columns = ["id", "k", "want", "sec", "v"]
    assert sorted(map(tuple, alike.select(columns).collect()), key=repr) == sorted(map(tuple, joins.fallback_join(left, right, ["k"], "id", ok).select(columns).collect()), key=repr)
    assert plan(alike).index("Join") < plan(alike).index("Window")  # no window over the rows of the result


def test_held_patterns_find_the_same_in_long_runs_too(spark):
    rng = random.Random(4)
    words = ["CS 101", "is", "was", "are", "passed", "failed", "my", "current", "course", "has been", "completed", "-", ".", " ", "already", "\u00e9", "done"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))).lower() for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in {p for ps in en.STATUS.values() for p in ps if p.startswith(en.RUN)}:
        both = df.select(*(F.regexp_extract_all("t", F.lit("(?i)" + x), F.lit(1)).alias(n) for n, x in (("a", p), ("b", en.FROM_START + p))))
        assert both.where("a <> b").count() == 0
    long = spark.createDataFrame([("cs 101 " * 12_000 + "is passed",)], "t string").select(en.course_status(F.col("t")).alias("s")).first()["s"]
    assert long["completed"] == ["CSC-101"] and long["failed"] == []


def test_pages_are_read_a_few_at_a_time(spark):
    pages = spark.range(200).select(F.col("id").alias("page_id"), F.when(F.col("id") % 50 > 0, F.concat(F.lit("<p>a<b>b</b></p>"), F.col("id"))).alias("html"))
    got = html.page_text(pages)
    assert "MapInArrow" in plan(got) and {r["page_id"]: r["text"] for r in got.collect()} == {k: f"ab\n{k}" if k % 50 else "" for k in range(200)}


def test_only_runs_that_begin_like_a_name_are_spread_out(spark):
    docs = spark.createDataFrame([(1, "one two three four five two three"), (2, "three two")], "d long, t string")
    names = spark.createDataFrame([(1, "two three"), (2, "two three four five"), (3, "three")], "e long, name string")
    got = en.mentions(docs, names, "d", "t", "e")
    assert "LeftSemi" in plan(got)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 5, 2), (1, 2, 1, 4), (2, 3, 0, 1)]


def test_weighted_fuse_cuts_documents_into_words_once(spark, sf):
    before = set(store._written)
    QUERIES["weighted_fuse"](spark, sf)
    assert len([p for p in set(store._written) - before if "quarry-words-" in p]) == 1


def test_half_minutes_go_to_the_even_one(spark, tmp_path):
    """From 23:31, 28.5 minutes are 28 in SQL, and the end is on the same day."""
    rows = [(k, value) for k, value in enumerate([9.5, 9.0, 10.5, 9.83, 0.0], 1)]
    e = spark.createDataFrame(rows, "event_id long, value double").selectExpr("event_id", "timestamp_ntz '2024-01-01 23:31:00' as ts", "1L as user_id", "'view' as event_type", "value", "'{\"k\": 7}' as props")
    e.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: tuple(r["errors"]) for r in QUERIES["csv_file_validate"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert got == {k: tuple(v) for k, v in c.execute(ORACLE["csv_file_validate"]).fetchall()} and got[1] == ()


def test_crowded_graphs_are_walked_by_level(spark, monkeypatch):
    rng = random.Random(6)
    pairs = {(f"n{a}", f"n{rng.randrange(600)}") for a in range(600) for _ in range(3)} | {(f"t{i}", f"t{i - 1}") for i in range(1, 21)} | {("t0", "n0"), ("n1", "t7"), ("n2", "n2")}
    ahead = {}
    for a, b in pairs:
        ahead.setdefault(a, set()).add(b)
    want = {}
    for start in ahead:
        level, depth, seen = {start}, 0, {start}
        while level:
            level, depth = set().union(*(ahead.get(x, ()) for x in level)) - seen, depth + 1
            seen |= level
            want |= {(start, x): depth for x in level}
    walked, crowded = [], graph._crowded
    monkeypatch.setattr(graph, "_crowded", lambda reach, depth: walked.append(depth) or crowded(reach, depth))
    got = graph.closure(spark.createDataFrame(sorted(pairs), "child string, parent string")).collect()
    assert len(got) == len(want) and {(r["start"], r["node"]): r["depth"] for r in got} == want
    assert walked == [2]  # it doubled on, with a row for every two halves of a path


def test_labelled_documents_are_joined_and_written_once(spark, sf):
    before = set(store._written)
    p = plan(QUERIES["nb_ngrams"](spark, sf))
    assert len([x for x in set(store._written) - before if "quarry-labelled-" in x]) == 1
    assert "toxic" in p and "lang" not in p  # what is told reads the written table, not both tables again


def test_ngrams_of_all_lengths(spark):
    rows = [["a", "b", "c"], ["a", None, "b"], ["a", "b"], ["a"], [], None]
    got = spark.createDataFrame([(w,) for w in rows], "w array<string>").select(bayes.ngrams(F.col("w"), 3).alias("g"))
    want = [w and w + [" ".join(x for x in w[i : i + n] if x) for n in (2, 3) for i in range(len(w) - n + 1)] for w in rows]
    assert [r["g"] for r in got.collect()] == want
    assert "array_join" not in plan(got)  # each run was cut out and joined as an array of its own
