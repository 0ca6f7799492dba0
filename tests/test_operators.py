"""Small fixtures for what the test tables do not show: ties, nulls, cycles, late data."""

import datetime as dt

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions import urls
from quarry.operators import graph, joins, metrics, rules, sets, windows
from quarry.operators import search as op
from quarry.sources import bundle, csvio, html
from quarry.streaming import windows as st


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_touching_intervals_do_not_overlap(spark):
    df = spark.createDataFrame([(1, "x", 0, 10), (2, "x", 10, 20), (3, "x", 5, 12), (4, "y", 0, 99)], "id int, k string, s int, e int")
    assert rows(joins.overlaps(df, ["k"], "id", "s", "e")) == [("x", 1, 3), ("x", 2, 3)]
    assert rows(joins.overlaps(df, ["k"], "id", "s", "e", bin_size=4)) == [("x", 1, 3), ("x", 2, 3)]


def test_islands_merge_within_gap(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 8), ("a", 10, 12), ("a", 20, 21)], "k string, s int, e int")
    assert rows(windows.islands(df, ["k"], "s", "e", gap=2)) == [("a", 0, 12, 3), ("a", 20, 21, 1)]


def test_fallback_join_takes_all_if_none_is_compatible(spark):
    left = spark.createDataFrame([(1, "x", "R"), (2, "x", "Z")], "id int, k string, want string")
    right = spark.createDataFrame([("x", "R", 10), ("x", "S", 20)], "k string, sec string, v int")
    out = joins.fallback_join(left, right, ["k"], "id", F.col("want") == F.col("sec"))
    assert rows(out.select("id", "v")) == [(1, 10), (2, 10), (2, 20)]


def test_unique_link(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, k string")
    right = spark.createDataFrame([("a", 9), ("b", 1), ("b", 2)], "k string, t int")
    out = joins.unique_link(left, right, ["k"], "id", "t").select("id", "link_status", "t")
    assert rows(out.na.fill(-1)) == [(1, "linked", 9), (2, "ambiguous", -1), (3, "missing", -1)]


def test_upsert_keeps_first_value(spark):
    old = spark.createDataFrame([("u", 1, "seed"), ("v", 1, None)], "url string, at int, found string")
    new = spark.createDataFrame([("u", 2, "later"), ("w", 2, "x")], "url string, at int, found string")
    got = {r["url"]: (r["at"], r["found"]) for r in windows.upsert(old, new, ["url"], "at", ["found"]).collect()}
    assert got == {"u": (2, "seed"), "v": (1, None), "w": (2, "x")}


def test_sets(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (4, "w")], "k int, v string")
    assert rows(sets.version_counts(a, b)) == [(2, 2, 1)]
    got = {r["k"]: (r["change"], r["changed"]) for r in sets.classify_changes(a, b, ["k"], ["v"]).collect()}
    assert got == {1: ("unchanged", []), 2: ("changed", ["v"]), 3: ("gone", []), 4: ("new", [])}


def test_graph_cycles_and_canonical_codes(spark):
    e = spark.createDataFrame([("b", "a"), ("a", "c"), ("c", "b"), ("d", "d"), ("old", "a")], "child string, parent string")
    canon = spark.createDataFrame([("old", "a")], "code string, canonical string")
    clean = graph.edges(e, canon)
    assert rows(clean) == [("a", "c"), ("b", "a"), ("c", "b")]
    assert [r["path"] for r in graph.cycles(clean).collect()] == [["a", "c", "b", "a"]]
    assert ("b", "c", 2) in rows(graph.closure(clean))


def test_missing_prerequisites(spark):
    e = spark.createDataFrame([("c", "a"), ("c", "b")], "child string, parent string")
    done = spark.createDataFrame([("me", "a")], "who string, node string")
    want = spark.createDataFrame([("me", "c"), ("me", "a")], "who string, node string")
    assert rows(graph.missing(e, want, done)) == [("me", "a", 0, []), ("me", "c", 2, ["b"])]


def test_index_percentile(spark):
    one = spark.createDataFrame([("a", 5.0)], "k string, v double")
    twenty = spark.createDataFrame([("b", float(i)) for i in range(20)], "k string, v double")
    assert rows(metrics.index_percentiles(one.union(twenty), ["k"], "v", {"p": 0.95})) == [("a", 5.0), ("b", 19.0)]


def test_context_passes_over_what_does_not_fit(spark):
    r = spark.createDataFrame([(1, 10, 1, 900), (1, 11, 2, 500), (1, 12, 3, 90), (2, 13, 1, 5000)], "q int, d long, rank int, size long")
    assert rows(op.select_context(r, "q", "d", "size", 1000).select("q", "d")) == [(1, 10), (1, 12), (2, 13)]


def test_fee_cells_have_three_states(spark):
    df = spark.createDataFrame([("1,500",), ("as per credit",), ("-",), (None,)], "c string")
    assert [tuple(r) for r in df.select(*rules.fee_cell(F.col("c"))).collect()] == [(1500, "number"), (None, "formula"), (None, "none"), (None, "none")]


def test_text_functions(spark):
    df = spark.createDataFrame([("CS-101 cs 101, MATH210",)], "t string")
    assert df.select(tx.codes(F.col("t"))).first()[0] == ["CSC-101", "MATH-210"]  # CS and CSC are one
    clock = spark.createDataFrame([("8:30",), ("08.30",), ("1:35 PM",), ("12:05 am",), ("25:00",), ("x",)], "t string")
    assert [r[0] for r in clock.select(tx.clock_minutes(F.col("t"))).collect()] == [510, 510, 815, 5, None, None]
    lines = spark.createDataFrame([("a\na\n\nb\na",)], "t string")
    assert lines.select(tx.drop_repeated_lines(F.col("t"))).first()[0] == "a\nb\na"


def test_urls(spark):
    df = spark.createDataFrame([("HTTP://WWW.Ex.org/a/?ref=1&b=2#top",), ("https://m.ex.org/?utm_source=q",)], "u string")
    assert [r[0] for r in df.select(urls.canonical(F.col("u"))).collect()] == ["https://ex.org/a/?b=2", "https://ex.org"]


def test_html(spark):
    page = "<html><nav>menu</nav><h2>Fees</h2><p>Per term</p><table><tr><td>A</td><td>1</td></tr></table><script>x</script></html>"
    assert html.to_text(page) == "## Fees\nPer term\nA | 1"
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert [tuple(r)[2:] for r in html.sections(df).collect()] == [("Fees", "Per term\nA | 1")]


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿Weekday;From;To;Venue;Course Code\nMonday;8:30;10:00;R1;CS-101\nFunday;9:00;8:00;;CS-101\n")
    out = csvio.validate(csvio.read(spark, str(tmp_path / "t.csv"))).orderBy("start")
    assert [r["errors"] for r in out.collect()] == [[], ["day", "order", "room"]]
    csvio.write(spark.createDataFrame([("=1+1",), ("-5",)], "c string"), str(tmp_path / "out"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "out"))) == [("'=1+1",), ("-5",)]


def test_bundle(spark, tmp_path):
    root = str(tmp_path / "b")
    for k in range(5):
        bundle.publish(spark.range(k + 1), root, f"2024-0{k}")
    assert bundle.current(spark, root).count() == 5
    assert bundle.prune(spark, root) == ["2024-01", "2024-00"]


def test_limiter_ignores_rejected_hits():
    times = []
    assert [st.admit(times, float(t), ((2, 10.0),)) for t in (0, 1, 2, 3, 11, 11.5, 12)] == [True, True, False, False, True, True, False]


def _stream(spark, tmp_path, data):
    schema = "event_id long, user_id long, event_type string, value double, ts timestamp"
    for k, part in enumerate(data):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return st.events(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files=1)


def _run(df, mode, name, spark, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_streams(spark, tmp_path):
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    data = [[(1, 7, "a", 1.0, t(1)), (2, 7, "b", 2.0, t(1, 20))], [(3, 7, "a", 3.0, t(9)), (4, 8, "a", 4.0, t(9))]]
    s = _stream(spark, tmp_path, data)
    day = _run(st.tumbling(s, "1 day", "1 hour", ["event_type"]), "complete", "days", spark, tmp_path)
    assert rows(day.select("event_type", "n", "total")) == [("a", 3, 8.0), ("b", 1, 2.0)]
    part = _run(st.sessions(s, "1 hour", "1 hour", "user_id"), "append", "sess", spark, tmp_path)
    assert (7, 2) in rows(part.select("user_id", "n"))
    new = _run(st.latest(s, ["user_id"], "event_type", "event_id"), "complete", "last", spark, tmp_path)
    assert rows(new.select("user_id", "event_type")) == [(7, "a"), (8, "a")]
