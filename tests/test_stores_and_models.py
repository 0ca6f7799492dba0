"""Object store, builds, naive Bayes, timetables, HTML tables and late events on small fixtures."""

import hashlib
import math
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.operators import bayes
from quarry.sources import bundle, html, objects
from quarry.sources import timetable as tt
from quarry.streaming import windows as st


def test_objects(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    assert objects.read(spark, root).count() == 0
    df = spark.createDataFrame([(1, "same"), (2, "same"), (3, ""), (4, None), (5, "other é")], "k int, t string").repartition(3)
    first = {r["sha256"]: tuple(r)[1:] for r in objects.put(df, root, "t", ".txt").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert first == {sha("same"): (4, 2, True), sha("other é"): (8, 1, True)}
    assert not any(r["stored"] for r in objects.put(df, root, "t", ".txt").collect())
    found = {r["sha256"]: (bytes(r["content"]).decode(), r["intact"]) for r in objects.read(spark, root).collect()}
    assert found == {sha(t): (t, True) for t in ("same", "other é")}
    assert not os.path.exists(f"{tmp_path}/store/tmp")  # nothing of any attempt is left
    place = f"{tmp_path}/store/objects/{sha('same')[:2]}/{sha('same')}.txt"
    with open(place, "w") as f:
        f.write("damaged")
    assert [r["sha256"] for r in objects.read(spark, root).where("not intact").collect()] == [sha("same")]


def test_catalogue_keeps_the_first_value(spark):
    df = spark.createDataFrame([("a", 1, "x", None), ("a", 2, "y", "from"), ("a", 3, "z", "later"), ("b", 1, None, None)], "url string, at int, sha string, found string")
    assert sorted(tuple(r) for r in objects.catalogue(df, "url", "at", "found").collect()) == [("a", 3, "z", "from"), ("b", 1, None, None)]


def test_builds_are_checked(spark, tmp_path):
    root = str(tmp_path / "b")
    for k in range(4):
        bundle.publish(spark.range(10 * k + 10).repartition(2), root, f"b{k}")
    assert bundle.prune(spark, root, keep=2) == ["b1", "b0"] and bundle.builds(spark, root) == ["b2", "b3"]
    assert bundle.current(spark, root).count() == 40 and bundle.problems(spark, root, "b3").count() == 0
    folder = f"{root}/build=b3"
    name = sorted(x for x in os.listdir(folder) if x.endswith(".parquet"))[0]
    spark.range(7).coalesce(1).write.parquet(f"{root}/other")
    stray = next(x for x in os.listdir(f"{root}/other") if x.endswith(".parquet"))
    os.rename(f"{root}/other/{stray}", f"{folder}/{stray}")
    assert [tuple(r) for r in bundle.problems(spark, root, "b3").collect()] == [(stray, "unknown")]
    os.replace(f"{folder}/{stray}", f"{folder}/{name}")
    with pytest.raises(ValueError, match="can't be read"):  # the file system's own checksum
        bundle.current(spark, root)
    os.remove(f"{folder}/.{name}.crc")
    assert [tuple(r) for r in bundle.problems(spark, root, "b3").collect()] == [(name, "differs")]
    os.remove(f"{folder}/{name}")
    with pytest.raises(ValueError, match="missing"):
        bundle.current(spark, root)
    assert bundle.current(spark, root, checked=False).count() < 40


def test_naive_bayes_against_brute_force(spark):
    teach = [("fee", "what is the fee"), ("fee", "fee of the course"), ("time", "when is the class"), ("time", "class time time"), (None, "unknown words"), ("empty", "")]
    asked = [(1, "the fee please"), (2, "class at what time"), (3, "nothing known"), (4, "")]
    grams = lambda t: (w := t.split()) + [f"{a} {b}" for a, b in zip(w, w[1:])]
    counts = {}
    for label, t in teach:
        if label:
            counts.setdefault(label, Counter()).update(grams(t))
    size = len({g for c in counts.values() for g in c})
    docs = Counter(label for label, _ in teach if label)

    def best(t):
        score = {c: math.log(docs[c] / sum(docs.values())) + sum(math.log((n[g] + 1) / (sum(n.values()) + size)) for g in grams(t)) for c, n in counts.items()}
        top = min(score, key=lambda c: (-round(score[c], 6), c))
        return top, round(1 / sum(math.exp(s - score[top]) for s in score.values()), 3)

    words = F.filter(F.split("text", " "), lambda w: w != "")
    rows = spark.createDataFrame(teach, "label string, text string").select("label", bayes.ngrams(words).alias("grams"))
    model, labels = bayes.train(rows)
    q = spark.createDataFrame(asked, "id int, text string").select("id", bayes.ngrams(words).alias("grams"))
    assert {r["id"]: (r["label"], round(r["confidence"], 3)) for r in bayes.predict(q, model, labels, "id").collect()} == {i: best(t) for i, t in asked}
    model, labels = bayes.train(rows.limit(0))
    assert [r["label"] for r in bayes.predict(q, model, labels, "id").collect()] == [None] * 4


def test_late_rows_of_a_stream(spark, tmp_path, sf):
    """Shuffled files, few at a time: windows and late rows as in one batch, wherever batches end."""
    arrival = F.expr("event_id + event_id * 37 % 400 * 3")
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", "value", "event_id").withColumn("arrival", arrival * 10_000 + F.col("event_id"))
    for k, (a, b) in enumerate([(0, 150), (150, 700), (700, 701), (701, 10**6)]):
        events.withColumn("k", F.expr("event_id + event_id * 37 % 400 * 3")).where(f"k >= {a} and k < {b}").drop("k").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
        spark.read.parquet(f"{tmp_path}/in/{k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/all")
    s = st.events(spark, f"{tmp_path}/all", spark.read.parquet(f"{tmp_path}/all").schema, files=1)
    q = st.with_late(s, "user_id", 3600, 1800).writeStream.format("memory").queryName("late").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    plain = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")) if c != "total" else F.coalesce("total", F.lit(0.0)) for c in df.columns)).collect())
    got, want = plain(spark.table("late")), plain(st.with_late_batch(events, "user_id", 3600, 1800))
    assert got == want and {r[1] for r in want} == {"window", "late"}


def test_timetable_documents(spark):
    good = '{"courses":[{"course_code":"CS-1","course_title":"Old"},{"course_code":"CS-1","course_title":"Logic","abbreviation":"LG (R)","program_semester":"BS Semester IV","instructors":["Ann","Bo"]}],"schedule_slots":[{"course_code":"CS-1","course_title":"Logic (S)","day":"Monday","room":"R1","time_slot":"8:00-9:00"},{"course_code":"XX-2","course_title":"Other (Rep)","day":"Friday"},{"course_code":"YY-3","time_slot":"TBA"}]}'
    df = spark.createDataFrame([(1, good), (2, good[:80]), (3, None), (4, '{"schedule_slots":[]}'), (5, "{}"), (6, "[1, 2]")], "doc int, raw string")
    got = sorted(map(tuple, tt.entries(df, "doc", "raw").collect()), key=str)
    assert [r for r in got if r[0] == 1] == [
        (1, False, "CS-1", "Monday", "8:00", "9:00", "R1", "Self-Support", "Ann", "Logic", 4, "LG"), (1, False, "XX-2", "Friday", "00:00", "00:00", None, "Rep", "TBA", "Other (Rep)", None, ""), (1, False, "YY-3", None, "TBA", "TBA", None, "Regular", "TBA", "YY-3", None, ""),
    ]
    assert {r[:2] for r in got if r[0] != 1} == {(2, True), (3, True), (6, True)}
    asked = spark.createDataFrame([(1, "when is CS-1 class"), (2, "semester four"), (3, "Friday"), (4, "time table for logic ann on monday"), (5, "logic on tuesday"), (6, None), (7, ""), (8, "semester 9")], "q int, text string")
    found = sorted(tuple(r)[:2] + (r["rule"],) for r in tt.search(tt.entries(df.where("doc = 1"), "doc", "raw"), tt.questions(asked, "q", "text"), "q").collect())
    assert found == [(1, "CS-1", 4), (2, "CS-1", 2), (3, "XX-2", 3)]


def test_tables_of_pages(spark):
    pages = ["<table><tr><th>a<th colspan=99>b|c</tr><tr><td>1<td>2</table>", "<table><tr><td></td></tr></table>", None, "", "<table><tr><td>x<script>no</script><p>y</p><td colspan='z'><a href='/u'>v <b>w</b></a>", "<nav><table><tr><td>no</td></tr></table></nav><table><tr><th>h</th></tr><tr><td>out<table><tr><td>in</td></tr></table></td></tr></table>", "<td>stray</td><tr>"]
    df = spark.createDataFrame(list(enumerate(pages)), "k int, h string")
    got = sorted(map(tuple, html.tables(df, "k", "h").collect()))
    wide = "  |" * 6
    assert got == [(0, 0, f"| a | b/c |  |{wide}\n|" + "---|" * 9 + f"\n| 1 | 2 |  |{wide}"), (4, 0, "x y | [v w](/u)"), (5, 0, "| h |\n|---|\n| out |"), (5, 1, "in")]
