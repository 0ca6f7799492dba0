"""Graph walks, neighbour search, chunking and entities against plain Python."""

import difflib

import numpy as np
import pytest

from quarry import store
from quarry.functions import chunks, entities
from quarry.functions import text as tx
from quarry.operators import graph
from quarry.operators import search as op
from quarry.sources import html
from pyspark.sql import functions as F


def chain(spark, n):
    return spark.createDataFrame([(k + 1, k) for k in range(n)], "child long, parent long")


def test_walks_know_no_depth(spark):
    e = chain(spark, 70)
    assert graph.closure(e).count() == 70 * 71 // 2
    assert graph.closure(e, down=True).where("start = 0").agg(F.max("depth")).first()[0] == 70
    path = graph.shortest_paths(e, spark.createDataFrame([(40,)], "n long")).where("node = 0").first()["path"]
    assert path == list(range(40, -1, -1))


def test_levels_and_paths_where_nodes_have_several_parents(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 3), (1, 2)], "child long, parent long")
    assert {tuple(r) for r in graph.levels(e).collect()} == {(3, 0), (2, 1), (1, 2)}
    assert sorted(tuple(r["path"]) for r in graph.root_paths(e).collect()) == [(1, 2, 3), (1, 3), (2, 3)]
    assert graph.levels(e.limit(0)).count() == 0 and graph.root_paths(e.limit(0)).count() == 0


def test_levels_and_paths_against_brute_force(spark):
    rng = np.random.default_rng(9)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 40, (55, 2)) if a > b} | {(50, 51), (51, 50), (52, 50), (53, 52), (50, 3)}
    parents = {}
    for a, b in pairs:
        parents.setdefault(a, []).append(b)

    def paths(node, before=()):
        here = (*before, node)
        if node not in parents:
            return [here]
        return [p for b in parents[node] if b not in here for p in paths(b, here)]

    stuck = {50, 51, 52, 53}
    want = {n: None if n in stuck else max(map(len, paths(n))) - 1 for n in {x for p in pairs for x in p}}
    e = spark.createDataFrame(sorted(pairs), "child long, parent long")
    assert dict(map(tuple, graph.levels(e).collect())) == want
    assert sorted(tuple(r["path"]) for r in graph.root_paths(e).collect()) == sorted(p for n in parents for p in paths(n))
    assert {tuple(r) for r in graph.rings(e).collect()} == {(50, 50), (51, 50)}


def test_components_and_documents(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 200), (7, 7)], "a long, b long")
    comp = dict(map(tuple, graph.components(links).collect()))
    assert {comp[k] for k in range(1, 61)} == {1} and comp[200] == 100
    e = spark.createDataFrame([(k, 0) for k in range(1, 8)] + [(0, 9)], "child long, parent long")
    names = spark.createDataFrame([(k, f"n{k}") for k in range(10)], "concept long, name string")
    got = sorted(tuple(r) for r in graph.documents(e, names, most=3).collect())
    assert [t for *_, t in got if t.startswith("n0")] == ["n0 needs: n9", "n0 sequence: n9", "n0 unlocks: n1; n2; n3", "n0 unlocks: n4; n5; n6", "n0 unlocks: n7"]
    assert (5, "sequence", 0, "n5 sequence: n9 > n0") in got


def test_walks_on_a_dense_graph_with_cycles(spark):
    rng = np.random.default_rng(0)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 14, (45, 2)) if a != b}
    e = spark.createDataFrame(sorted(pairs), "child long, parent long")
    want = {}
    for s in {a for a, _ in pairs}:
        level, seen, depth = {s}, {s}, 0
        while level:
            depth += 1
            level = {b for a, b in pairs if a in level} - seen
            seen |= level
            want |= {(s, x): depth for x in level}
    assert {(r[0], r[1]): r[2] for r in graph.closure(e).collect()} == want
    some = graph.shortest_paths(e, spark.createDataFrame([(3,)], "n long")).collect()
    assert {(r[0], r[1]): len(r[2]) - 1 for r in some} == {k: v for k, v in want.items() if k[0] == 3}


def test_long_cycle(spark):
    e = spark.createDataFrame([(k, (k + 1) % 20) for k in range(20)] + [(3, 50), (51, 4)], "child long, parent long")
    assert [r["path"] for r in graph.cycles(e).collect()] == [[*range(20), 0]]
    assert graph.cycles(chain(spark, 5)).count() == 0


def test_neighbours_in_cells(spark, monkeypatch):
    monkeypatch.setattr(op, "ROWS", 7)
    rng = np.random.default_rng(2)
    m = rng.normal(size=(40, 5))
    m[7] = m[3]
    m[11] = 0
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "i long, v array<double>")
    q = df.where("i % 4 = 0").selectExpr("i as q", "v as w")
    got = {}
    for r in op.rank(op.knn(df, q, "i", "v", "q", "w", 3), "q", "i", 3).collect():
        got.setdefault(r["q"], []).append(r["i"])
    size = np.linalg.norm(m, axis=1)
    unit = m / np.where(size, size, 1)[:, None]
    for k in range(0, 40, 4):
        cos = unit @ unit[k]
        order = sorted((i for i in range(40) if i != k), key=lambda i: (-round(cos[i], 6), i))
        assert got[k] == order[:3]


def made(spark, column, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r[1] for r in sorted(df.select("k", column(F.col("t"))).collect())]


def test_passages(spark):
    text = "First sentence here. Second one follows now.\n" * 60
    got, none, blank, solid, long = made(spark, lambda t: chunks.passages(t, 200, 40), text, None, "  ", "x" * 500, "ab cd. " * 30_000)
    assert all(len(x) <= 200 for x in got) and all(x in text for x in got) and got[0].endswith(".") and len(got) > 10
    at = 0
    for x in got:  # each begins before the one before it ends
        found = text.find(x)
        assert found <= at + 1
        at = max(at, found + len(x))
    assert none == blank == [] and [len(x) for x in solid] == [200, 200, 100] and len(long) > 1000


def plain_blocks(text):
    path, held, out = {}, [], []

    def close():
        if body := "\n".join(held).strip():
            out.append((" › ".join(path[k] for k in sorted(path)), body))
        held.clear()

    for line in (text or "").split("\n"):
        marks = len(line.lstrip(" \t")) - len(line.lstrip(" \t").lstrip("#"))
        if 0 < marks < 7 and line.lstrip(" \t")[marks:][:1] in (" ", "\t"):
            close()
            path = {k: v for k, v in path.items() if k < marks} | {marks: line.lstrip(" \t")[marks:].strip()}
        else:
            held.append(line)
    close()
    return out


def test_blocks_and_chunks_of_all_pages(spark, sf):
    pages = html.page_text(spark.read.parquet(f"{sf}/pages.parquet")).select("text", chunks.blocks(F.col("text")).alias("b"))
    for text, found, packed in pages.select("text", "b", chunks.pack(F.col("b")).alias("c")).collect():
        assert [tuple(b) for b in found] == plain_blocks(text)
        words = [w for b in found if "|" not in b["text"] for w in b["text"].split()]
        held = [w for c in packed for w in c["text"].split()]
        assert set(words) <= set(held)
        if not any("|" in b["text"] for b in found):
            assert held == words and all(len(c["text"]) <= chunks.MOST for c in packed)
            for a, b in zip(packed, packed[1:]):  # nothing small is left alone beside room for it
                assert len(b["text"]) >= chunks.LEAST or len(a["text"]) + 2 + len(b["text"]) > chunks.MOST


def test_blocks_and_packing(spark):
    rows = "".join(f"| {k} | {'v' * 60} |\n" for k in range(80))
    page = "intro\n# A\nalpha\n## B\nbeta\n# C\n" + "| h | k |\n|---|---|\n" + rows
    assert [b["heading"] for b in made(spark, chunks.blocks, page)[0]] == ["", "A", "A › B", "C"]
    both = lambda t: chunks.pack(chunks.blocks(t))
    packed, none, prose, long, solid, mixed = made(spark, both, page, None, "# X\n## Y\n" + "word " * 150 + "\n\n" + "more " * 150 + "\n# Z\ntail", "A sentence of some words. " * 400, "x" * 4000, "before\n| a | b |\nafter")
    tables = [c for c in packed if c["heading"].startswith("C")]
    assert [c["heading"] for c in tables] == ["C", "C (part 2)", "C (part 3)"]
    assert tables[0]["text"].startswith("| h | k |\n|---|---|\n| 0") and all(c["text"].startswith("| h | k | (continued)\n| h | k |\n|---|---|\n| ") for c in tables[1:])
    assert all(len(c["text"]) <= chunks.ATOMIC for c in tables) and sum(c["text"].count("v" * 60) for c in tables) == 80
    assert none == [] and [c["heading"] for c in prose] == ["X › Y", "X › Y"] and prose[1]["text"].endswith("tail")
    assert all(len(c["text"]) <= chunks.MOST for c in long) and [len(c["text"]) for c in solid] == [1500, 1500, 1000]
    assert [c["text"] for c in mixed] == ["before", "| a | b |", "after"]


def test_index_text(spark):
    got = made(spark, lambda t: chunks.index_text(F.lit("Site"), F.lit("Fees"), t), "CS-211 and PHY 301A", "nothing")
    assert got == ["Site › Fees\nCS-211 and PHY 301A\nCourse code forms: CS-211 CS211 CSC-211 CSC211 PHY-301A PHY301A", "Site › Fees\nnothing"]


def brute_tokens(text):
    import re

    def stem(w):
        if len(w) <= 4 or any(c.isdigit() for c in w) or w.endswith("ss"):
            return w
        return next((w[: len(w) - len(e)] + r for e, r in tx.ENDINGS if w.endswith(e) and len(w) >= len(e) + 3), w)

    name = lambda a, b: ("csc" if a.lower() == "cs" else a.lower()) + "-" + b.lower()
    out = []
    for run in re.findall(r"[a-z0-9]+(?:-[a-z0-9]+)*", text.lower()):
        parts = run.split("-")
        if len(parts) > 1:
            out.append(name(parts[0], parts[1]) if parts[1][0].isdigit() else run)
        out += [stem(p) for p in parts if p not in tx.STOP_WORDS]
    return out + [name(a, b) for a, b in re.findall(r"\b([A-Za-z]{2,5})[-\s_]?([0-9]{3}[A-Za-z]?|[0-9][xX]{2}|[0-9]{2}[xX])\b", text)]


def test_tokens(spark):
    texts = ["The CS-211 and csc211a classes; studies, misses, running well-known MATH_210", "éCS-300 é-CS-300–x cs 3xx", "", "a-1-b-2 C-12 AB-123-4"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(tx.tokens(F.col("t"))).collect()] == [brute_tokens(t) for t in texts]
    assert df.select(tx.language(F.lit("یہ کیا ہے")), tx.language(F.lit("mujhe kya karna hai")), tx.language(F.lit("plain words"))).first()[:] == ("ur", "roman-ur", "en")


def test_numbers(spark):
    df = spark.createDataFrame([("eighteen weeks, 1,200.5 and ۱۸; five hundred, twenty one, ninety ten",)], "t string")
    assert set(df.select(entities.numbers(F.col("t"))).first()[0]) == {"18", "1200.5", "500", "5", "21", "1", "90", "10"} - {"5"} | {"500"}


def test_nearest_name_and_diff(spark):
    asked = spark.createDataFrame([(1, "data structurs"), (2, "nothing alike")], "q int, text string")
    names = spark.createDataFrame([(7, "Data Structures"), (8, "Data Mining")], "i int, name string")
    assert [tuple(r)[:2] for r in entities.nearest_name(asked, names, "q", "i").collect()] == [(1, 7)]
    df = spark.createDataFrame([(1, "a\nb\nc", "a\nc\nd"), (2, None, "x")], "k int, o string, n string")
    got = {r["k"]: r["diff"] for r in entities.text_diff(df, ["k"], "o", "n").collect()}
    assert got[1] == list(difflib.unified_diff(["a", "b", "c"], ["a", "c", "d"], "old", "new", lineterm="")) and got[2][-1] == "+x"


def test_open_elements(spark):
    assert html.to_text("<div><form>hidden</div><p>shown</p>") == "shown"
    assert html.to_text("<form>a</nav>b</form><p>c") == "c"
    assert html.to_text("<h1>T</h1><ul><li>x</ul>", marks=False) == "T\nx"


def test_shared_folder_is_not_local_on_a_cluster(spark, monkeypatch):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        store.shared_dir(Cluster())
    t = store.materialize(spark.range(3), "gone")
    store.release(t)
    with pytest.raises(Exception):
        t.collect()


def test_reflow(spark):
    wrapped = "The rules of the depart-\nment are\nprinted here.\nThey hold.\n\n\n1. First\n(a) a clause that\ngoes on\nTABLE OF FEES\nAdmission 5000\nTuition 100\n"
    want = "The rules of the department are printed here.\nThey hold.\n\n1. First\n(a) a clause that goes on\nTABLE OF FEES\nAdmission 5000\nTuition 100\n"
    assert made(spark, chunks.reflow, wrapped) == [want]
    assert made(spark, chunks.reflow, None, "", "\n \na") == [None, "", "a"]
    assert made(spark, chunks.reflow, "x\n" * 50_000)[0].count("x x") == 25_000


def test_sentences(spark):
    text = "Dr. Ali met Prof. Khan.  J. Smith left, e.g. early! Really? Yes."
    assert spark.range(1).select(tx.sentences(F.lit(text)).alias("s")).first()["s"] == ["Dr. Ali met Prof. Khan.", "J. Smith left, e.g. early!", "Really?", "Yes."]


def test_people_and_partial_names(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["anna", "ben", "carl", "dora", "emil", "fritz", "gerd", "hans", "ida", "jens"]
    names = [(k, " ".join(rng.choice(vocabulary, rng.integers(1, 5)))) for k in range(30)] + [(30, "unique name"), (31, None), (31, None)]
    asked = [(k, "Dr. " + " ".join(rng.choice([*vocabulary, "zeno", "unique"], rng.integers(1, 6)))) for k in range(60)] + [(60, None), (61, "")]
    n, q = spark.createDataFrame(names, "item long, name string"), spark.createDataFrame(asked, "query long, text string")
    held = {k: set((x or "").split()) for k, x in names}
    owners = {w: sum(w in h for h in held.values()) for h in held.values() for w in h}
    people, partial = set(), set()
    for k, t in asked:
        said = set((t or "").lower().replace(".", "").split()) - {"dr"}
        met = {i: said & h for i, h in held.items()}
        scored = sorted((-len(m) - sum(owners[w] == 1 for w in m), i) for i, m in met.items() if len(m) >= 3 or any(owners[w] == 1 for w in m))
        people |= {(k, i, -s) for s, i in scored[:3]}
        content = {w for w in said if len(w) >= 4}
        fits = [i for i, h in held.items() if content <= {w for w in h if len(w) >= 4}] if len(content) >= 2 else []
        partial |= {(k, i) for i in fits} if len(fits) <= 2 else set()
    assert people and partial
    assert {tuple(r) for r in entities.people(q, n, "query", "item").collect()} == people
    assert {tuple(r) for r in entities.partial_names(q, n, "query", "item", []).collect()} == partial


def test_equal_names_are_compared_once(spark):
    import time

    began = time.time()
    asked = spark.range(4000).select(F.col("id").alias("q"), F.concat(F.lit("Old grey Gea"), F.when(F.col("id") % 2 == 0, "r").otherwise("")).alias("text"))
    names = spark.range(20000).select((F.col("id") + 5).alias("i"), F.when(F.col("id") % 4 == 0, "OLD GREY GEAR").when(F.col("id") % 4 == 1, "grey").otherwise("old grey sea").alias("name"))
    got = entities.nearest_name(asked, names, "q", "i")
    assert sorted(map(tuple, got.groupBy("i", "ratio").count().collect())) == [(5, 0.96, 2000), (5, 1.0, 2000)]
    assert time.time() - began < 60  # 80 million pairs, one by one, take minutes


def test_names_alike_are_met_as_one(spark):
    names = spark.range(6000).select(F.col("id").alias("i"), F.when(F.col("id") < 5000, F.concat(F.lit("small red gear "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit("xyz"))).otherwise("small red gear").alias("name"))
    asked = spark.range(900).select(F.col("id").alias("q"), F.concat(F.lit("a small old RED gear "), F.when(F.col("id") % 3 == 0, F.concat(F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit("xyz"))).otherwise("")).alias("text"))
    _, said, classes = entities._meet(asked, names, "q", "i", 3, [], 3)
    assert classes.count() == 1 and entities._alike(said, classes, 3).count() == 1  # not a row for each text and name
    got = entities.people(asked, names, "q", "i")
    want = {(q, i, 5 if i == q and q % 3 == 0 else 3) for q in range(900) for i in (([q] if q % 3 == 0 else []) + [x for x in range(4) if x != q or q % 3])[:3]}
    assert {tuple(r) for r in got.collect()} == want
    few = spark.createDataFrame([(1, "small gear"), (2, "grey wolf"), (3, "grey wolf cubs")], "q long, text string")
    wolves = names.where("i < 9").union(spark.createDataFrame([(8001, "grey wolf"), (8002, "wolf grey")], "i long, name string"))
    assert {tuple(r) for r in entities.partial_names(few, wolves, "q", "i", []).collect()} == {(2, 8001), (2, 8002)}
