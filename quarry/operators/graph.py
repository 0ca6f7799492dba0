"""Prerequisite-graph operators over an edge table (child, parent): child needs parent.

Walks run level by level; each level is written in the shared folder, so its
lineage stays short, and a walk ends where a level finds nothing new. No depth
is assumed, and a cycle ends a walk like anything already seen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import materialize, release
from . import walks


def edges(raw: DataFrame, canon: DataFrame | None = None) -> DataFrame:
    """Distinct edges with codes replaced by their canonical ones (code, canonical); loops are dropped."""
    e = raw.select("child", "parent")
    if canon is not None:
        for side in ("child", "parent"):
            c = canon.select(F.col("code").alias(side), F.col("canonical").alias("_c"))
            e = e.join(c, side, "left").withColumn(side, F.coalesce("_c", side)).drop("_c")
    return e.where("child <> parent").select("child", "parent").distinct()


#: Rows that a doubling may make for each pair known. Where it would make more, most paths meet and only their first counts.
CROWDED = 8


def closure(e: DataFrame, down: bool = False) -> DataFrame:
    """(start, node, depth): every node reachable from every start and its least depth; the start itself is left out.

    A crowded graph is walked in cells instead.
    """
    reach, half, crowded = _doubled(e, down)
    return _crowded(reach, half) if crowded else reach


def _doubled(e: DataFrame, down: bool = False) -> tuple[DataFrame, int, bool]:
    """(reach, half, crowded): the closure, or all of it up to ``half`` steps if it is crowded.

    Reach doubles in each round: the node half way on a shortest path of more
    than L steps is L steps from its start, so only pairs at exactly L are
    joined with what lies ahead of them.
    """
    source, target = ("parent", "child") if down else ("child", "parent")
    reach = materialize(e.select(F.col(source).alias("start"), F.col(target).alias("node"), F.lit(1).alias("depth")).where("start <> node").distinct(), "closure")
    half = 1
    while True:
        known, far = _sizes(reach, half)
        if not far or far > CROWDED * known:
            return reach, half, far > 0
        edge = reach.where(F.col("depth") == half)
        ahead = reach.select(F.col("start").alias("mid"), F.col("node").alias("end"), F.col("depth").alias("more"))
        far = edge.join(ahead, F.col("node") == F.col("mid")).select("start", F.col("end").alias("node"), (F.col("depth") + F.col("more")).alias("depth")).where("start <> node")
        longer = materialize(reach.union(far).groupBy("start", "node").agg(F.min("depth").alias("depth")), "closure")
        release(reach)
        reach, half = longer, 2 * half


def _sizes(reach: DataFrame, half: int) -> tuple[int, int]:
    """The number of pairs, and of rows that joining those at exactly ``half`` with what lies ahead would make."""
    ahead = reach.groupBy("start").agg(F.count(F.lit(1)).alias("ahead"))
    edge = reach.where(F.col("depth") == half).groupBy(F.col("node").alias("start")).agg(F.count(F.lit(1)).alias("behind"))
    known, far = ahead.join(edge, "start", "left").agg(F.sum("ahead"), F.sum(F.col("ahead").cast("double") * F.col("behind"))).first()
    return known or 0, int(far or 0)


def _crowded(reach: DataFrame, depth: int) -> DataFrame:
    """The closure that begins with ``reach``, which holds every pair of at most ``depth`` steps, walked from its edges."""
    hop = reach.where("depth = 1").select("start", "node")
    nodes = walks.numbered(hop)
    bits = walks.walk(hop, nodes).where("depth > 0").join(nodes.select("num", "node"), "num").select("block", "node", "depth", "bits")
    found = bits.mapInArrow(walks.pairs, f"num long, node {reach.schema['node'].dataType.simpleString()}, depth int")
    return found.join(nodes.select("num", F.col("node").alias("start")), "num").select("start", "node", "depth")


def shortest_paths(e: DataFrame, starts: DataFrame, directed: bool = True) -> DataFrame:
    """(start, node, path): one shortest path from each start to each node it reaches, least in order of its nodes."""
    hop = e.select(F.col("child").alias("from"), F.col("parent").alias("to"))
    hop = materialize((hop if directed else hop.union(e.select("parent", "child"))).distinct(), "hops")
    n = F.col(starts.columns[0])
    level = materialize(starts.select(n.alias("start"), n.alias("node"), F.array(n).alias("path")).distinct(), "paths")
    levels = [level]
    while True:
        step = level.join(hop, F.col("node") == F.col("from")).select("start", F.col("to").alias("node"), F.concat("path", F.array("to")).alias("path"))
        step = step.groupBy("start", "node").agg(F.min("path").alias("path"))  # the least path to a node goes on from the least one before it
        seen = reduce(DataFrame.union, (x.select("start", "node") for x in levels))
        level = materialize(step.join(seen, ["start", "node"], "left_anti"), "paths")
        if level.isEmpty():
            return reduce(DataFrame.union, levels).where(F.size("path") > 1)
        levels.append(level)


def rings(e: DataFrame) -> DataFrame:
    """(node, ring): the nodes on cycles, with the least node that each reaches and is reached from."""
    ahead = closure(e)
    back = ahead.select(F.col("node").alias("start"), F.col("start").alias("node"))
    return ahead.join(back, ["start", "node"], "left_semi").groupBy(F.col("start").alias("node")).agg(F.least(F.min("node"), F.col("start")).alias("ring"))


def cycles(e: DataFrame) -> DataFrame:
    """(path): each simple cycle once, from its least node. Only edges within one ring are walked, since no cycle leaves it."""
    ring = materialize(rings(e), "rings")
    side = lambda c: ring.select(F.col("node").alias(c), F.col("ring").alias(f"ring_{c}"))
    hop = e.select(F.col("child").alias("from"), F.col("parent").alias("to")).distinct().join(side("from"), "from").join(side("to"), "to")
    hop = materialize(hop.where("ring_from = ring_to").select("from", "to"), "hops")
    start = F.get("path", F.lit(0))
    walk = materialize(hop.where(F.col("to") >= F.col("from")).select(F.array("from", "to").alias("path")), "walks")
    closed = []
    while not walk.isEmpty():
        done = start == F.element_at("path", -1)
        closed.append(walk.where(done))
        open_ = walk.where(~done)
        step = open_.join(hop, F.element_at("path", -1) == F.col("from")).where((F.col("to") >= start) & ((F.col("to") == start) | ~F.array_contains("path", F.col("to"))))
        walk = materialize(step.select(F.concat("path", F.array("to")).alias("path")), "walks")
    return reduce(DataFrame.union, closed or [walk])


def levels(e: DataFrame) -> DataFrame:
    """(node, depth): the edges of the longest chain from each node to a root, 0 at the roots; null in a cycle and for what needs one.

    Nodes without an open prerequisite are peeled off level by level. An edge is
    read until its parent has a level, and a level's table once more at the end.
    """
    left = materialize(e.select("child", "parent").where("child <> parent").distinct(), "open")
    child = lambda df: df.select(F.col("child").alias("node")).distinct()
    ready = left.select(F.col("parent").alias("node")).distinct().join(child(left), "node", "left_anti")
    found = []
    while True:
        level = materialize(ready.withColumn("depth", F.lit(len(found))), "level")
        found.append(level)
        if level.isEmpty():
            return reduce(DataFrame.union, found).union(child(left).withColumn("depth", F.lit(None).cast("int")))
        gone = level.select(F.col("node").alias("parent"))
        rest = materialize(left.join(gone, "parent", "left_anti"), "open")
        ready = materialize(child(left.join(gone, "parent", "left_semi")).join(child(rest), "node", "left_anti"), "ready")
        release(left)
        left = rest


def root_paths(e: DataFrame) -> DataFrame:
    """(start, root, path): every path from each node that needs something to a root, the node first.

    Paths grow from the roots, so every path made is a result and is written
    once; a node is on a path once, so a cycle between a root and a node ends
    them. As many rows as there are paths, which is what is asked for.
    """
    hop = materialize(e.select("child", "parent").where("child <> parent").distinct(), "hops")
    roots = hop.select(F.col("parent").alias("start")).distinct().join(hop.select(F.col("child").alias("start")), "start", "left_anti")
    level = materialize(roots.select("start", F.col("start").alias("root"), F.array("start").alias("path")), "paths")
    found = []
    while not level.isEmpty():
        found.append(level)
        step = level.join(hop, F.col("start") == F.col("parent")).where(~F.array_contains("path", F.col("child")))
        level = materialize(step.select(F.col("child").alias("start"), "root", F.concat(F.array("child"), "path").alias("path")), "paths")
    return reduce(DataFrame.union, found[1:] or [level])


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node reachable either way, for every node of ``edges(a, b)``.

    Alternating star contractions: each round hangs the larger neighbours of a
    node, then the smaller ones, on its least neighbour. Edges become stars in a
    logarithmic number of rounds, and rounds go on until one changes nothing; no
    group is collected, only its minimum.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        before, e = e, materialize(small, "stars")
        release(before)
        now = tuple(e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def documents(e: DataFrame, names: DataFrame, most: int = 200) -> DataFrame:
    """(concept, kind, block, text) for search, of every concept that needs something: what it ``needs``, the whole
    ``sequence`` of what leads to it, earliest first, and what it ``unlocks``; ``most`` names a row, so no row grows with the graph.

    ``names(concept, name)`` has a row for each node of ``e``.
    """
    names = materialize(names, "names")
    at = F.lit(0).alias("depth")
    needs = e.select(F.col("child").alias("concept"), F.col("parent").alias("other"), at)
    hop = e.select(F.col("child").alias("start"), F.col("parent").alias("node")).where("start <> node").distinct()
    nodes = walks.numbered(hop)
    sequence = walks.listed(_sequence(e, hop, nodes), nodes, names, " > ", most)
    unlocks = e.select(F.col("parent").alias("concept"), F.col("child").alias("other"), at).join(needs.select("concept"), "concept", "left_semi")
    place = F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("depth"), "other"))

    def told(rows: DataFrame, kind: str, glue: str) -> DataFrame:
        placed = rows.select("concept", "other", (place - 1).alias("place")).join(names.select(F.col("concept").alias("other"), "name"), "other")
        listed = placed.groupBy("concept", F.expr(f"place div {most}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("told"))
        body = F.array_join(F.col("told.name"), glue)
        return listed.join(names, "concept").select("concept", F.lit(kind).alias("kind"), "block", F.concat("name", F.lit(f" {kind}: "), body).alias("text"))

    ahead = sequence.select("concept", F.lit("sequence").alias("kind"), "block", F.concat("name", F.lit(" sequence: "), "text").alias("text"))
    return told(needs, "needs", "; ").union(ahead).union(told(unlocks, "unlocks", "; "))


def _sequence(e: DataFrame, hop: DataFrame, nodes: DataFrame) -> DataFrame:
    """The closure of ``e`` as ``walks.walk`` tells it. What one chunk holds is walked at once, and so is what is crowded."""
    if nodes.count() > walks.CHUNK:
        reach, _, crowded = _doubled(e)
        if not crowded:
            return walks.bits(reach, nodes)
        release(reach)
    return walks.walk(hop, nodes)


def missing(e: DataFrame, wanted: DataFrame, done: DataFrame) -> DataFrame:
    """(who, node, needs, missing): what each wanted node still needs, by ``done(who, node)``."""
    needs = wanted.join(e.select(F.col("child").alias("node"), F.col("parent").alias("need")), "node", "left")
    have = done.select("who", F.col("node").alias("need")).distinct().withColumn("_have", F.lit(True))
    out = needs.join(have, ["who", "need"], "left")
    return out.groupBy("who", "node").agg(F.count("need").alias("needs"), F.sort_array(F.collect_list(F.when(F.col("_have").isNull(), F.col("need")))).alias("missing"))
