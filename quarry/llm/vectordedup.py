"""Near-duplicate vectors by random-hyperplane sign hashing.

Each table hashes a vector to the signs of its products with some random
planes. Vectors at an angle a agree on a sign with chance 1 - a / pi, so the
number of signs follows from the number of vectors (few strangers share a
bucket) and the number of tables from the chance ``miss`` that a pair right at
the threshold shares no bucket. Candidates are verified by exact cosines, and
links make components by star contraction.

Groups of copies stay linear as far as they can:
    equal vectors are one class, found and counted by aggregation;
    a bucket of two classes is a pair at once; a larger one compares its members with its least one;
    members that are then in that one's component are compared no further, only strays are, with what is in other components.
Links are counted within components, where every link lies, so links that
share no bucket count too if other links join their ends. Two classes whose
angles to their component's mean direction add up to no more than the
threshold's angle are linked without being compared: a histogram of those
angles counts such links. Only the remaining classes, which lie far out, are
compared, in cells of CELL by CELL; a cell sends a count for each of its rows
and no pair.

Defined results
    null, empty or zero vectors and such with null or non-finite components: no links, a component of their own.
    vectors of different sizes: not linked. -0.0 equals 0.0.
    repeated rows: a row each, each a vector, so they link with one another.
    rows of one id with different vectors: a row each; the component is named by the least id in it.
    null ids: no links, component null, kept. Empty tables give no rows. Extra columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, materialize, release, small_batches
from .graph import components

#: Chance that a pair right at the threshold shares no bucket.
MISS = 1e-3
#: Signs beyond log2 of the number of vectors: a stranger shares a bucket with chance 2 ** -EXTRA.
EXTRA = 5
#: Classes in a side of a cell, and rows that a task takes together.
CELL, ROWS = 512, 4096
#: Steps of the histogram of angles, from 0 to the threshold's.
STEPS = 512


def hashing(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(tables, signs a table) for ``n`` vectors."""
    signs = min(62, max(1, int(n)).bit_length() + EXTRA)
    agree = 1 - math.acos(threshold) / math.pi
    return math.ceil(math.log(miss) / math.log1p(-(agree**signs))), signs


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _classes(vectors: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(id, node) of each row, node null for what links with nothing; and the classes (node, id, n, u), u of length 1."""
    v = F.col("v")
    whole = F.col("id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    plain = vectors.select(F.col(vec_id).alias("id"), F.transform(F.col(vector), lambda x: x.cast("double") + 0.0).alias("v")).withColumn("whole", F.coalesce(whole, F.lit(False)))
    seed = 0
    while True:
        named = plain.select("id", "v", F.when(F.col("whole"), F.xxhash64(F.lit(seed), "v")).alias("node"))
        check = F.xxhash64(F.lit(seed + 1), "v")
        found = named.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"), F.min(check).alias("a"), F.max(check).alias("b"))
        # a power of two keeps squares finite and changes no quotient
        scaled = F.transform("v", lambda x: x / F.pow(F.lit(2.0), F.floor(F.log2(F.array_max(F.transform("v", F.abs))))))
        length = found.select("node", "id", "n", scaled.alias("v"), (F.col("a") == F.col("b")).alias("own"))
        classes = materialize(length.withColumn("l", F.sqrt(dot("v", "v"))), "vector-classes")
        if classes.where(~F.col("own")).isEmpty():
            return named.select("id", "node"), classes
        release(classes)  # two vectors of one hash: take another
        seed += 2


def _buckets(classes: DataFrame, tables: int, signs: int, only: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """(bucket, node) of every class in every table; ``only`` is a bitmap of the buckets that matter."""
    shared = classes.sparkSession.sparkContext.broadcast(only) if only else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        place, salt = np.uint64(1) << np.arange(signs, dtype=np.uint64), np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in small_batches(batches, max(1, 200_000 // tables)):
            nodes, lists = batch.column(0).to_numpy(), batch.column(1)
            sizes = np.array(lists.value_lengths())
            values = lists.flatten().to_numpy()
            ends = np.cumsum(sizes)
            for size in np.unique(sizes).tolist():
                if size not in planes:
                    planes[size] = np.random.default_rng([size, 97]).standard_normal((size, tables * signs))
                rows = np.flatnonzero(sizes == size)
                v = values[(ends[rows] - size)[:, None] + np.arange(size)]
                bits = ((v @ planes[size]) > 0).reshape(len(rows), tables, signs)
                mixed = (bits * place).sum(2, dtype=np.uint64) + salt + np.uint64(size)
                for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
                    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(factor)
                bucket, node = (mixed ^ (mixed >> np.uint64(32))).astype(np.int64).ravel(), np.repeat(nodes[rows], tables)
                if shared:
                    held, n = shared.value
                    at = bucket % n
                    keep = held[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
                    bucket, node = bucket[keep], node[keep]
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(node)], names=["bucket", "node"])

    return classes.select("node", "v").mapInArrow(run, "bucket long, node long")


def _linked(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose cosine reaches the threshold."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("v").alias(f"v{c}"), F.col("l").alias(f"l{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(F.size("va") == F.size("vb"))
    return met.where(dot("va", "vb") / (F.col("la") * F.col("lb")) >= threshold).select("a", "b")


def _links(classes: DataFrame, threshold: float, miss: float) -> DataFrame:
    """(node, comp) of every class with a link to another class."""
    tables, signs = hashing(classes.count(), threshold, miss)
    found = _buckets(classes, tables, signs).groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("n"))
    met = materialize(found.where("n > 1"), "vector-buckets")
    large = met.where("n > 2").select("bucket", F.col("a").alias("hub"))
    only = bitmap(large, "bucket")
    members = materialize(_buckets(classes, tables, signs, only).join(large, "bucket").where("node <> hub"), "vector-members")
    pairs = met.where("n = 2").select("a", "b").union(members.select(F.col("hub").alias("a"), F.col("node").alias("b"))).distinct()
    links = materialize(_linked(pairs, classes, threshold), "vector-links")
    comps = materialize(components(links), "vector-components")
    of = lambda node, out: comps.select(F.col("node").alias(node), F.col("comp").alias(out))
    placed = members.join(of("node", "comp"), "node", "left").join(of("hub", "hub_comp"), "hub", "left")
    placed = placed.select("bucket", "node", F.coalesce("comp", "node").alias("comp"), (F.coalesce("comp", "node") != F.coalesce("hub_comp", "hub")).alias("stray"))
    placed = materialize(placed, "vector-strays")
    stray = placed.where("stray").select("bucket", F.col("node").alias("a"), F.col("comp").alias("comp_a"))
    other = placed.select("bucket", F.col("node").alias("b"), F.col("comp").alias("comp_b"), F.col("stray").alias("both"))
    cross = stray.join(other, "bucket").where((F.col("comp_a") != F.col("comp_b")) & (~F.col("both") | (F.col("a") < F.col("b")))).select("a", "b").distinct()
    more = materialize(_linked(cross, classes, threshold), "vector-links")
    if not more.isEmpty():
        joined = materialize(components(links.union(more)), "vector-components")
        release(comps)
        comps = joined
    release(met, members, links, placed, more)
    return comps


def _angles(family: DataFrame, threshold: float) -> DataFrame:
    """``family`` with ``step``: the angle to its component's mean direction, in steps rounded up, STEPS + 1 beyond the threshold's."""
    total = family.select("comp", F.posexplode("u").alias("at", "x")).groupBy("comp", "at").agg(F.sum("x").alias("x"))
    mean = total.groupBy("comp").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("mean"))  # as many as a vector has
    mean = materialize(mean.select("comp", "mean", F.sqrt(dot("mean", "mean")).alias("size")), "vector-means")
    cos = F.when(F.col("size") > 0, dot("u", "mean") / F.col("size")).otherwise(F.lit(-1.0))
    step = F.floor(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))) / math.acos(threshold) * STEPS + 1e-3) + 1
    return family.join(mean, "comp").withColumn("step", F.least(step, F.lit(STEPS + 1)).cast("int")).drop("mean", "size")


def _count(family: DataFrame, threshold: float) -> DataFrame:
    """(node, links): how many vectors of other classes each class of ``family(comp, node, n, u)`` is linked with."""
    placed = materialize(_angles(family, threshold), "vector-angles")
    at = placed.groupBy("comp", "step").agg(F.sum("n").alias("n"))
    held = at.groupBy("comp").agg(F.collect_list(F.struct("step", "n")).alias("held"), F.max("step").alias("far"))  # STEPS + 1 entries at most
    known = placed.join(materialize(held, "vector-steps"), "comp")
    # steps are rounded up, so where they add up to STEPS at most the angles surely fit
    near = F.aggregate("held", F.lit(0).cast("long"), lambda n, s: n + F.when(s["step"] + F.col("step") <= STEPS, s["n"]).otherwise(0))
    sure = known.select("node", (near - F.when(2 * F.col("step") <= STEPS, F.col("n")).otherwise(0)).alias("links"))
    outer, shell = 2 * F.col("step") > STEPS, (F.col("step") + F.col("far") > STEPS) & (2 * F.col("far") > STEPS)
    left = materialize(known.where(shell).select("comp", "node", "n", "u", "step", outer.alias("outer")), "vector-shells")
    sizes = left.groupBy("comp").agg(F.ceil(F.count_if("outer") / CELL).alias("rows"), F.ceil(F.count(F.lit(1)) / CELL).alias("columns"))
    total = left.count()
    spread = left.join(sizes, "comp").withColumn("own", F.xxhash64("node"))
    upright = spread.where("outer").select("*", F.pmod("own", "rows").alias("i"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"), F.lit(True).alias("asks"))
    across = spread.select("*", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.pmod("own", "columns").alias("j"), F.lit(False).alias("asks"))
    cells = upright.unionByName(across).select(F.xxhash64("comp", "i", "j").alias("cell"), "node", "n", "u", "step", "outer", "asks")
    groups = max(1, -(-2 * total // ROWS))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for _, cell in rows.groupby("cell", sort=False):
            ask, told = cell[cell["asks"]], cell[~cell["asks"]]
            if not len(ask) or not len(told):
                continue
            a, b = np.stack(ask["u"].to_numpy()), np.stack(told["u"].to_numpy())
            na, nb = ask["n"].to_numpy(), told["n"].to_numpy()
            open_ = ask["step"].to_numpy()[:, None] + told["step"].to_numpy() > STEPS
            hit = (a @ b.T >= threshold) & open_ & (ask["node"].to_numpy()[:, None] != told["node"].to_numpy())
            inner = ~told["outer"].to_numpy()
            out.append((ask["node"].to_numpy(), hit @ nb))
            out.append((told["node"].to_numpy()[inner], na @ hit[:, inner]))
        if not out:
            return pd.DataFrame({"node": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})
        made = pd.DataFrame({"node": np.concatenate([x for x, _ in out]), "links": np.concatenate([y for _, y in out]).astype(np.int64)})
        return made[made["links"] > 0]

    compared = cells.groupBy(F.pmod("cell", F.lit(groups)).alias("g")).applyInPandas(compare, "node long, links long")
    return sure.union(compared).groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding", miss: float = MISS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; links are pairs of rows with a cosine of ``threshold`` (over 0, under 1) or more."""
    rows, classes = _classes(vectors, vec_id, vector)
    comps = _links(classes, threshold, miss)
    family = materialize(comps.join(classes, "node").select("comp", "node", "id", "n", F.transform("v", lambda x: x / F.col("l")).alias("u")), "vector-families")
    links = _count(family.drop("id"), threshold)
    least = family.groupBy("comp").agg(F.min("id").alias("component_id"))
    several = classes.where("n > 1").select("node", "id", "n").unionByName(family.where("n = 1").select("node", "id", "n"))
    found = several.join(comps.join(least, "comp").select("node", "component_id"), "node", "left").join(links, "node", "left")
    found = materialize(found.select("node", F.coalesce("component_id", "id").alias("component_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "vector-found")
    release(family, comps, classes)
    # a class of many rows is one row of ``found``; without links to tell of, a row is not in it
    out = rows.join(found, "node", "left").select(F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(vec_id).eqNullSafe(F.col("component_id")))
