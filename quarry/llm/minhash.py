"""Near-duplicate documents by min-max hashing.

A document's set is its distinct word shingles. Each permutation of the
shingles gives two signature values, its least and its greatest image, so a
signature of 2P values costs P evaluations a shingle. Bands of the signature
name candidate buckets; every link is confirmed on the full sets.

Work is kept linear where groups are large: documents of equal sets are one
class; each bucket first compares its members with its least one only; and
members that are then in one component are never compared again. What is left
(pairs that met one such member, are in different components, and that neither
the sizes nor the distances to that member rule out) is compared in full, so
no candidate pair is lost.

Defined results
    null, empty or wordless text: size 0, linked with nothing, kept.
    fewer words than a shingle: the whole sequence is the one shingle.
    null doc_id: linked with nothing, component null, kept.
    repeated rows: a row each, all with their document's component; where one
    doc_id has several texts, the links of all of them are its own.
    ties: the component is named by its least doc_id. Extra columns aren't read.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, list_column, materialize, release, small_batches, utf8
from .graph import components

#: Chance that a pair right at the threshold shares no band.
MISS = 1e-6
#: Members of a family in a chunk; two chunks are compared in a cell of their own.
CELL = 256
MEMO = 100_000


def banding(threshold: float, rows: int | None = None) -> tuple[int, int]:
    """(bands, rows a band) for which a pair at the threshold is missed with chance MISS at most."""
    rows = rows or (6 if threshold >= 0.75 else 4)
    bands = math.ceil(math.log(MISS) / math.log1p(-(threshold**rows)))
    return bands + bands * rows % 2, rows


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, k: int):
        self.k, self.memo = k, {}
        rng = np.random.default_rng(20240229)
        self.factors = rng.integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray:
        words = utf8(text).lower().split()  # ASCII case and white space only
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < self.k:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 7)], np.uint64)
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words):
            if w not in memo:
                memo[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        n = len(h) - self.k + 1
        s = np.zeros(n, np.uint64)
        for j in range(self.k):
            s += h[j : j + n] * self.factors[j]
        s ^= s >> np.uint64(29)
        s *= np.uint64(0xBF58476D1CE4E5B9)
        s ^= s >> np.uint64(32)
        return np.unique(s)


class MinMax:
    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        rng = np.random.default_rng(7)
        n = bands * rows // 2
        self.a = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, n, dtype=np.uint64)
        self.mix = rng.integers(1, 2**63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(0, 2**63, bands, dtype=np.uint64)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        """The bands' hashes as int64."""
        low, high = np.full(len(self.a), 2**64 - 1, np.uint64), np.zeros(len(self.a), np.uint64)
        for k in range(0, len(shingles), 2048):
            x = shingles[k : k + 2048, None] * self.a[None, :] + self.b[None, :]
            np.minimum(low, x.min(0), out=low)
            np.maximum(high, x.max(0), out=high)
        values = np.stack([low, high], 1).reshape(self.bands, self.rows)
        h = ((values ^ (values >> np.uint64(31))) * self.mix).sum(1, dtype=np.uint64) + self.salt
        h ^= h >> np.uint64(30)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        return h.view(np.int64)


def _halves(shingles: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def signatures(docs: DataFrame, k: int, bands: int, rows: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, s1, s2, bands): set size, 128-bit hash of the set, band hashes (none for an empty set)."""
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, minmax = Shingler(k), MinMax(bands, rows)
        for batch in small_batches(batches):
            n, s1, s2, found = [], [], [], []
            for t in batch.column(1):
                s = shingler(t.as_py())
                n.append(len(s))
                for out, half in zip((s1, s2), _halves(s)):
                    out.append(half)
                found.append(minmax(s) if len(s) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), list_column(np.concatenate(found) if found else [], map(len, found), pa.int64())],
                names=["id", "n", "s1", "s2", "bands"],
            )

    return source.mapInArrow(run, f"id {kind}, n long, s1 long, s2 long, bands array<long>")


def shingle_sets(docs: DataFrame, k: int, ids: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, s1, shingles array<long>) of the documents whose id may be in ``ids``; s1 as signatures() has it."""
    bits, n = bitmap(ids.select(F.xxhash64("id").alias("h")), "h")
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"), F.pmod(F.xxhash64(doc_id), F.lit(n)).alias("bit"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in small_batches(batches, 500):
            bit = batch.column(2).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((shared.value[bit >> 3] >> (bit & 7) & 1).astype(bool)))
            found = [shingler(t.as_py()).view(np.int64) for t in batch.column(1)]
            s1 = pa.array([_halves(x)[0] for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), s1, list_column(np.concatenate(found) if found else [], map(len, found), pa.int64())], names=["id", "s1", "shingles"])

    return source.mapInArrow(run, f"id {kind}, s1 long, shingles array<long>")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row.

    Documents are linked if 100 * |intersection| >= percent * |union|.
    """
    bands, rows = banding(percent / 100)
    sig = materialize(signatures(docs, k, bands, rows, doc_id, text), "signatures")
    live = sig.where("n > 0 and id is not null")

    # documents of equal sets are one class, named by its least document
    classes = live.groupBy("s1", "s2").agg(F.min("id").alias("rep"))
    member = materialize(live.select("id", "n", "s1", "s2").join(classes, ["s1", "s2"]).select("id", "n", "s1", "s2", "rep").distinct(), "classes")
    heads = member.where("id = rep").select("id", "s1", "s2")

    # buckets of two classes at least; the least (document, set) of each is its hub
    slots = sig.join(heads, ["id", "s1", "s2"]).select(F.col("id").alias("rep"), "n", "s1", F.explode("bands").alias("bh"))
    hubs = slots.groupBy("bh").agg(F.min(F.struct("rep", "s1", "n")).alias("hub"), F.max(F.struct("rep", "s1")).alias("last")).where("hub.rep <> last.rep or hub.s1 <> last.s1").select("bh", "hub")
    bucket = materialize(slots.join(hubs, "bh").select("bh", "rep", "n", "s1", F.col("hub.rep").alias("hub"), F.col("hub.s1").alias("hub_s1"), F.col("hub.n").alias("hub_n")), "buckets")

    # the full sets of the candidates
    ids = materialize(bucket.select(F.col("rep").alias("id"), "s1").distinct(), "candidates")
    sets = shingle_sets(docs.where(F.col(doc_id).isNotNull()), k, ids, doc_id, text)
    sets = materialize(sets.join(ids, ["id", "s1"]).dropDuplicates(["id", "s1"]), "sets")

    # first each member with its bucket's hub
    stars = bucket.where("rep <> hub or s1 <> hub_s1").select("hub", "hub_s1", "hub_n", "rep", "s1", "n").distinct()
    left = sets.select(F.col("id").alias("hub"), F.col("s1").alias("hub_s1"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("rep"), "s1", F.col("shingles").alias("y"))
    stars = stars.join(left, ["hub", "hub_s1"]).join(right, ["rep", "s1"])
    stars = stars.select("hub", "hub_s1", "hub_n", "rep", "s1", "n", F.size(F.array_intersect("x", "y")).cast("long").alias("both"))
    stars = materialize(stars, "stars")
    links = stars.where(_linked("both", "hub_n", "n", percent)).select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    several = member.groupBy("id").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    links = links.union(member.join(several, "id").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    comp = materialize(components(links), "components")

    # then what met one hub but is in several components
    seen = stars.select("hub", "hub_s1", "rep", "s1", "n", (1 - F.col("both") / (F.col("hub_n") + F.col("n") - F.col("both"))).alias("d"))
    own = stars.select("hub", "hub_s1", F.col("hub").alias("rep"), F.col("hub_s1").alias("s1"), F.col("hub_n").alias("n"), F.lit(0.0).alias("d")).distinct()
    named = materialize(seen.union(own).join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "named")
    mixed = named.groupBy("hub", "hub_s1").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("members")).where("c0 <> c1")
    # a hub's members in chunks of CELL: a cell compares two chunks, so no task holds a family or its square
    cells = materialize(mixed.select("hub", "hub_s1", F.ceil(F.col("members") / CELL).cast("int").alias("chunks")), "cells")
    rest = named.join(cells, ["hub", "hub_s1"]).withColumn("chunk", F.pmod(F.xxhash64("rep", "s1"), "chunks").cast("int"))
    rest = materialize(rest.join(right, ["rep", "s1"]), "mixed")
    p = rest.withColumn("a", F.col("chunk")).withColumn("b", F.explode(F.sequence("chunk", F.col("chunks") - 1)))
    q = rest.withColumn("b", F.col("chunk")).withColumn("a", F.explode(F.sequence(F.lit(0), "chunk")))
    one_cell = [F.col(f"p.{c}") == F.col(f"q.{c}") for c in ("hub", "hub_s1", "a", "b")]
    pairs = p.alias("p").join(
        q.alias("q"),
        functools.reduce(operator.and_, one_cell)
        & (F.col("p.comp") != F.col("q.comp"))
        & ((F.col("p.a") < F.col("p.b")) | (F.col("p.comp") < F.col("q.comp")))  # a chunk with itself: each pair once
        & (100 * F.least("p.n", "q.n") >= percent * F.greatest("p.n", "q.n"))
        & (F.abs(F.col("p.d") - F.col("q.d")) <= 1 - percent / 100 + 1e-9)  # the Jaccard distance is a metric
        & _linked(F.size(F.array_intersect("p.y", "q.y")), F.col("p.n"), F.col("q.n"), percent),
    ).select(F.col("p.comp").alias("a"), F.col("q.comp").alias("b"))
    merged = components(pairs.distinct())
    final = comp.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("root")), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))
    # components merged by the second step may hold documents that the first left alone
    final = materialize(final.union(merged.join(comp.select("node"), "node", "left_anti")), "merged")

    release(bucket, ids, sets, stars, named, cells, rest)
    of_class = member.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("comp", "rep").alias("comp"))
    of_class = of_class.groupBy("id").agg(F.min("comp").alias("comp"))
    out = sig.select("id", "n").join(of_class, "id", "left")
    out = out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("comp", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(doc_id) == F.col("component_id"), F.lit(True)))


def _linked(both, n, m, percent: int):
    both, n, m = (F.col(x) if isinstance(x, str) else x for x in (both, n, m))
    return 100 * both >= percent * (n + m - both)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first of their component; of repeated ids the least text stays.

    Rows without an id stay.
    """
    found = materialize(near_duplicates(docs, k, percent, doc_id, text).select(F.col(doc_id).alias("dropped_id"), "kept"), "verdicts")
    out = docs.join(found.where(~F.col("kept")).select("dropped_id"), docs[doc_id] == F.col("dropped_id"), "left_anti")
    again = found.where("kept and dropped_id is not null").groupBy("dropped_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    if again.isEmpty():
        return out
    order = Window.partitionBy(doc_id).orderBy(text)
    name = "place"
    while name in docs.columns:
        name += "_"
    return out.withColumn(name, F.row_number().over(order)).where(F.col(doc_id).isNull() | (F.col(name) == 1)).select(*docs.columns)
