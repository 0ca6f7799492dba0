"""Repeated passages by a sparse suffix array.

Only suffixes at minimisers are kept: the k-gram of least hash in every SPAN
consecutive ones, so the choice depends on content alone and two copies of a
passage keep the same places. A suffix is filed under the hash of its first
CORE words, with the words to its left and right that a passage can reach.
Suffixes whose core occurs once are dropped; the others are sorted across the
cluster by core, left words, right words. Equal rows are copies and need one
representative. The different contexts of a core are compared with each other
while they are FEW. Where a core has more (or lies at a partition border) each
context gives a hash for every window of ``min_words`` words around its core,
and equal windows meet in a second sort: a repeated window is found whatever
stands between its places, without pairs. With SPAN + CORE <= min_words + 1
each passage of min_words has a minimiser with CORE words of it to the right.

Words are those between ASCII white space, in ASCII lower case.

Defined results
    null, empty or shorter text than min_words: no passage. A passage repeated
    within one document counts. Repeated rows are copies of one another.
    ``copy`` is true for the words of matches with an earlier place (by doc_id,
    then word); the other words of a passage are spans of their own, which may
    be shorter than min_words; ties (repeated rows) are no copies. Null doc_id: skipped. Extra
    columns are not read. Very long texts are one row of many suffixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import re
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, materialize, merge_spans, release, small_batches, utf8

MIN_WORDS, GRAM, SPAN, CORE = 50, 5, 20, 31
#: Contexts of a core that are compared with each other; more meet by window hashes.
FEW = 8
#: Bytes of a context word's hash: an extension overruns by a word once in 2 ** 32 ends.
WIDTH = 4
#: Repeated cores up to which a bitmap of them goes to every task; beyond, places join with them.
MAP_CORES = 1 << 25
MEMO = 200_000
_word = re.compile(r"[^\x20\x09-\x0D]+")


class Suffixes:
    def __init__(self):
        rng = np.random.default_rng(5)
        self.gram, self.core = (rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (GRAM, CORE))
        self.memo: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, core hashes, word hashes)"""
        words = utf8(text).lower().split()
        none = np.empty(0, np.int64)
        if len(words) < MIN_WORDS:
            return none, none, none.view(np.uint64)
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words):
            if w not in memo:
                memo[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        n = len(h) - GRAM + 1
        g = np.zeros(n, np.uint64)
        for j in range(GRAM):
            g += h[j : j + n] * self.gram[j]
        g ^= g >> np.uint64(32)
        g *= np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(29)
        view = np.lib.stride_tricks.sliding_window_view(g, SPAN)
        places = np.unique(np.concatenate([view[k : k + 65536].argmin(1) + np.arange(k, min(k + 65536, len(view))) for k in range(0, len(view), 65536)]))
        places = places[places + CORE <= len(h)]
        key = np.zeros(len(places), np.uint64)
        for j in range(CORE):
            key += h[places + j] * self.core[j]
        key ^= key >> np.uint64(31)
        return places, key.view(np.int64), h

    def contexts(self, places: np.ndarray, h: np.ndarray, context: int) -> tuple[list[bytes], list[bytes]]:
        """The words left of each place (nearest first) and right of its core, WIDTH bytes of hash a word."""
        short = (h >> np.uint64(64 - 8 * WIDTH)).astype(f">u{WIDTH}")
        left, right, back = [], [], short[::-1].tobytes()
        data, n = short.tobytes(), len(h)
        for q in places.tolist():
            left.append(back[WIDTH * (n - q) : WIDTH * (n - q + context)])
            right.append(data[WIDTH * (q + CORE) : WIDTH * (q + CORE + context)])
        return left, right


def suffixes(docs: DataFrame, doc_id: str, text: str, context: int) -> DataFrame:
    """(id, place, key, left_words, right_words) of the suffixes whose core occurs twice or more.

    While the repeated cores are MAP_CORES at most, a bitmap of them picks the
    suffixes inside the second scan, with a few others, which meet nothing.
    Beyond that the places themselves join with the cores, and texts with their
    places, so no more is made than what is repeated.
    """
    source = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Suffixes()
        for batch in small_batches(batches):
            found = [make(t.as_py())[1] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else [], pa.int64())], names=["key"])

    twice = materialize(source.mapInArrow(keys, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "cores")
    if twice.count() > MAP_CORES:
        return materialize(_joined(source, twice, context), "suffixes")
    bits, n = bitmap(twice, "key")
    release(twice)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Suffixes()
        for batch in small_batches(batches, 500):
            made = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                q, key, h = make(t.as_py())
                bit = key & (n - 1)
                keep = (shared.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
                made.append((i, q[keep], key[keep], h))
            yield _suffix_batch(make, made, context)

    return materialize(source.mapInArrow(rows, _suffix_type), "suffixes")


_suffix_type = "id long, place long, key long, left_words binary, right_words binary"


def _suffix_batch(make: Suffixes, made: list[tuple], context: int) -> pa.RecordBatch:
    """The suffixes of texts (id, places, cores, word hashes)."""
    ids, left, right = [], [], []
    for i, q, _, h in made:
        a, b = make.contexts(q, h, context)
        ids += [i] * len(q)
        left += a
        right += b
    flat = lambda k: np.concatenate([np.empty(0, np.int64), *(x[k] for x in made)])
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(flat(1), pa.int64()), pa.array(flat(2), pa.int64()), pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["id", "place", "key", "left_words", "right_words"])


def _joined(source: DataFrame, twice: DataFrame, context: int) -> DataFrame:
    """The suffixes of exactly the cores in ``twice``, by joins."""
    source = source.withColumn("h", F.xxhash64("text"))

    def light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Suffixes()
        for batch in small_batches(batches):
            for i, t, h in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                q, key, _ = make(t.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(q), pa.int64()) for x in (i, h)] + [pa.array(q, pa.int64()), pa.array(key)], names=["id", "h", "place", "key"])

    places = source.mapInArrow(light, "id long, h long, place long, key long").join(twice, "key").groupBy("id", "h").agg(F.collect_set("place").alias("places"))  # as many as the text has

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Suffixes()
        for batch in small_batches(batches, 500):
            made = []
            for i, t, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                q, key, h = make(t.as_py())
                keep = np.isin(q, wanted.values.to_numpy())
                made.append((i, q[keep], key[keep], h))
            yield _suffix_batch(make, made, context)

    return source.join(places, ["id", "h"]).select("id", "text", "places").mapInArrow(rows, _suffix_type)


def _common(a: bytes, b: bytes) -> int:
    """Equal words at the start of both."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    k = 0
    while a[k : k + WIDTH] == b[k : k + WIDTH]:
        k += WIDTH
    return k // WIDTH


def _reach(reps: list[tuple], min_words: int) -> Iterator[tuple]:
    """(id, start, end, partner, later): what each of a core's contexts (left, right, id, place) shares with the others."""
    for p in reps:
        reach: dict[bool, tuple] = {}
        for q in reps:
            left, right = _common(p[0], q[0]), _common(p[1], q[1])
            if p is q or left + CORE + right < min_words:
                continue
            later = q[2:] < p[2:]
            a, b, c = reach.get(later, (0, 0, q[2]))
            reach[later] = max(a, left), max(b, right), min(c, q[2])  # all hold the core, so they are one span
        for later, (a, b, c) in reach.items():
            yield p[2], p[3] - a, p[3] + CORE + b, c, later


SPANS = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("partner", pa.int64()), ("later", pa.bool_())])
OPEN = pa.schema([("key", pa.int64()), ("left_words", pa.binary()), ("right_words", pa.binary()), ("id", pa.int64()), ("place", pa.int64())])
_spans_type = "id long, start long, end long, partner long, later boolean"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(schema), schema.types)], schema=schema)


def contexts(rows: DataFrame, min_words: int) -> DataFrame:
    """A span (id, start, end, partner, later) or a context (key, left_words, right_words, at, place) a row: spans of suffixes that their own partition decides, or a context left to the windows."""
    order = ["key", "left_words", "right_words", "id", "place"]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rep, reps, spread, alone = None, None, [], True, True  # a partition's first core may go on from the one before

        for batch in small_batches(batches, 10_000):
            spans, wide = [], []
            for k, left, right, i, place in zip(*(c.to_pylist() for c in batch.columns)):
                if k == key and left == rep[0] and right == rep[1]:
                    a, b = place - len(left) // WIDTH, place + CORE + len(right) // WIDTH
                    if b - a >= min_words:
                        if alone:
                            spans.append((rep[2], rep[3] - len(left) // WIDTH, rep[3] + CORE + len(right) // WIDTH, i, False))
                            alone = False
                        spans.append((i, a, b, rep[2], (i, place) != rep[2:]))
                    continue
                if k != key:
                    if not spread and len(reps) > 1:
                        spans += _reach(reps, min_words)
                    spread = key is None
                    key, reps = k, []
                rep, alone = (left, right, i, place), True
                if not spread:
                    reps.append(rep)
                    if len(reps) > FEW:
                        wide += [(k, *r) for r in reps]
                        spread, reps = True, []
                else:
                    wide.append((k, *rep))
            yield from both(spans, wide)
        yield from both([], [(key, *r) for r in reps])  # the last core may go on in the next partition

    def both(spans, wide):
        n, m = len(spans), len(wide)
        s, w = _batch(spans, SPANS), _batch(wide, OPEN)
        cols = [pa.concat_arrays([c, pa.nulls(m, c.type)]) for c in s.columns] + [pa.concat_arrays([pa.nulls(n, c.type), c]) for c in w.columns]
        yield pa.RecordBatch.from_arrays(cols, names=[*SPANS.names, "key", "left_words", "right_words", "at", "place"])

    made = ordered.mapInArrow(run, f"{_spans_type}, key long, left_words binary, right_words binary, at long, place long")
    return materialize(made, "contexts")


def windows(wide: DataFrame, min_words: int) -> DataFrame:
    """(h, id, start): each window of ``min_words`` around the core of each context."""
    free = min_words - CORE
    salt = np.random.default_rng(7).integers(1, 2**63, 2 * free + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sums(column: pa.Array, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of the hashed words, from none to ``free`` of them, and how many there are."""
        have = [x.as_py() for x in column]
        words = np.frombuffer(b"".join(x[: WIDTH * free].ljust(WIDTH * free, b"\0") for x in have), f">u{WIDTH}").reshape(-1, free).astype(np.uint64) + np.uint64(1)
        out = np.zeros((len(have), free + 1), np.uint64)
        np.cumsum(words * by, axis=1, out=out[:, 1:])
        return out, np.array([len(x) // WIDTH for x in have], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 10_000):
            (a, n), (b, m) = sums(batch.column(1), salt[:free]), sums(batch.column(2), salt[free:-1])
            key = batch.column(0).to_numpy().view(np.uint64) * salt[-1]
            for l in range(free + 1):  # noqa: E741
                has = (n >= l) & (m >= free - l)
                h = key + a[:, l] + b[:, free - l] + np.uint64(l) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
                h *= np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
                yield pa.RecordBatch.from_arrays([pa.array(h[has].view(np.int64)), batch.column(3).filter(pa.array(has)), pa.array(batch.column(4).to_numpy()[has] - l)], names=["h", "id", "start"])

    return materialize(wide.select("key", "left_words", "right_words", F.col("at").alias("id"), "place").mapInArrow(run, "h long, id long, start long"), "windows")


def _meet(h: np.ndarray, i: np.ndarray, s: np.ndarray, min_words: int) -> list[np.ndarray]:
    """The spans of rows, in order, whose hash is that of the row before."""
    k = np.flatnonzero(h[1:] == h[:-1])
    other = (i[k] != i[k + 1]) | (s[k] != s[k + 1])
    start = np.concatenate([s[k], s[k + 1]])
    return [np.concatenate([i[k], i[k + 1]]), start, start + min_words, np.concatenate([i[k + 1], i[k]]), np.concatenate([np.zeros(len(k), bool), other])]


def repeated(rows: DataFrame, min_words: int) -> DataFrame:
    """(id, start, end, partner, later): the windows whose hash occurs twice or more."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = ["h", "id", "start"]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, None
        part = TaskContext.get().partitionId()
        names = [*SPANS.names, "part", "h"]

        def border(row):  # its id and start stand in the span's columns
            return pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip((row[1], row[2], None, None, None), SPANS.types)), pa.array([part], pa.int32()), pa.array([row[0]], pa.int64())], names=names)

        for batch in small_batches(batches, 100_000):
            cols = [c.to_numpy() for c in batch.columns]
            if last is None:
                first = [int(c[0]) for c in cols]
            else:
                cols = [np.concatenate([[x], c]) for x, c in zip(last, cols)]
            last = [int(c[-1]) for c in cols]
            out = [pa.array(c, t) for c, t in zip(_meet(*cols, min_words), SPANS.types)]
            yield pa.RecordBatch.from_arrays([*out, pa.nulls(len(out[0]), pa.int32()), pa.nulls(len(out[0]), pa.int64())], names=names)
        if first is not None:
            yield border(first)
            yield border(last)

    made = materialize(ordered.mapInArrow(run, f"{_spans_type}, part int, h long"), "repeated")
    # the last window of a partition against the first of the next: two rows a partition
    by = Window.orderBy("part", "h", "id", "start")
    edges = made.where("part is not null").select("part", "h", "id", "start", *(F.lag(c).over(by).alias(f"{c}0") for c in ("part", "h", "id", "start"))).where("part0 < part and h0 = h")
    end = lambda c: F.col(c) + min_words
    one = edges.select(F.col("id0").alias("id"), F.col("start0").alias("start"), end("start0").alias("end"), F.col("id").alias("partner"), F.lit(False).alias("later"))
    two = edges.select("id", "start", end("start").alias("end"), F.col("id0").alias("partner"), F.expr("id0 <> id or start0 <> start").alias("later"))
    return made.where("part is null").select(*SPANS.names).union(one).union(two)


def islands(found: DataFrame) -> DataFrame:
    """(id, start, end, partner, copy): the words of each document's later spans merged, and the rest of all its spans."""
    ordered = found.repartition("id").sortWithinPartitions("id", "start").select(*SPANS.names)

    def of(i: int, spans: list[tuple]) -> Iterator[tuple]:
        copies = merge_spans((a, b) for a, b, _, later in spans if later)
        rest, k = [], 0
        for a, b in merge_spans((a, b) for a, b, _, _ in spans):
            while k < len(copies) and copies[k][0] < b:  # a copy lies within one island of all spans
                rest.append((a, copies[k][0]))
                a, k = copies[k][1], k + 1
            rest.append((a, b))
        for parts, copy in ((copies, True), ([x for x in rest if x[0] < x[1]], False)):
            k = 0
            for a, b in parts:
                while k < len(spans) and spans[k][0] < a and spans[k][1] <= a:
                    k += 1
                partner, j = None, k
                while j < len(spans) and spans[j][0] < b:
                    if spans[j][1] > a and spans[j][3] >= copy and (partner is None or spans[j][2] < partner):
                        partner = spans[j][2]
                    j += 1
                yield i, a, b, partner, copy

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, spans = None, []
        for batch in small_batches(batches, 10_000):
            out = []
            for i, *span in zip(*(c.to_pylist() for c in batch.columns)):
                if i != at:
                    out += of(at, spans)
                    at, spans = i, []
                spans.append(tuple(span))
            yield _batch(out, SPANS)
        yield _batch(list(of(at, spans)), SPANS)

    return ordered.mapInArrow(run, _spans_type).withColumnRenamed("later", "copy")


def passages(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, partner, copy): the repeated passages of each document, in words, end exclusive.

    ``partner`` is the least document met that has words of the passage too.
    """
    if min_words < MIN_WORDS:
        raise ValueError(f"a passage has {MIN_WORDS} words at least")
    kept = suffixes(docs, doc_id, text, min_words - CORE + 1)
    made = contexts(kept, min_words)
    release(kept)
    wide = windows(made.where("key is not null"), min_words)
    again = repeated(wide, min_words)
    release(wide)
    found = made.where("key is null").select(*SPANS.names).union(again)
    return islands(found).select(F.col("id").alias(doc_id), "start", "end", "partner", "copy")


def remove(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with every copy of a passage cut from the text; its first place stays."""
    columns, at = docs.columns, docs.columns.index(text)
    cut = passages(docs, min_words, doc_id, text).where("copy").groupBy(F.col(doc_id).alias("cut_id")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    joined = docs.join(cut, docs[doc_id] == cut["cut_id"], "left").select(*(docs[c].alias(f"c{j}") for j, c in enumerate(columns)), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = []
            for t, spans in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist()):
                if t and spans:
                    words = [m.span() for m in _word.finditer(t)]
                    kept, k = [], 0
                    for s in spans:
                        kept.append(t[k : words[s["start"]][0]])
                        k = words[s["end"] - 1][1]
                    t = "".join([*kept, t[k:]])
                texts.append(t)
            new = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays([new if j == at else c for j, c in enumerate(batch.columns[: len(columns)])], names=[f"c{j}" for j in range(len(columns))])

    schema = joined.select(*(f"c{j}" for j in range(len(columns)))).schema
    return joined.mapInArrow(run, schema).select(*(F.col(f"c{j}").alias(c) for j, c in enumerate(columns)))
