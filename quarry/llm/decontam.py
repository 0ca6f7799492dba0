"""Benchmark decontamination with an FM-index for each shard of the corpus.

A task gathers documents into shards. A shard's index text is its documents'
words as numbers of the benchmark's vocabulary, where other words are
separators; runs too short to hold a phrase become separators too, which
loses none. The phrases (windows of consecutive words) are sought backwards
through the wavelet ranks, occurrences located by sampled suffix positions,
and the spans of words merged.

The benchmark goes to the tasks in blocks of BLOCK_BYTES at most, whose tables
are arrays of a few times that size; beyond one block the corpus is scanned
once a block and the spans are united.

Defined results
    null or wordless text: no words, not contaminated. null doc_id: a row like
    any other.
    benchmark item of fewer words than a window: one phrase; of none, or with
    a null id: no phrase. Repeated items count once.
    empty benchmark: nothing is hit. Repeated rows: a row each. Extra columns
    are not read. Very long texts are a shard of their own.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import merge_spans, small_batches, utf8
from .fmindex import FMIndex

BLOCK_BYTES = 16 << 20
SHARD_WORDS = 2_000_000
#: ASCII letters and digits and all beyond ASCII make words; letters become lower-case.
_TABLE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
_word = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(_TABLE).split()


class Phrases:
    """The benchmark's phrases, as arrays: the items' words as numbers in one row, and
    for each length the place of each different phrase and the items that hold it.

    About 25 bytes a word of the benchmark, and its vocabulary.
    """

    def __init__(self, items, window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        number: dict[str, int] = {}
        rows, owner, starts = [np.empty(0, np.int32)], [], defaultdict(list)
        upto = 0
        for item, text in items:
            w = np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words_of(text)], np.int32)
            n = min(window, len(w))
            if n:
                k = number.setdefault(str(item), len(number))
                rows.append(w)
                starts[n].append(np.arange(upto, upto + len(w) - n + 1, dtype=np.int32))
                owner.append(np.full(len(w), k, np.int32))
                upto += len(w)
        self.names = list(number)
        self.words = np.concatenate(rows)
        owner = np.concatenate([np.empty(0, np.int32), *owner])
        self.by_length = {n: self._distinct(np.concatenate(x), owner, n) for n, x in starts.items()}
        self.shortest = min(starts, default=0)

    def _distinct(self, starts: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each different phrase, bounds of its items, items)"""
        odd = np.random.default_rng(n).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        h = np.zeros(len(starts), np.uint64)
        for j in range(n):
            h += (self.words[starts + j].astype(np.uint64) + np.uint64(1)) * odd[j]
        h ^= h >> np.uint64(32)
        order = np.lexsort([owner[starts], h])
        starts, h = starts[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        for j in range(n):  # phrases of one hash are the same only if their words are
            new[1:] |= self.words[starts[1:] + j] != self.words[starts[:-1] + j]
        first = np.flatnonzero(new)
        return starts[first], np.append(first, len(starts)), owner[starts]

    def scan(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """(words, hit spans of words, items) of each text of one shard."""
        get = self.vocabulary.get
        counts, pieces, owner, place = [], [], [], []
        for d, text in enumerate(texts):
            words = words_of(text)
            counts.append(len(words))
            if len(words) < self.shortest or not self.shortest:
                continue
            ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
            edge = np.flatnonzero(np.diff(np.concatenate([[0], ids > 0, [0]])))
            for a, b in edge.reshape(-1, 2):
                if b - a >= self.shortest:
                    pieces += [ids[a:b], _GAP]
                    owner.append(np.full(b - a + 1, d))
                    place.append(np.arange(a, b + 1))
        spans, items = defaultdict(list), defaultdict(set)
        if pieces:
            index = FMIndex(np.concatenate(pieces), len(self.vocabulary))
            owner, place = np.concatenate(owner), np.concatenate(place)
            for n, (starts, bounds, held) in self.by_length.items():
                low, high = index.search(np.lib.stride_tricks.sliding_window_view(self.words, n), starts)
                found = np.flatnonzero(high > low)
                if not len(found):
                    continue
                size = high[found] - low[found]
                rows = np.repeat(low[found], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                at = index.locate(rows)
                for p, d, k in zip(np.repeat(found, size).tolist(), owner[at].tolist(), place[at].tolist()):
                    spans[d].append((k, k + n))
                    items[d].update(held[bounds[p] : bounds[p + 1]].tolist())
        return [(n, merge_spans(spans[d]) if d in spans else [], sorted(self.names[k] for k in items[d]) if d in items else []) for d, n in enumerate(counts)]


_GAP = np.zeros(1, np.int64)


def _shards(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[list[pa.RecordBatch], list[str | None]]]:
    held, texts, size = [], [], 0
    for batch in small_batches(batches, 1000):
        new = batch.column(text_at).to_pylist()
        held.append(batch)
        texts += new
        size += sum(len(t) for t in new if t)
        if size >= 6 * SHARD_WORDS:
            yield held, texts
            held, texts, size = [], [], 0
    if held:
        yield held, texts


def blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_bytes: int) -> tuple[int, Iterator[Phrases]]:
    """How many blocks there are, and the table of each; one is made at a time."""
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").alias("t")).where("i is not null and t is not null")
    total = items.agg(F.sum(F.octet_length("t") + F.octet_length("i"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    of = lambda k: items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
    return n, (Phrases(((r["i"], r["t"]) for r in of(k).toLocalIterator()), window) for k in range(n))


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, spans array<struct<start, end>>, items array<string>, text_hash) for each row."""
    source = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"), F.col(text).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = f"id {kind}, h long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"

    def scanner(phrases):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held, texts in _shards(batches, 2):
                found, k = phrases.value.scan(texts), 0
                for batch in held:
                    part = found[k : k + batch.num_rows]
                    k += batch.num_rows
                    spans = pa.array([[{"start": a, "end": b} for a, b in x[1]] for x in part], pa.list_(span))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in part], pa.int64()), spans, pa.array([x[2] for x in part], pa.list_(pa.string()))], names=["id", "h", "n_words", "spans", "items"])

        return run

    out = None
    for phrases in blocks(benchmark, item_id, item_text, window, block_bytes)[1]:
        found = source.mapInArrow(scanner(docs.sparkSession.sparkContext.broadcast(phrases)), schema)
        if out is None:
            out = found
            continue
        more = found.where(F.size("items") > 0).select(F.col("id").alias("id2"), F.col("h").alias("h2"), F.col("spans").alias("spans2"), F.col("items").alias("items2")).dropDuplicates(["id2", "h2"])
        out = out.join(more, F.col("id").eqNullSafe(F.col("id2")) & F.col("h").eqNullSafe(F.col("h2")), "left")
        spans = F.array_sort(F.concat("spans", F.coalesce("spans2", F.array().cast("array<struct<start:long,end:long>>"))))
        items = F.array_sort(F.array_union("items", F.coalesce("items2", F.array().cast("array<string>"))))
        out = out.select("id", "h", "n_words", _united(spans).alias("spans"), items.alias("items"))
    return out.select(F.col("id").alias(doc_id), "n_words", "spans", "items", F.col("h").alias("text_hash"))


def _united(spans):
    """Overlapping or touching spans of a sorted array as one each."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(acc, s):
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, empty, add)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without these spans of words; a line break stands where one was."""
    at = [m.span() for m in _word.finditer(text)]
    out, k = [], 0
    for a, b in spans:
        out.append(text[k : at[a][0]])
        k = at[b - 1][1]
    out.append(text[k:])
    return "\n".join(x.strip() for x in out if x.strip())


def remove(docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` with every hit span cut from the text; rows that keep no word go, if they had any.

    With several blocks the spans of all are united before anything is cut.
    """
    columns = docs.columns
    at = columns.index(text)
    plain = docs.select(*(F.col(c).alias(f"c{j}") for j, c in enumerate(columns)))
    n, made = blocks(benchmark, item_id, item_text, window, block_bytes)
    if n == 1:
        shared = docs.sparkSession.sparkContext.broadcast(next(made))

        def spans_of(held, texts):
            return [x[1] for x in shared.value.scan(texts)]
    else:
        hit = find(docs, benchmark, window, doc_id, text, item_id, item_text, block_bytes).where(F.size("spans") > 0)
        hit = hit.select(F.col(doc_id).alias("hit_id"), F.col("text_hash").alias("hit_h"), "spans").dropDuplicates(["hit_id", "hit_h"])
        plain = plain.join(hit, F.col(f"c{columns.index(doc_id)}").eqNullSafe(F.col("hit_id")) & F.xxhash64(f"c{at}").eqNullSafe(F.col("hit_h")), "left").select(*plain.columns, "spans")

        def spans_of(held, texts):
            return [[(s["start"], s["end"]) for s in x or []] for batch in held for x in batch.column(len(columns)).to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, texts in _shards(batches, at):
            clean = [cut(t, spans) if spans else t for t, spans in zip(texts, spans_of(held, texts))]
            keep = [c is t or bool(words_of(c)) for t, c in zip(texts, clean)]
            k = 0
            for batch in held:
                part = pa.array(clean[k : k + batch.num_rows], batch.column(at).type)
                mask = pa.array(keep[k : k + batch.num_rows])
                k += batch.num_rows
                yield pa.RecordBatch.from_arrays([part if j == at else batch.column(j) for j in range(len(columns))], names=[f"c{j}" for j in range(len(columns))]).filter(mask)

    out = plain.mapInArrow(run, plain.select(*(f"c{j}" for j in range(len(columns)))).schema)
    return out.select(*(F.col(f"c{j}").alias(c) for j, c in enumerate(columns)))
