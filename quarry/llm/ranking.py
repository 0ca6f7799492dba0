"""Ranked lexical search by sort-based accumulation.

Texts are cut into terms once. What the queries' terms have in a document is
kept as two short arrays (terms, counts), written, and dealt out by ranges of
document ids. A task then lays the impacts of a run of documents end to end as
arrays of (query, document, impact), packs query and document into one key,
sorts the keys by radix, and sums equal keys with ``reduceat``. A document is
whole in its task, so its sums are final there; each task keeps the best of
each query in a heap, and only those are shuffled for the last selection.

Weights are floor(1000 * ln((2N + 2) / (2df + 1))) in doubles and everything
else is whole numbers, so sums are the same in any order.

Queries go to the tasks in blocks of ``BLOCK_BYTES`` of text, each with its own
pass over the documents; blocks are made one at a time.

Defined results
    null or empty texts have no terms: such documents count nowhere, such queries have no rows.
    rows of one query id are one query with the terms of all of them; a null query id is an id.
    repeated document rows are ranked each; null document ids come last among equals.
    no scores above 0: no row. Empty tables give no rows. Extra columns aren't read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import list_column, materialize, release, small_batches, utf8

#: Bytes of query text whose terms and postings go to the tasks at once.
BLOCK_BYTES = 16 << 20
#: Impacts in a run, and documents, whose number takes 16 bits of a key.
RUN, RUN_DOCS = 1 << 21, 1 << 16
#: Documents of a range.
RANGE_DOCS = 10_000
#: The length's share of a document's norm, in hundredths.
B = 75

_plain = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z in lower case."""
    return utf8(text).translate(_plain).split()


class Asked:
    """A block of queries: its vocabulary, and each term's queries with their counts, end to end."""

    def __init__(self, rows):
        per: dict = {}
        for name, text in rows:
            per.setdefault(name, Counter()).update(terms_of(text))
        self.names = list(per)
        self.number = {t: k for k, t in enumerate(sorted({t for c in per.values() for t in c}))}
        held: list[list[tuple[int, int]]] = [[] for _ in self.number]
        for q, counts in enumerate(per.values()):
            for t, n in counts.items():
                held[self.number[t]].append((q, n))
        self.bounds = np.cumsum([0, *map(len, held)])
        self.queries = np.array([q for h in held for q, _ in h], np.int64)
        self.times = np.array([n for h in held for _, n in h], np.int64)


def blocks(queries: DataFrame, query_id: str, text: str, block_bytes: int) -> Iterator[Asked]:
    """All rows of an id are in the same block."""
    items = queries.select(F.col(query_id).alias("i"), F.col(text).cast("string").alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t") + 8)).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    for k in range(n):
        of = items if n == 1 else items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k)
        yield Asked((r["i"], r["t"]) for r in of.toLocalIterator())


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned keys, by digits of 16 bits; digits in order already cost one look."""
    order, top = None, int(keys.max()) if len(keys) else 0
    for shift in range(0, max(top.bit_length(), 1), 16):
        digit = ((keys if order is None else keys[order]) >> np.uint64(shift)).astype(np.uint16)
        if (digit[1:] >= digit[:-1]).all():
            continue
        step = np.argsort(digit, kind="stable")
        order = step if order is None else order[step]
    return np.arange(len(keys)) if order is None else order


def postings(docs: DataFrame, asked, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, counts) of each document with a term at all: its length, and its asked terms' numbers and counts."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = asked.value.number
        for batch in small_batches(batches, 500):
            ids, sizes, terms, counts, lengths = [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(text.as_py())
                if not words:
                    continue
                found = Counter(k for w in words if (k := number.get(w)) is not None)
                ids.append(i)
                sizes.append(len(words))
                lengths.append(len(found))
                terms.extend(found)
                counts.extend(found.values())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), list_column(terms, lengths, pa.int32()), list_column(counts, lengths, pa.int64())], names=["doc_id", "n", "terms", "counts"])

    return source.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


class Best:
    """The k best (score, id) of each query; of equal scores the least id, null last."""

    def __init__(self, k: int, queries: int):
        self.k, self.heaps, self.least = k, [[] for _ in range(queries)], np.zeros(queries, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        may = np.flatnonzero((score > 0) & (score >= self.least[query]))
        may = may[np.lexsort([ids[may], ~known[may], -score[may], query[may]])]
        own = query[may]
        may = may[np.arange(len(may)) - np.searchsorted(own, own) < self.k]
        for q, s, there, i in zip(query[may].tolist(), score[may].tolist(), known[may].tolist(), ids[may].tolist()):
            heap, entry = self.heaps[q], (s, there, -i)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.least[q] = heap[0][0]


def accumulate(asked: Asked, impact: np.ndarray, term: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, doc, score): the impacts of a run's postings, in order of ``doc``, summed for each query and document."""
    size = asked.bounds[term + 1] - asked.bounds[term]
    at = np.repeat(asked.bounds[term], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    keys = asked.queries[at].astype(np.uint64) << np.uint64(16) | np.repeat(doc, size).astype(np.uint64)
    part = np.repeat(impact, size) * asked.times[at]
    if not len(keys):
        return keys.astype(np.int64), keys.astype(np.int64), part
    order = radix_order(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    keys = keys[starts]
    return (keys >> np.uint64(16)).astype(np.int64), (keys & np.uint64(0xFFFF)).astype(np.int64), np.add.reduceat(part[order], starts)


def _runs(work: np.ndarray) -> Iterator[tuple[int, int]]:
    """[begin, end) of documents whose impacts, ``work`` each, make a run; a document alone may be more."""
    begin, held = 0, 0
    for k, w in enumerate(work.tolist()):
        if k > begin and (held + w > RUN or k - begin >= RUN_DOCS):
            yield begin, k
            begin, held = k, 0
        held += w
    if begin < len(work):
        yield begin, len(work)


def _select(matched: DataFrame, shared, k: int, n_docs: int, n_terms: int) -> DataFrame:
    """(query, doc_id, score): the best of each query in each task; ``shared`` holds the block and its terms' weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = shared.value
        spread, best = np.diff(asked.bounds), Best(k, len(asked.names))
        for batch in small_batches(batches, 10_000):
            known = np.array(batch.column(0).is_valid())
            ids = batch.column(0).fill_null(0).to_numpy()
            norm = 100 - B + (B * batch.column(1).to_numpy() * n_docs) // n_terms
            lengths = np.array(batch.column(2).value_lengths())
            terms, counts = (batch.column(j).flatten().to_numpy() for j in (2, 3))
            doc = np.repeat(np.arange(len(ids)), lengths)
            impact = weight[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * norm[doc]))
            bounds = np.r_[0, np.cumsum(lengths)]
            work = np.bincount(doc, spread[terms], len(ids)).astype(np.int64)
            for a, b in _runs(work):
                one = slice(bounds[a], bounds[b])
                query, place, score = accumulate(asked, impact[one], terms[one], doc[one] - a)
                best.add(query, score, ids[a + place], known[a + place])
        rows = [(q, s, -i if there else None) for q, heap in enumerate(best.heaps) for s, there, i in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["query", "doc_id", "score"])

    return matched.mapInArrow(run, "query int, doc_id long, score long")


def rank(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, doc_id, score): the ``k`` best documents of each query with a score above 0."""
    spark, out = docs.sparkSession, None
    kind = queries.schema[query_id].dataType.simpleString()
    for asked in blocks(queries, query_id, query_text, block_bytes):
        shared = spark.sparkContext.broadcast(asked)
        post = materialize(postings(docs, shared, doc_id, text), "postings")
        n_docs, n_terms = post.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(asked.number), np.int64)
        for r in post.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toLocalIterator():  # a row a term of the block
            df[r["t"]] = r["df"]
        weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        weighted = spark.sparkContext.broadcast((asked, weight))
        matched = post.where(F.size("terms") > 0)
        parts = max(spark.sparkContext.defaultParallelism, -(-n_docs // RANGE_DOCS))
        found = _select(matched.repartitionByRange(parts, "doc_id", "n"), weighted, k, n_docs, max(n_terms, 1))
        w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = materialize(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "ranked")
        release(post)
        names = spark.createDataFrame(list(enumerate(asked.names)), f"query int, name {kind}")
        part = top.join(names, "query").select(F.col("name").alias(query_id), "rank", "doc_id", "score")
        out = part if out is None else out.union(part)
    return out
