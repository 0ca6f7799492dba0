"""Vector codes by parts, the nearest entry found by pruning on norms.

Vectors become integers, are cut into equal parts, and each part is coded by
its nearest entry in that part's codebook. Entries are sorted by norm. By the
triangle inequality an entry within the best distance so far has a norm within
that distance of the part's own, so a binary search gives the only annulus
that can hold it; its entries, both ends included, are compared exactly in
integers, and each better one narrows the annulus again. So ties still go to
the entry of lower index.

A codebook is a few kilobytes at any size of the table. Each round is one scan
whose tasks send a sum for each part, entry and position; only these sums are
shuffled, and a lost task repeats its own scan.

Defined results
    null vectors, empty ones and such with null or non-finite components have no row.
    the number of components is that of the least id's vector; others have no row,
    and ValueError if it is no multiple of ``parts``.
    fewer vectors than entries: as many entries as vectors; entries may be equal.
    null ids: coded, and last among the first codebooks' vectors.
    repeated rows: a row each, and an entry each if they are among the first.
    equal distances: the entry of lower index. An empty table has no codebooks.
    components of 2**15 or more in size: ValueError, as 64-bit sums could overflow.
Extra columns pass through ``encode`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Largest component, as an integer, for which no sum overflows.
LARGEST = 2**27


@dataclass(frozen=True)
class Codebooks:
    """``entries[part]``: int64, (entries, components of a part)."""

    entries: tuple[np.ndarray, ...]
    scale: int = SCALE

    @property
    def size(self) -> int:
        return sum(e.shape[1] for e in self.entries)

    def text(self) -> str:
        """All components by part, entry and position, comma-joined."""
        return ",".join(str(x) for e in self.entries for x in e.ravel().tolist())

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that rows of entry numbers stand for."""
        return np.hstack([e[codes[:, p]] for p, e in enumerate(self.entries)]) / self.scale


class Annulus:
    """The entries of one part in order of their norms."""

    def __init__(self, entries: np.ndarray):
        norms = np.sqrt((entries * entries).sum(1).astype(np.float64))
        self.entries, self.order = entries, np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def _interval(self, norm: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        reach = np.sqrt(best.astype(np.float64))
        reach += 1e-9 * (norm + self.norms[-1] + 1)  # more than the rounding of the roots
        return np.searchsorted(self.norms, norm - reach, "left"), np.searchsorted(self.norms, norm + reach, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row; of equal ones the lower entry."""
        k = len(self.order)
        norm = np.sqrt((x * x).sum(1).astype(np.float64))
        first = np.minimum(np.searchsorted(self.norms, norm), k - 1)
        entry = self.order[first]
        best = ((x - self.entries[entry]) ** 2).sum(1)
        low, high = self._interval(norm, best)
        for step in range(1, k):
            for place in (first - step, first + step):
                rows = np.flatnonzero((place >= low) & (place < high))
                if not len(rows):
                    continue
                other = self.order[place[rows]]
                d = ((x[rows] - self.entries[other]) ** 2).sum(1)
                better = (d < best[rows]) | ((d == best[rows]) & (other < entry[rows]))
                rows = rows[better]
                entry[rows], best[rows] = other[better], d[better]
                low[rows], high[rows] = self._interval(norm[rows], best[rows])
        return entry, best


def integers(column: pa.Array, size: int, scale: int) -> np.ndarray:
    """(rows, size): floor(scale * x) of a list column without nulls."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"components must lie within {LARGEST // scale}")
    return x.astype(np.int64).reshape(-1, size)


def whole(vectors: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector has components and none that is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where((F.size(vector) > 0) & ~bad)


def _parts(x: np.ndarray, n: int) -> list[np.ndarray]:
    return [np.ascontiguousarray(p) for p in np.split(x, n, axis=1)]


def fit(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks that begin as the parts of the least ids' vectors and go through ``rounds`` rounds of assigning and averaging."""
    spark, kept = vectors.sparkSession, whole(vectors, vector).select(F.col(vec_id).alias("i"), F.col(vector).alias("v"))
    first = kept.orderBy(F.asc_nulls_last("i"), "v").limit(1).collect()
    if not first:
        return Codebooks((), scale)
    size = len(first[0]["v"])
    if size % parts:
        raise ValueError(f"{size} components don't make {parts} equal parts")
    kept = kept.where(F.size("v") == size)
    seeds = [r["v"] for r in kept.orderBy(F.asc_nulls_last("i"), "v").limit(entries).collect()]
    books = Codebooks(tuple(_parts(integers(pa.array(seeds, pa.list_(pa.float64())), size, scale), parts)), scale)
    k, d = len(seeds), size // parts
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rings = [Annulus(e) for e in shared.value.entries]
            total, count = np.zeros((parts, k, d), np.int64), np.zeros((parts, k), np.int64)
            for batch in small_batches(batches, 4096):
                for p, x in enumerate(_parts(integers(batch.column(0), size, scale), parts)):
                    entry, _ = rings[p].nearest(x)
                    np.add.at(total[p], entry, x)
                    count[p] += np.bincount(entry, minlength=k)
            place = np.arange(parts * k * d)
            used = np.repeat(count.ravel(), d) > 0
            yield pa.RecordBatch.from_arrays([pa.array(place[used], pa.int32()), pa.array(total.ravel()[used]), pa.array(np.repeat(count.ravel(), d)[used])], names=["place", "total", "n"])

        found = kept.select("v").mapInArrow(sums, "place int, total long, n long").groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        new = np.concatenate([e.ravel() for e in books.entries])
        for r in found.collect():  # one row a number in the codebooks
            new[r["place"]] = r["total"] // r["n"]
        shared.unpersist()
        books = Codebooks(tuple(new.reshape(parts, k, d)), scale)
    return books


def encode(vectors: DataFrame, books: Codebooks, vector: str = "embedding", code: str = "code", error: str = "error") -> DataFrame:
    """The rows that have a code, with ``code`` (two hexadecimal digits a part) and ``error`` (squared distances, summed) in place of the vector."""
    others = [c for c in vectors.columns if c != vector]
    plain = whole(vectors, vector).where(F.size(vector) == books.size).select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(others)), F.col(vector).alias("v"))
    kept = [f"c{k}" for k in range(len(others))]
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    hexes = [f"{k:02x}" for k in range(256)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        rings = [Annulus(e) for e in books.entries]
        for batch in small_batches(batches, 4096):
            codes, errors = [], np.zeros(batch.num_rows, np.int64)
            for ring, x in zip(rings, _parts(integers(batch.column(len(kept)), books.size, books.scale), len(rings))):
                entry, d = ring.nearest(x)
                codes.append(entry)
                errors += d
            text = ["".join(hexes[k] for k in row) for row in np.stack(codes, 1).tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(text, pa.string()), pa.array(errors)], names=[*kept, "code", "error"])

    schema = ", ".join([*(f"{k} {vectors.schema[c].dataType.simpleString()}" for k, c in zip(kept, others)), "code string, error long"])
    if not books.entries:
        return plain.select(*(F.col(k).alias(c) for k, c in zip(kept, others)), F.lit("").alias(code), F.lit(0).cast("long").alias(error)).where(F.lit(False))
    return plain.mapInArrow(run, schema).select(*(F.col(k).alias(c) for k, c in zip(kept, others)), F.col("code").alias(code), F.col("error").alias(error))


def with_group_error(coded: DataFrame, group: str, error: str = "error", out: str = "label_error") -> DataFrame:
    """``coded`` with the error summed over equal values of ``group``, nulls together.

    Sums come from partial ones, and the table of sums is written, so it is
    broadcast only if it is small; a group of a third of the rows is one row of it.
    """
    totals = materialize(coded.groupBy(F.col(group).alias("_group")).agg(F.sum(error).alias(out)), "group-errors")
    return coded.join(totals, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", group: str = "label", **settings: int) -> tuple[DataFrame, Codebooks]:
    """(vec_id, group, code, error, label_error) of every row that has a code, and the codebooks."""
    books = fit(vectors, vec_id, vector, **settings)
    coded = materialize(encode(vectors.select(F.col(vec_id).alias("vec_id"), F.col(group).alias("label"), F.col(vector).alias("v")), books, "v"), "codes")
    return with_group_error(coded, "label"), books
