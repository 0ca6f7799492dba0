"""Shared helpers of the corpus operators: intermediate tables, batches, spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import fresh_path, materialize, release, remove, shared_dir  # noqa: F401

#: ASCII white space as the contracts have it: \x20 and \x09-\x0D.
SPACE_RE = r"[ \t\n\x0B\f\r]+"

def words_col(text) -> F.Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RE), "")


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def list_column(values, lengths, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and the length of each row's list."""
    offsets = [0]
    for n in lengths:
        offsets.append(offsets[-1] + int(n))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def merge_spans(spans) -> list[tuple[int, int]]:
    """Overlapping or touching [start, end) spans as one each, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: Most bits, as a power of two, of a bitmap that goes to every task: 64 MB.
MAP_BITS = 29


def bitmap(rows: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """(bytes, bits): the places ``column`` mod ``bits`` that occur, as a bit each.

    16 bits a row or more, but 2 ** MAP_BITS at most: beyond that it lets more
    pass, and never fewer.
    """
    n = 1 << max(23, min(MAP_BITS, int(rows.count() * 16).bit_length()))
    place = rows.select(F.pmod(F.col(column), F.lit(n)).alias("p"))
    bucket = place.select(F.expr("p div 32768").alias("k"), F.expr("cast(p % 32768 as bigint)").alias("b"))
    out = np.zeros(n // 8, np.uint8)
    for r in bucket.groupBy("k").agg(F.bitmap_construct_agg("b").alias("bits")).collect():
        out[r["k"] * 4096 : (r["k"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out, n


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, so that what is made from one stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
