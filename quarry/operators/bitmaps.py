"""Bitmaps of bounded size that tell tasks which keys matter, in place of a shuffle of all rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

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


def held(found: tuple[np.ndarray, int], keys: np.ndarray) -> np.ndarray:
    """Which int64 keys have their bit."""
    bits, n = found
    at = keys % n
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
