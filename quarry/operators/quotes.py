"""Quotes in sources, citations of them, and claims that rest on them.

A quote is filed under one window of WINDOW code points, the one of least hash,
so quotes that begin alike still have keys of their own. Sources are scanned for
windows with such a key (a bitmap of bounded size tells which), what is met is
joined with the quotes by the key, and the whole quote is then compared at the
place that the window gives it. No quote is searched for in a source that
doesn't hold its window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.entities import numbers
from ..functions.text import one_space
from ..store import materialize
from .bitmaps import bitmap, held

#: Code points of a window, and the fewest that a quote may have.
WINDOW = 12
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def normal(text: Column) -> Column:
    """What quotes and sources are compared as: small letters, single spaces."""
    return F.lower(one_space(text))


def _hashes(text: str) -> np.ndarray:
    """A hash of each window of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(points) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h = (h ^ points[k : k + n]) * _FACTOR
        h ^= h >> np.uint64(29)
    return h.astype(np.int64)


def _keys(rows: DataFrame, only: tuple[np.ndarray, int] | None) -> DataFrame:
    """(id, key, at) of rows (id, text): the window of least hash of each text, or all whose bit is in ``only``."""
    shared = rows.sparkSession.sparkContext.broadcast(only) if only else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                rows, keys, places = [], [], []
                for i, text in enumerate(part.column(1)):
                    h = _hashes(text.as_py())
                    at = np.flatnonzero(held(shared.value, h)) if shared else h.argsort()[:1]
                    rows.append(np.full(len(at), i))
                    keys.append(h[at])
                    places.append(at)
                take = pa.array(np.concatenate(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), pa.array(np.concatenate(keys)), pa.array(np.concatenate(places).astype(np.int32))], names=["id", "key", "at"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, key long, at int")


def find(quotes: DataFrame, sources: DataFrame, quote_id: str, quote: str, source_id: str, text: str) -> DataFrame:
    """(quote_id, source_id): where each quote of WINDOW code points or more stands, as ``normal`` has both; shorter quotes and nulls stand nowhere."""
    asked = quotes.select(F.col(quote_id).alias("id"), normal(F.col(quote)).alias("text")).where(F.length("text") >= WINDOW).distinct()
    told = sources.select(F.col(source_id).alias("id"), normal(F.col(text)).alias("text")).where(F.length("text") >= WINDOW)
    keys = materialize(_keys(asked, None).join(asked, "id").select(F.col("id").alias("quote_id"), "key", F.col("at").alias("inside"), F.col("text").alias("quote")), "quote-keys")
    met = _keys(told, bitmap(keys, "key")).join(keys, "key").where("at >= inside")
    met = materialize(met.select(F.col("id"), "quote_id", "quote", (F.col("at") - F.col("inside") + 1).alias("begin")).distinct(), "quotes-met")
    found = told.join(met, "id").where(F.substring("text", F.col("begin"), F.length("quote")) == F.col("quote"))
    return found.select(F.col("quote_id").alias(quote_id), F.col("id").alias(source_id)).distinct()


def _told(sources: DataFrame, *more: str) -> DataFrame:
    """Sources (source, more) with ``normal_text``, worked out once for all quotes of a source."""
    return sources.select("source", *more, normal(F.col("text")).alias("normal_text"))


def _stands(quote: Column) -> Column:
    """Whether a quote, of any length but not blank, stands in the ``normal_text`` beside it."""
    return (normal(quote) != "") & F.contains(F.col("normal_text"), normal(quote))


def citation_integrity(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer, citations, valid, integrity) of ``citations(answer, source, sha256, quotes)`` and ``sources(source, text)``.

    A citation is valid if its source exists, has that SHA-256, and holds each
    of its quotes (one at least, none blank). The source is named, so a quote is
    looked for there alone: one join by source, whatever other texts hold it.
    """
    told = _told(sources.withColumn("is", F.sha2(F.col("text").cast("binary"), 256)), "is")
    ok = (F.col("is") == F.col("sha256")) & (F.size("quotes") > 0) & F.forall("quotes", _stands)
    checked = citations.join(told, "source", "left").select("answer", F.coalesce(ok, F.lit(False)).alias("ok"))
    return checked.groupBy("answer").agg(F.count(F.lit(1)).alias("citations"), F.count_if("ok").alias("valid"), F.round(F.count_if("ok") / F.count(F.lit(1)), 6).alias("integrity"))


def claim_problems(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """(claim, problem) of ``claims(claim, text, source, quote)`` and ``sources(source, title, text)``; null if there is none.

    In this order: the source is unknown, the quote has under WINDOW characters,
    it doesn't stand in the source, the claim has a number that neither the
    quote nor the source's title has. Marks like [1, 2] are no part of a claim.
    A quote is looked for in the source that its claim names alone.
    """
    own = numbers(F.regexp_replace("text", r"\[[0-9]+(?:,\s*[0-9]+)*\]", ""))
    support = numbers(F.concat_ws(" ", "quote", "title"))
    told = claims.join(_told(sources, "title"), "source", "left")
    problem = F.when(F.col("title").isNull(), "unknown source").when(F.coalesce(F.length(F.trim("quote")), F.lit(0)) < WINDOW, "no quote")
    stands = (F.length(normal(F.col("quote"))) >= WINDOW) & _stands(F.col("quote"))
    problem = problem.when(~F.coalesce(stands, F.lit(False)), "quote not in source").when(F.size(F.array_except(own, support)) > 0, "number without support")
    return told.select("claim", problem.alias("problem"))
