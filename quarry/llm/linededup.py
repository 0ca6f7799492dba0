"""Boilerplate lines by their spread over sites.

A line's spread is the number of distinct sites it stands on. A HyperLogLog
sketch of sites for each line hash merges by aggregation, so a line in a third
of all documents costs a sketch a task. Lines whose estimate is near the
threshold get an exact distinct count. Lines over the threshold are cut from
every document.

Lines are compared by their 128-bit hash after trimming of spaces and
lower-casing; lines of fewer than ``min_chars`` code points
are never boilerplate.

Defined results
    null or empty text: no lines; the text stays as it is.
    null site: counts as no site. null doc_id: cleaned like any other.
    repeated rows: a row each; a line repeated on one site counts once.
    spread equal to the threshold: cut. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MIN_SITES, MIN_CHARS, LG_K = 10, 20, 12
#: Estimates within this share of the threshold are counted exactly (over ten standard errors at LG_K 12).
BAND = 0.2


def line_key(line) -> F.Column:
    """128 bits of a normalised line as a binary."""
    return F.unhex(F.md5(F.lower(F.trim(line))))


def lines_of(docs: DataFrame, text: str = "text", site: str = "source", min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, site): one row for each line of min_chars code points of each text."""
    rows = docs.select(F.col(site).cast("string").alias("site"), F.explode(F.split(F.col(text), "\n")).alias("line"))
    return rows.where(F.length(F.trim("line")) >= min_chars).select(line_key(F.col("line")).alias("key"), "site")


def boilerplate(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, lg_k: int = LG_K, band: float = BAND) -> DataFrame:
    """(key): the lines that stand on ``min_sites`` sites at least."""
    lines = lines_of(docs, text, site, min_chars).where("site is not null")
    spread = lines.groupBy("key").agg(F.hll_sketch_agg("site", lg_k).alias("sketch")).select("key", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = materialize(spread.where(F.col("sites") >= min_sites * (1 - band)), "spread")
    sure = spread.where(F.col("sites") > min_sites * (1 + band)).select("key")
    near = spread.where(F.col("sites") <= min_sites * (1 + band)).select("key")
    exact = lines.join(near, "key").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("key")
    return materialize(sure.union(exact), "boilerplate")


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_cut, text) of each row, the text without boilerplate lines."""
    cut = boilerplate(docs, text, site, min_sites, min_chars)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(text).alias("h"))
    # the boilerplate keys of each document that has any
    seen = rows.select("doc_id", "h", F.explode(F.split("text", "\n")).alias("line")).where(F.length(F.trim("line")) >= min_chars)
    seen = seen.select("doc_id", "h", line_key(F.col("line")).alias("key")).join(cut, "key").distinct()
    mine = seen.groupBy(F.col("doc_id").alias("d2"), F.col("h").alias("h2")).agg(F.collect_list("key").alias("keys"))
    joined = rows.join(mine, F.col("doc_id").eqNullSafe(F.col("d2")) & F.col("h").eqNullSafe(F.col("h2")), "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x: (F.length(F.trim(x)) < min_chars) | ~F.array_contains("keys", line_key(x)))
    out = joined.withColumn("lines", lines).withColumn("left", F.when(F.col("keys").isNull(), F.col("lines")).otherwise(kept))
    return out.select(
        F.col("doc_id").alias(doc_id),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines") - F.size("left")).cast("long").alias("n_cut"),
        F.when(F.col("text").isNotNull(), F.array_join("left", "\n")).alias("text"),
    )
