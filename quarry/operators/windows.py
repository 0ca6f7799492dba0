"""Ranking and sequence operators: latest rows, de-duplication, islands, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in this order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], version: str, keep_first: list[str] | None = None) -> DataFrame:
    """``current`` with the newest change of each key; columns in ``keep_first`` hold their first non-null value."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    old = Window.partitionBy(*keys).orderBy("_new", version)
    whole = old.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for c in keep_first or []:
        both = both.withColumn(c, F.first(c, ignorenulls=True).over(whole))
    return first_per(both, keys, [F.desc("_new"), F.desc(version)]).drop("_new")


def keyed_upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str, insert_only: list[str]) -> DataFrame:
    """``current`` after each change in ``order``: a new key is inserted, a known one updated but for ``insert_only``.

    So ``insert_only`` columns are those of a key's first row and all others those of its last, nulls included; rows
    of ``changes`` come after all of ``current``. One aggregation, combined before the shuffle, however often a key
    comes. ``order`` is unique in a key and a table; columns that ``changes`` has beyond ``current`` are not read.
    """
    latest = [c for c in current.columns if c not in keys and c not in insert_only]
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.select(*current.columns).withColumn("_new", F.lit(1)))
    at = F.struct("_new", order)
    made = both.groupBy(*keys).agg(F.min_by(F.struct(*insert_only), at).alias("_first"), F.max_by(F.struct(*latest), at).alias("_last"))
    return made.select(*keys, "_first.*", "_last.*").select(*current.columns)


def replace_children(children: DataFrame, parents: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``children`` with all rows of the keys in ``parents`` taken out and the rows of ``new`` put in; a parent without new rows loses its own."""
    return children.join(parents.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def islands(df: DataFrame, keys: list[str], start: str, end: str, gap: float = 0) -> DataFrame:
    """Intervals of a key merged where the next starts less than ``gap`` after all before have ended (0: touching merge)."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) - reach > gap), 1).otherwise(0)
    marked = df.withColumn("_open", opens).withColumn("_island", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n_merged")).drop("_island")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) with the total and whether more follow; the total is one aggregate, not a window over all rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.crossJoin(F.broadcast(total)).withColumn("has_next", F.col("total") > number * size)  # one row


def keep_first_duplicate(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """One row for each value of ``key``, the first in this order."""
    return first_per(df.withColumn("_key", key), ["_key"], order).drop("_key")
