"""Join forms beyond equality: as-of, fallback, unique link, overlap, anti-overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_last(df: DataFrame, keys: list[str], order: list[str], value: str, when, name: str) -> DataFrame:
    """Adds the latest non-null ``value`` of rows where ``when`` holds, at or before each row: an as-of join without a join."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(F.when(when, F.col(value)), ignorenulls=True).over(w))


def fallback_join(left: DataFrame, right: DataFrame, keys: list[str], row: str, compatible) -> DataFrame:
    """Matches by key that are compatible; for a left row with none of those, all its matches by key."""
    joined = left.join(right, keys).withColumn("_ok", F.coalesce(compatible, F.lit(False)))
    any_ok = F.max("_ok").over(Window.partitionBy(row))
    return joined.withColumn("_any", any_ok).where(F.col("_ok") | ~F.col("_any")).drop("_ok", "_any")


def fallback_alike(left: DataFrame, right: DataFrame, keys: list[str], compatible, by: list[str]) -> DataFrame:
    """``fallback_join`` of each left row by itself.

    ``by`` names the columns of ``left`` that ``compatible`` reads: left rows alike in those and the keys have the same
    matches, so these are found once for all of them, and the rows of the result are not shuffled.
    """
    alike = [*keys, *by]
    joined = left.select(*alike).distinct().join(right, keys).withColumn("_ok", F.coalesce(compatible, F.lit(False)))
    any_ok = F.max("_ok").over(Window.partitionBy(*alike))
    kept = joined.withColumn("_any", any_ok).where(F.col("_ok") | ~F.col("_any")).drop("_ok", "_any")
    null_safe = F.lit(True)
    for c in alike:
        null_safe = null_safe & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return left.alias("l").join(kept.alias("r"), null_safe).select(*(F.col(f"l.{c}") for c in left.columns), *(F.col(f"r.{c}") for c in right.columns if c not in keys))


def unique_link(left: DataFrame, right: DataFrame, keys: list[str], row: str, target: str) -> DataFrame:
    """Each left row with its only match's ``target``, or null and ``ambiguous`` or ``missing``."""
    found = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(target).alias("_t"))
    out = left.join(found, keys, "left")
    status = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").otherwise("linked")
    return out.withColumn("link_status", status).withColumn(target, F.when(F.col("_n") == 1, F.col("_t"))).drop("_n", "_t")


def overlaps(df: DataFrame, keys: list[str], ident: str, start: str, end: str, bin_size: int | None = None) -> DataFrame:
    """(keys, a, b): pairs a < b of one key whose half-open intervals overlap.

    With ``bin_size`` intervals are cut into bins of that length, so a long day
    of one key is split; a pair is kept only in the bin where it first meets.
    """
    if bin_size is None:
        on = [F.col(f"p.{k}") == F.col(f"q.{k}") for k in keys]
        p, q, first = df.alias("p"), df.alias("q"), F.lit(True)
    else:
        cut = df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor((F.greatest(F.col(end) - 1, F.col(start))) / bin_size))))
        p, q = cut.alias("p"), cut.alias("q")
        on = [F.col(f"p.{k}") == F.col(f"q.{k}") for k in [*keys, "_bin"]]
        first = F.col("p._bin") == F.floor(F.greatest(F.col(f"p.{start}"), F.col(f"q.{start}")) / bin_size)
    meet = (F.col(f"p.{ident}") < F.col(f"q.{ident}")) & (F.col(f"p.{start}") < F.col(f"q.{end}")) & (F.col(f"q.{start}") < F.col(f"p.{end}")) & first
    condition = meet
    for c in on:
        condition = condition & c
    return p.join(q, condition).select(*(F.col(f"p.{k}").alias(k) for k in keys), F.col(f"p.{ident}").alias("a"), F.col(f"q.{ident}").alias("b"))


def without_overlap(slots: DataFrame, booked: DataFrame, keys: list[str], start: str, end: str, b_start: str, b_end: str) -> DataFrame:
    """The slots that no booking of the same key overlaps."""
    on = (F.col(f"s.{start}") < F.col(f"b.{b_end}")) & (F.col(f"b.{b_start}") < F.col(f"s.{end}"))
    for k in keys:
        on = on & (F.col(f"s.{k}") == F.col(f"b.{k}"))
    return slots.alias("s").join(booked.alias("b"), on, "left_anti")
