"""Differences between versions: keys, fields, overlays, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def version_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """(added, removed, unchanged): sizes of the set differences and the intersection of whole rows."""
    side = old.distinct().withColumn("_side", F.lit(1)).unionByName(new.distinct().withColumn("_side", F.lit(2)))
    seen = side.groupBy(*old.columns).agg(F.sum("_side").alias("_s"))
    n = lambda s: F.count_if(F.col("_s") == s)
    return seen.agg(n(2).alias("added"), n(1).alias("removed"), n(3).alias("unchanged"))


def classify_changes(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, change, changed): new, gone, changed or unchanged, with the names of the fields that differ."""
    o = old.select(*keys, F.struct(*fields).alias("_o"))
    n = new.select(*keys, F.struct(*fields).alias("_n"))
    differs = F.array_compact(F.array(*(F.when(~F.col(f"_o.{f}").eqNullSafe(F.col(f"_n.{f}")), F.lit(f)) for f in fields)))
    both = o.join(n, keys, "full")
    changed = F.when(F.col("_o").isNotNull() & F.col("_n").isNotNull(), differs).otherwise(F.array().cast("array<string>"))
    change = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "gone").when(F.size(differs) > 0, "changed").otherwise("unchanged")
    return both.select(*keys, change.alias("change"), changed.alias("changed"))


def overlay(base: DataFrame, edited: DataFrame, removed: DataFrame, added: DataFrame, key: str) -> DataFrame:
    """``base`` less ``removed``, with the non-null fields of ``edited``, plus ``added``."""
    fields = [c for c in base.columns if c != key]
    patch = edited.select(key, *(F.col(c).alias(f"_{c}") if c in edited.columns else F.lit(None).alias(f"_{c}") for c in fields))
    kept = base.join(removed.select(key), key, "left_anti").join(patch, key, "left")
    return kept.select(key, *(F.coalesce(f"_{c}", c).alias(c) for c in fields)).unionByName(added)


def orphans(base: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Patches whose row is not in ``base``."""
    return patches.join(base.select(key), key, "left_anti")


def conflicts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, values): keys with more than one distinct non-null value, sorted."""
    found = df.groupBy(*keys).agg(F.sort_array(F.collect_set(value)).alias("values"))
    return found.where(F.size("values") > 1)
