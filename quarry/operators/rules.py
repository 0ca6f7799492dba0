"""Academic rules and value parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def semester_load(credits: Column, approved: Column) -> Column:
    """15 to 18 is normal; 12 to 21 needs an approval."""
    return F.when(credits.between(15, 18), "normal").when(credits.between(12, 21) & approved, "approved").when(credits < 15, "under").otherwise("over")


def progression(mean: Column, used: Column) -> Column:
    """Under 1 ends studies; under 2 is probation, three times at most."""
    return F.when(mean < 1, "dropped").when(mean < 2, F.when(used < 3, "probation").otherwise("dropped")).otherwise("good")


def weighted_mean(df: DataFrame, key: str, weight: str, value: str, least: float, most: float, pairs: int = 40) -> DataFrame:
    """Sum of weight x value over the sum of weights, halves rounded up at two places; weights outside (least, most] don't count."""
    ok = df.where((F.col(weight) > least) & (F.col(weight) <= most))
    dec = lambda c: c.cast("decimal(18,6)")
    out = ok.groupBy(key).agg(F.sum(F.col(weight) * F.col(value)).alias("_s"), F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_n"))
    return out.where(F.col("_n") <= pairs).select(key, F.round(dec(F.col("_s")) / dec(F.col("_w")), 2).cast("double").alias("mean"))


def fee_cell(cell: Column) -> list[Column]:
    """amount and kind: a number, a formula in words, or nothing charged."""
    plain = F.regexp_replace(F.trim(cell), "[,\\s]|Rs\\.?", "")
    number = plain.try_cast("long")
    kind = F.when(cell.isNull() | plain.isin("", "-", "nil"), "none").when(number.isNull(), "formula").otherwise("number")
    return [number.alias("amount"), kind.alias("kind")]


def credits(text: Column) -> list[Column]:
    """'3', '3+1' or '4(3+1)' as total, lecture and lab."""
    lec = F.coalesce(F.regexp_extract(text, r"(\d+)\s*\+\s*\d+", 1).try_cast("int"), F.regexp_extract(text, r"^(\d+)", 1).try_cast("int"))
    lab = F.coalesce(F.regexp_extract(text, r"\d+\s*\+\s*(\d+)", 1).try_cast("int"), F.lit(0))
    return [(lec + lab).alias("total"), lec.alias("lecture"), lab.alias("lab")]


def term_key(term: Column) -> Column:
    """'Fall 2026' as a number that sorts by year, then Spring, Summer, Fall."""
    season = F.lower(F.regexp_extract(term, "(?i)(spring|summer|fall)", 1))
    return F.regexp_extract(term, "([0-9]{4})", 1).try_cast("int") * 10 + F.when(season == "spring", 1).when(season == "summer", 2).when(season == "fall", 3)
