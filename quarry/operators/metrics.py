"""Index percentiles, classification and retrieval metrics."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import materialize


def index_percentiles(df: DataFrame, keys: list[str], value: str, percents: dict[str, float], parts: int = 64) -> DataFrame:
    """sorted[min(n - 1, floor(n * p))] of each key: an element, never interpolated.

    Equal values are one row with a count. A mergeable sketch splits each key's values into ``parts`` runs of about
    equal size, whose exact counts tell the run that holds each element; only those runs are put in order, each by
    itself, so no task orders a whole key. The sketch decides the cuts alone and the result is exact whatever they are.
    The cuts are written down, since a sketch merged in another order, as when it is read twice, may cut elsewhere.
    Nulls are left out; a key of nulls only has no row.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    cuts = F.array_distinct(F.percentile_approx(value, [k / parts for k in range(1, parts)], 16 * parts))
    split = materialize(counted.groupBy(*keys).agg(F.sum("_c").alias("_n"), cuts.alias("_cuts")), "cuts")
    placed = counted.join(split, keys).withColumn("_run", F.size(F.filter("_cuts", lambda x: x < F.col(value)))).drop("_cuts")
    runs = placed.groupBy(*keys, "_run").agg(F.sum("_c").alias("_held"), F.first("_n").alias("_n"))
    runs = runs.withColumn("_before", F.sum("_held").over(Window.partitionBy(*keys).orderBy("_run")) - F.col("_held"))  # at most ``parts`` rows a key
    at = {name: F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(p))) for name, p in percents.items()}
    met = functools.reduce(operator.or_, (place.between(F.col("_before"), F.col("_before") + F.col("_held") - 1) for place in at.values()))
    near = placed.drop("_n").join(runs.where(met), [*keys, "_run"])
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_run").orderBy(value))
    ranked = near.withColumn("_upto", upto)
    return ranked.groupBy(*keys).agg(*(F.max(F.when(place.between(F.col("_upto") - F.col("_c"), F.col("_upto") - 1), F.col(value))).alias(name) for name, place in at.items()))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(df: DataFrame, actual: str, predicted: str, digits: int = 6) -> DataFrame:
    """(label, tp, precision, recall, f1) of every label seen or predicted; 0 where undefined."""
    c = confusion(df, actual, predicted)
    a = c.groupBy(F.col(actual).alias("label")).agg(F.sum("n").alias("n_actual"), F.sum(F.when(F.col(actual) == F.col(predicted), F.col("n")).otherwise(0)).alias("tp"))
    p = c.groupBy(F.col(predicted).alias("label")).agg(F.sum("n").alias("n_predicted"))
    m = a.join(p, "label", "full").na.fill(0)
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    precision, recall = ratio(F.col("tp"), F.col("n_predicted")), ratio(F.col("tp"), F.col("n_actual"))
    f1 = ratio(2 * precision * recall, precision + recall)
    return m.select("label", "tp", F.round(precision, digits).alias("precision"), F.round(recall, digits).alias("recall"), F.round(f1, digits).alias("f1"))


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, query_id: str, item: str, rank: str, k: int) -> DataFrame:
    """(query, p_at_k, recall, rr, hit) for 1-based ranks; precision has k as its denominator."""
    hits = ranked.where(F.col(rank) <= k).join(relevant.select(item).distinct().withColumn("_rel", F.lit(1)), item, "left")
    total = relevant.select(item).distinct().agg(F.count(F.lit(1)).alias("_total"))
    out = hits.groupBy(query_id).agg(F.count("_rel").alias("_hits"), F.min(F.when(F.col("_rel") == 1, F.col(rank))).alias("_first")).crossJoin(F.broadcast(total))  # one row
    return out.select(query_id, F.round(F.col("_hits") / k, 6).alias("p_at_k"), F.round(F.col("_hits") / F.col("_total"), 6).alias("recall"), F.coalesce(F.round(1 / F.col("_first"), 6), F.lit(0.0)).alias("rr"), (F.col("_hits") > 0).alias("hit"))
