"""Multinomial naive Bayes over word n-grams, its model a sparse table of what each label was seen with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..store import materialize

#: Most labels: each document gets a score for each, in a row of its own.
LABELS = 1000


def ngrams(words: Column, most: int = 2) -> Column:
    """Words and runs of up to ``most`` words, repeats included."""

    def of(ws: Column) -> Column:
        run = lambda n: F.transform(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - (n - 1), F.lit(0))), lambda w, i: F.concat_ws(" ", w, *(F.get(ws, i + k) for k in range(1, n))))
        return F.concat(ws, *(run(n) for n in range(2, most + 1)))

    return let(words, of)


def train(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The model (label, gram, weight) and the labels (label, prior, absent) of ``rows(label, grams)``.

    With add-one smoothing a gram adds ln((n + 1) / (N + V)): ``weight`` is
    ln(n + 1) of grams seen with the label, ``absent`` is -ln(N + V) for any
    gram. Rows without a label or grams teach nothing but the prior.
    """
    known = rows.where("label is not null")
    seen = materialize(known.select("label", F.explode("grams").alias("gram")).groupBy("label", "gram").agg(F.count(F.lit(1)).alias("n")), "grams")
    grams = seen.select("gram").distinct().count()
    docs = known.groupBy("label").agg(F.count(F.lit(1)).alias("docs"))
    every = known.count()
    size = seen.groupBy("label").agg(F.sum("n").alias("size"))
    labels = docs.join(size, "label", "left").select("label", F.log(F.col("docs") / every).alias("prior"), (-F.log(F.coalesce("size", F.lit(0)) + F.lit(max(grams, 1)))).alias("absent"))
    return seen.select("label", "gram", F.log(F.col("n") + 1).alias("weight")), labels


def predict(rows: DataFrame, model: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(key, label, confidence): the label of the highest score of each of ``rows(key, grams)``, of equal ones the least, and its softmax share.

    A gram that no label knows counts against all alike, by the size of each.
    """
    every = labels.collect()
    if len(every) > LABELS:
        raise ValueError(f"{len(every)} labels; scores are laid out for {LABELS} at most")
    if not every:
        return rows.select(key, F.lit(None).cast(labels.schema["label"].dataType).alias("label"), F.lit(None).cast("double").alias("confidence"))
    met = rows.select(key, F.explode("grams").alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("n"))
    gained = met.join(model, "gram").groupBy(key, "label").agg(F.sum(F.col("n") * F.col("weight")).alias("gained"))
    table = F.array(*(F.struct(F.lit(r["label"]).alias("label"), F.lit(r["prior"]).alias("prior"), F.lit(r["absent"]).alias("absent")) for r in every))
    base = rows.select(key, F.size("grams").alias("total"), F.inline(table))
    scored = base.join(gained, [key, "label"], "left").withColumn("score", F.round(F.col("prior") + F.col("total") * F.col("absent") + F.coalesce("gained", F.lit(0.0)), 6))
    top = scored.groupBy(key).agg(F.max("score").alias("best"), F.min(F.struct((-F.col("score")).alias("less"), "label")).alias("m"))
    share = scored.join(top, key).groupBy(key).agg(F.first("m.label").alias("label"), F.sum(F.exp(F.col("score") - F.col("best"))).alias("all"))
    return share.select(key, "label", F.round(1 / F.col("all"), 4).alias("confidence"))
