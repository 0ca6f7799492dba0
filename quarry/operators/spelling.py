"""Near words by a deletion index.

Two words within ``edits`` edits have a form in common once each has lost up to
that many of its first PREFIX letters: of the letters of one prefix that have no
partner in the other there are at most as many as edits. So near words meet by
an equi-join on forms, and the edit distance is worked out for those alone; no
word is compared with the whole vocabulary. A word has PREFIX * (PREFIX + 1) / 2
+ 1 forms at most for two edits, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a word that its forms are made of.
PREFIX = 10


def vocabulary(texts: DataFrame, words: Column) -> DataFrame:
    """(word, freq) of all texts."""
    return texts.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def forms(word: Column, edits: int) -> Column:
    """The word's first letters with up to ``edits`` of them out, each form once."""

    def shorter(found: Column) -> Column:
        out = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.left(w, i - 1), F.substring(w, i + 1, F.length(w))))
        return F.array_distinct(F.flatten(F.transform(F.filter(found, lambda w: w != ""), out)))

    level = F.array(F.left(word, F.lit(PREFIX)))
    every = level
    for _ in range(edits):
        level = shorter(level)
        every = F.array_union(every, level)
    return every


def near_words(asked: DataFrame, words: DataFrame, edits: int = 2) -> DataFrame:
    """(asked, word, freq, distance): the words of ``words(word, freq)`` within ``edits`` edits of each distinct word of ``asked(asked)``.

    A form that many words share is one key of the join's larger side; lengths
    and the edit distance are tested inside the join, so no more pairs than are
    near leave it.
    """
    by = lambda df, w: df.select("*", F.explode(forms(F.col(w), edits)).alias("form"))
    fits = (F.abs(F.length("asked") - F.length("word")) <= edits) & (F.levenshtein("asked", "word", edits) >= 0)
    met = by(asked.select("asked").where("asked is not null").distinct(), "asked").join(by(words.where("word is not null"), "word"), "form").where(fits)
    found = met.select("asked", "word", "freq").distinct()
    return found.withColumn("distance", F.levenshtein("asked", "word").cast("int"))


def corrections(asked: DataFrame, words: DataFrame, edits: int = 2, least: float = 0.8) -> DataFrame:
    """(asked, fix, distance, confidence, sure) of each asked word that the vocabulary lacks and that has a near word in it.

    The fix is the near word of the highest 1 / (distance + 1) x ln(freq + 1) / 5,
    1 at most; of equal ones the nearer, then the first by name. ``sure`` is whether it reaches ``least``.
    """
    unknown = asked.select("asked").distinct().join(words.select(F.col("word").alias("asked")), "asked", "left_anti")
    near = near_words(unknown, words, edits)
    raw = F.round(1 / (F.col("distance") + 1) * (F.log(F.col("freq") + 1) / 5), 9)
    best = near.withColumn("raw", raw).groupBy("asked").agg(F.min(F.struct((-F.col("raw")).alias("less"), "distance", "word")).alias("b"))
    confidence = F.least(-F.col("b.less"), F.lit(1.0))
    return best.select("asked", F.col("b.word").alias("fix"), "b.distance", F.round(confidence, 6).alias("confidence"), (confidence >= least).alias("sure"))
