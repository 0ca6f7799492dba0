"""Quality rules whose thresholds come from the corpus.

Each document's measures are taken inside its row. A sketch of a measure counts
documents in bins whose borders grow by the factor GAMMA, so a quantile is known
to that factor; counts of a language and source merge across tasks, sources and
languages by addition and are the same in whatever order rows come. Documents
are joined with the fences of their language and source, in two rounds:

    shape   measures that every document has (mean word length, marks a word
            character): a fence lies REACH times the distance of the quartiles
            beyond each of them, sketched over what passes the base rules.
    tails   shares that are 0 in most documents (symbols, repeated lines,
            repeated words): the fence is the TAIL quantile and as far again
            above the median of the documents where they aren't 0, sketched
            over what is within the shape fences, so that junk does not set it.

No threshold is fixed, and no size of a group changes the rule: a group of n
documents gives its own fence the weight n^2 / (n^2 + PRIOR^2), and the rest to
the fence of its language, which is drawn toward the fence of all likewise.
Where no document has a share there is no fence for it. A spread of 0 in a shape
measure alone is raised, to LEAST.

Defined results
    null, empty or wordless text: no words, all counts 0, base_failed.
    null language or source: a group of its own, like any value.
    null doc_id: measured like any other. Repeated rows: a row each.
    ties with a fence: kept. Extra columns are not read.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, words_col

SYMBOLS = r"[#*$%&|<>]"
#: What is neither letter, digit nor white space.
MARKS = r"[^\p{L}\p{N}\s]"
WINDOW = 3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
REACH, TAIL, LEAST = 4.0, 0.99, 0.001
#: The size at which a group's own fence has half the weight, and the ratio of a bin's borders.
PRIOR, GAMMA = 50, 1.01
#: The bin of 0, below all others.
ZERO = -1_000_000
SHAPE = ["mean_word_chars", "mark_share"]
TAILS = ["symbol_share", "dup_line_share", "repeat_share"]


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row, with its group."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", words_col(F.col("text"))).withColumn("n_words", F.size("words").cast("long"))
    # a window's hash above its place, so that a sort of plain longs brings equal windows together
    mark = F.transform("words", lambda w, i: F.shiftleft(F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)), 31).bitwiseOR(i.cast("long")))
    rows = rows.withColumn("marks", F.sort_array(F.slice(mark, 1, F.greatest(F.size("words") - (WINDOW - 1), F.lit(0)))))
    key = lambda x: F.shiftright(x, 31)
    alike = F.filter("marks", lambda m, i: F.coalesce(key(m) == key(F.get("marks", i - 1)), F.lit(False)) | F.coalesce(key(m) == key(F.get("marks", i + 1)), F.lit(False)))
    rows = rows.withColumn("alike", F.transform(alike, lambda m: m.bitwiseAND(F.lit(2**31 - 1)).cast("int")))
    # the windows whose hashes met, now by their words
    window = lambda p: F.array_join(F.slice("words", p + 1, WINDOW), " ")
    met = F.sort_array(F.transform("alike", lambda p: F.struct(window(p).alias("w"), p.alias("p"))))
    rows = rows.withColumn("met", met)
    twice = F.filter("met", lambda m, i: F.coalesce(m["w"] == F.get("met", i - 1)["w"], F.lit(False)) | F.coalesce(m["w"] == F.get("met", i + 1)["w"], F.lit(False)))
    rows = rows.withColumn("at", F.sort_array(F.transform(twice, lambda m: m["p"])))
    covered = F.aggregate(F.transform("at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda n, x: n + x)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    return rows.select(
        "doc_id", "lang", "source", "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(MARKS)).cast("long").alias("n_marks"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        covered.alias("n_repeat_words"),
    )


def shares(m: DataFrame) -> DataFrame:
    per = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return m.withColumns({"symbol_share": per("n_symbols", "word_chars"), "mark_share": per("n_marks", "word_chars"), "dup_line_share": per("n_dup_lines", "n_lines"), "repeat_share": per("n_repeat_words", "n_words"), "mean_word_chars": per("word_chars", "n_words")})


def bin_of(x) -> F.Column:
    """The bin of a share or mean: GAMMA ** bin is its upper border."""
    return F.when(x > 0, F.ceil(F.round(F.log(x) / math.log(GAMMA), 6))).otherwise(ZERO).cast("int")


def value_of(b) -> F.Column:
    return F.when(b == ZERO, 0.0).otherwise(F.pow(F.lit(GAMMA), b))


def sketch(m: DataFrame, names: list[str], zeros: bool) -> DataFrame:
    """(lang, source, measure, bin, n): the documents in each bin, which add up; without ``zeros`` only where the measure isn't 0."""
    each = F.array(*(F.struct(F.lit(x).alias("measure"), bin_of(F.col(x)).alias("bin")) for x in names))
    rows = m.select("lang", "source", F.inline(each))
    return materialize((rows if zeros else rows.where(F.col("bin") != ZERO)).groupBy("lang", "source", "measure", "bin").agg(F.count(F.lit(1)).alias("n")), "sketches")


def fences(counts: DataFrame, names: list[str], bounds, prior: float = PRIOR) -> DataFrame:
    """(f_lang, f_source, min_x and max_x of each measure x) from merged sketches.

    ``bounds`` gives the lower and upper fence from a function of a quantile.
    """

    def level(keys: list[str], name: str) -> DataFrame:
        merged = counts.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
        of = Window.partitionBy(*keys, "measure")
        placed = merged.withColumn("upto", F.sum("n").over(of.orderBy("bin"))).withColumn("all", F.sum("n").over(of))
        found = placed.groupBy(*keys, "measure").agg(F.max("all").alias("n"), *(value_of(F.min(F.when(F.col("upto") >= p * F.col("all"), F.col("bin")))).alias(f"q{round(100 * p)}") for p in (0.25, 0.5, 0.75, TAIL)))
        low, high = bounds(lambda p: F.col(f"q{round(100 * p)}"))
        return found.select(*keys, "measure", (F.col("n") ** 2 / (F.col("n") ** 2 + prior**2)).alias(f"w_{name}"), low.alias(f"min_{name}"), high.alias(f"max_{name}"))

    same = lambda a, b, keys: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    groups = counts.select("lang", "source").distinct()
    every = groups.join(F.broadcast(level([], "all")))  # a row a measure
    every = every.alias("g").join(level(["lang"], "lang").alias("l"), functools.reduce(operator.and_, same("g", "l", ["lang", "measure"])), "left").select("g.*", "w_lang", "min_lang", "max_lang")
    every = every.alias("g").join(level(["lang", "source"], "own").alias("o"), functools.reduce(operator.and_, same("g", "o", ["lang", "source", "measure"])), "left").select("g.*", "w_own", "min_own", "max_own")

    def drawn(side: str) -> F.Column:
        out = F.col(f"{side}_all")
        for name in ("lang", "own"):
            w = F.coalesce(f"w_{name}", F.lit(0.0))
            out = w * F.coalesce(f"{side}_{name}", F.lit(0.0)) + (1 - w) * out
        return out

    every = every.select("lang", "source", "measure", drawn("min").alias("low"), drawn("max").alias("high"))
    columns = (F.max(F.when(F.col("measure") == x, F.col(c))).alias(f"{side}_{x}") for x in names for side, c in (("min", "low"), ("max", "high")))
    return materialize(every.groupBy(F.col("lang").alias("f_lang"), F.col("source").alias("f_source")).agg(*columns), "fences")


def shape_bounds(q, reach: float = REACH):
    spread = reach * F.greatest(q(0.75) - q(0.25), F.lit(LEAST))
    return q(0.25) - spread, q(0.75) + spread


def tail_bounds(q):
    return F.lit(0.0), 2 * q(TAIL) - q(0.5)


def within(m: DataFrame, f: DataFrame, names: list[str], flag: str) -> DataFrame:
    """``m`` with ``flag``: whether every measure is within its group's fences; true where there are none."""
    inside = F.lit(True)
    for x in names:
        inside = inside & F.coalesce(F.col(x).between(F.col(f"min_{x}"), F.col(f"max_{x}")), F.lit(True))
    joined = m.join(f, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    return joined.withColumn(flag, inside).drop("f_lang", "f_source")


def rate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", reach: float = REACH, prior: float = PRIOR) -> DataFrame:
    """Each row's measures and fences, base_failed, and kept: whether it is within every fence of its group."""
    m = measures(docs, doc_id, text, lang, source)
    m = m.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    m = materialize(shares(m), "measures")
    m = within(m, fences(sketch(m.where("not base_failed"), SHAPE, True), SHAPE, lambda q: shape_bounds(q, reach), prior), SHAPE, "in_shape")
    m = within(m, fences(sketch(m.where("not base_failed and in_shape"), TAILS, False), TAILS, tail_bounds, prior), TAILS, "in_tails")
    return m.withColumn("kept", F.expr("not base_failed and in_shape and in_tails")).withColumnRenamed("doc_id", doc_id)


def select_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, in their own columns; rows of one id and text share their verdict."""
    tag = docs.withColumn("quality_row", F.struct(F.col(doc_id).alias("i"), F.xxhash64(text).alias("h")))
    kept = rate(tag, "quality_row", text, **options).where("kept").select(F.col("quality_row.i").alias("kept_i"), F.col("quality_row.h").alias("kept_h")).distinct()
    return docs.join(kept, docs[doc_id].eqNullSafe(F.col("kept_i")) & F.xxhash64(docs[text]).eqNullSafe(F.col("kept_h")), "left_semi")
