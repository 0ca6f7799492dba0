"""Query rewriting, answer checks and small classifiers."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import sentences, words


def expand(text: Column, rules: list[tuple[str, str]], numbered: list[tuple[str, dict[str, int]]] = ()) -> Column:
    """The text, 'semester n' for each number that a pattern of ``numbered`` finds in it, and the words of every rule whose pattern it matches."""

    def counted(pattern: str, names: dict[str, int]) -> Column:
        number = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
        return F.array_join(F.transform(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1)), lambda w: F.concat(F.lit(" semester "), F.element_at(number, w))), "")

    return F.concat(text, *(counted(p, names) for p, names in numbered), *(F.when(F.lower(text).rlike(p), F.lit(" " + words)).otherwise("") for p, words in rules))


def normalize(text: Column, aliases: dict[str, str]) -> Column:
    """Lower case, Arabic digits as ASCII, aliases as their words, single spaces."""
    out = F.lower(F.translate(text, "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789"))
    for short, full in sorted(aliases.items(), key=lambda x: -len(x[0])):
        out = F.regexp_replace(out, rf"\b{short}\b", full)
    return F.trim(F.regexp_replace(out, "[ \n]+", " "))


def citations(text: Column, n: int) -> Column:
    """The valid citations 1 to n of a text as [1][2], each once."""
    groups = F.regexp_extract_all(text, F.lit(r"\[([0-9, ]+)\]"), F.lit(1))
    numbers = F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, "[, ]+"))), lambda x: x.try_cast("int"))
    return F.array_join(F.transform(F.array_distinct(F.filter(numbers, lambda x: x.between(1, n))), lambda x: F.concat(F.lit("["), x.cast("string"), F.lit("]"))), "")


def norm_title(title: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(title), r"\([^)]*\)", " "), "&", " and ")
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def clock(hour: Column, minute: Column) -> Column:
    h = F.when(hour == 0, 12).when(hour > 12, hour - 12).otherwise(hour)
    return F.format_string("%d:%02d %s", h, minute, F.when(hour < 12, "AM").otherwise("PM"))


def ordinal(n: Column) -> Column:
    end = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def all_match(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (text.rlike(p) for p in patterns), F.lit(True))


def any_match(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns), F.lit(False))


def extract(text: Column, asked: Column, keep: int, most: int) -> Column:
    """Short texts whole; of longer ones the ``keep`` sentences with most asked words, in order, cut at ``most``."""
    s = F.transform(sentences(text), lambda x, i: F.struct((-F.size(F.array_intersect(words(x), asked))).alias("k"), i.alias("i"), x.alias("x")))
    best = F.slice(F.array_sort(s), 1, keep)
    picked = F.array_join(F.transform(F.array_sort(F.transform(best, lambda b: F.struct(b["i"].alias("i"), b["x"].alias("x")))), lambda b: b["x"]), " ")
    return F.when(F.length(text) <= most, text).otherwise(F.left(picked, F.lit(most)))


def _lcs(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def rouge_l(df: DataFrame, keys: list[str], text: str, reference: str, most: int = 2000) -> DataFrame:
    """(keys, f1) of the longest common word sequence; texts over ``most`` words are measured by their first ones, as the measure is defined."""

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            p, q = list(x)[:most], list(y)[:most]
            n = _lcs(p, q)
            out.append(2 * n / (len(p) + len(q)) if n else 0.0)
        return pd.Series(out)

    return df.select(*keys, score(words(F.col(text)), words(F.col(reference))).alias("f1"))


def fix_mojibake(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of UTF-8 that were read as Windows-1252 set right; others as they are."""

    def line(x: str) -> str:
        try:
            return x.encode("cp1252").decode("utf-8") if any(c in x for c in "ÃÂâ") else x
        except (UnicodeEncodeError, UnicodeDecodeError):
            return x

    @F.pandas_udf("string")
    def fix(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else "\n".join(map(line, t.split("\n"))))

    return df.select(key, fix(text).alias(text))


def naive_bayes(df: DataFrame, key: str, label: str, features: str, n: int) -> DataFrame:
    """(key, label): the likeliest label by binary features with add-one smoothing, trained on the table itself."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), *(F.sum(F.get(features, F.lit(k))).alias(f"_f{k}") for k in range(n)))
    total = counts.agg(F.sum("_n").alias("_total"))
    model = counts.crossJoin(F.broadcast(total)).withColumnRenamed(label, "_label")  # one row
    models = model.groupBy().agg(F.collect_list(F.struct("*")).alias("_models"))  # one row of a struct a label
    rows = df.select(key, features).crossJoin(F.broadcast(models)).select(key, features, F.inline("_models"))
    score = F.log(F.col("_n") / F.col("_total"))
    for k in range(n):
        score = score + F.log(F.when(F.get(features, F.lit(k)) == 1, F.col(f"_f{k}") + 1).otherwise(F.col("_n") - F.col(f"_f{k}") + 1) / (F.col("_n") + 2))
    return rows.groupBy(key).agg(F.max_by("_label", F.struct(F.round(score, 9), -F.col("_label"))).alias(label))


def hash_embed(df: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """(key, at, value): a unit vector of signed word hashes, non-zero places only."""
    found = df.select(key, F.explode(words(F.col(text))).alias("w"))
    h = F.sha2("w", 256)
    at = (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dim).cast("int")
    sign = F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    v = found.groupBy(key, at.alias("at")).agg(F.sum(sign).alias("v")).where("v <> 0")
    length = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return v.select(key, "at", F.round(F.col("v") / length, 6).alias("value"))
