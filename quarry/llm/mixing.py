"""Mixing sources to target weights.

The corpus is a tree of levels (domain, language, source by default). A budget
of tokens goes down it by weights. A child can take no more than the tokens of
its leaves without a weight of 0 on their path, times the epochs allowed; what it can't take goes to its siblings by their
weights, and only what a whole family can't take goes to the families above.
With children in order of capacity / weight the level at which the rest share
is found from running sums, so a level needs one window over its nodes.

A leaf's budget b of t tokens is b // t whole epochs and then a prefix of the
next: each epoch has a seeded order of its own, and a document is in the
prefix if the tokens up to its end fit. Running sums go through hash ranges of
a leaf (range totals first, then within ranges), so no task orders a leaf.

Defined results
    null level value: a node of its own. Node without a weight: weight
    ``default`` (0 drops it). Budget over all capacity: everything, as often as
    allowed. Integer divisions round down, so a leaf may miss a few tokens.
    null or empty text: 0 tokens; copies as its leaf's whole epochs. null
    doc_id: kept, ordered by its text. Repeated rows: one row each, ordered
    like ties, by text. Extra columns are passed by ``select_rows``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, words_col

RANGES = 256
#: Rows a range of a leaf is meant to hold at most.
RANGE_ROWS = 100_000


def leaves(docs: DataFrame, levels: list[str], tokens: str = "tokens") -> DataFrame:
    """(levels..., docs, tokens): the totals of each leaf."""
    return docs.groupBy(*levels).agg(F.count(F.lit(1)).alias("docs"), F.sum(tokens).cast("long").alias("tokens"))


def _same(a: str, b: str, names: list[str]):
    on = F.lit(True)
    for x in names:
        on = on & F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{x}"))
    return on


def budgets(totals: DataFrame, levels: list[str], weights: DataFrame, budget: int, epochs: int, default: int = 1) -> DataFrame:
    """(levels..., docs, tokens, share): the tokens each leaf is to give.

    ``weights`` has (path string, weight long): a node's path is its values
    from the top, joined by "/"; null is written "null".
    """
    name = lambda k: F.concat_ws("/", *(F.coalesce(F.col(x).cast("string"), F.lit("null")) for x in levels[:k]))
    given = F.lit(int(budget)).cast("long")
    # a node can give what its leaves can that have no weight of 0 on their path: capacities go up before budgets go down
    tree = totals.withColumns({"share": given, "usable": F.col("tokens")})
    for depth in range(1, len(levels) + 1):
        of = weights.select(F.col("path").alias("of"), F.col("weight").alias("of_weight"))
        tree = tree.join(of, name(depth) == F.col("of"), "left").withColumn("usable", F.when(F.coalesce(F.col("of_weight"), F.lit(default)) > 0, F.col("usable")).otherwise(F.lit(0))).drop("of", "of_weight")
    for depth in range(1, len(levels) + 1):
        node = tree.groupBy(*levels[:depth]).agg(F.sum("usable").alias("node_tokens"), F.min("share").alias("given")).withColumn("path", name(depth))
        node = node.join(weights.select("path", "weight"), "path", "left").withColumn("w", F.coalesce(F.col("weight"), F.lit(default)).cast("long"))
        node = node.withColumn("cap", F.when(F.col("w") > 0, F.col("node_tokens") * epochs).otherwise(F.lit(0)).cast("long"))
        family = Window.partitionBy(*levels[: depth - 1]) if depth > 1 else Window.partitionBy(F.lit(0))  # the nodes under one parent
        node = node.withColumn("ratio", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(-1.0)))
        upto = family.orderBy("ratio", "path").rowsBetween(Window.unboundedPreceding, 0)
        node = node.withColumns({"cap_upto": F.sum("cap").over(upto), "w_upto": F.sum("w").over(upto), "w_all": F.sum("w").over(family)})
        # full if sharing at this child's own level would still leave tokens over
        dec = lambda x: F.col(x).cast("decimal(38,0)")
        full = dec("cap_upto") * F.col("w").cast("decimal(10,0)") + dec("cap") * (F.col("w_all") - F.col("w_upto")).cast("decimal(10,0)") <= dec("given") * F.col("w").cast("decimal(10,0)")
        node = node.withColumn("full", full | (F.col("w") <= 0))
        node = node.withColumns({"cap_full": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(F.lit(0))).over(family), "w_rest": F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("w"))).over(family)})
        rest = F.expr("(cast(given - cap_full as decimal(28,0)) * cast(w as decimal(10,0))) div cast(w_rest as decimal(20,0))")
        node = node.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), rest.cast("long"))))
        below = node.select(*levels[:depth], "share")
        tree = tree.drop("share").alias("t").join(below.alias("n"), _same("t", "n", levels[:depth])).select("t.*", "n.share")
    return tree.drop("usable")


def mix(docs: DataFrame, weights: DataFrame, budget: int | None = None, epochs: int = 2, seed: int = 1, levels: tuple[str, ...] = ("domain", "lang", "source"), doc_id: str = "doc_id", text: str = "text", default: int = 1, part: float = 1.0) -> DataFrame:
    """The rows of ``docs`` with tokens, share and copies: how often each is taken (0: not).

    ``budget`` None asks for ``part`` of all the tokens there are.
    """
    levels = list(levels)
    rows = docs.withColumn("tokens", F.size(words_col(F.col(text))).cast("long"))
    small = rows.select(*levels, F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), "tokens")
    small = materialize(small, "tokens")
    totals = materialize(leaves(small, levels), "leaves")
    if budget is None:
        budget = int((totals.agg(F.sum("tokens")).first()[0] or 0) * part)
    plan = materialize(budgets(totals, levels, weights, budget, epochs, default), "budgets")
    plan = plan.withColumn("whole", F.least(F.lit(epochs), F.expr("coalesce(share div nullif(tokens, 0), 0)")).cast("long"))
    plan = plan.withColumn("left", F.col("share") - F.col("whole") * F.col("tokens"))
    most = totals.agg(F.max("docs")).first()[0] or 0
    ranges = max(RANGES, -(-most // RANGE_ROWS))

    # each leaf's documents in the seeded order of the epoch that is cut short
    p = plan.select(*levels, "share", "whole", "left")
    s = small.alias("s").join(p.alias("p"), _same("s", "p", levels)).select("s.*", "p.share", "p.whole", "p.left")
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    s = s.withColumn("o", order).withColumn("range", F.expr(f"cast(conv(substr(o, 1, 8), 16, 10) as long) * {ranges} div 4294967296"))
    s = materialize(s, "ordered")
    of_range = s.groupBy(*levels, "range").agg(F.sum("tokens").alias("t"))
    before = Window.partitionBy(*levels).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most ``ranges`` rows
    of_range = of_range.withColumn("before", F.coalesce(F.sum("t").over(before), F.lit(0)))
    within = Window.partitionBy(*levels, "range").orderBy("o", "h").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("in_range", F.sum("tokens").over(within))
    s = s.alias("s").join(of_range.alias("r"), _same("s", "r", [*levels, "range"])).select("s.*", (F.col("s.in_range") + F.col("r.before")).alias("upto"))
    copies = F.col("whole") + F.when((F.col("whole") < epochs) & (F.col("upto") <= F.col("left")) & (F.col("left") > 0), F.lit(1)).otherwise(F.lit(0))
    return s.select(*levels, "doc_id", "h", "tokens", "share", copies.cast("long").alias("copies")).withColumnRenamed("doc_id", doc_id)


def select_rows(docs: DataFrame, weights: DataFrame, budget: int | None = None, epochs: int = 1, seed: int = 1, levels: tuple[str, ...] = ("domain", "lang", "source"), doc_id: str = "doc_id", text: str = "text", columns: list[str] | None = None, part: float = 1.0) -> DataFrame:
    """The rows taken, each as often as it is taken, in ``columns`` (all of them by default)."""
    columns = columns or docs.columns
    taken = mix(docs, weights, budget, epochs, seed, levels, doc_id, text, part=part).where("copies > 0")
    taken = taken.select(F.col(doc_id).alias("taken_id"), F.col("h").alias("taken_h"), F.col("copies").alias("taken_copies"))
    taken = taken.groupBy("taken_id", "taken_h").agg(F.max("taken_copies").alias("taken_copies"))
    on = docs[doc_id].eqNullSafe(taken["taken_id"]) & F.xxhash64(docs[text]).eqNullSafe(taken["taken_h"])
    out = docs.join(taken, on)
    if epochs > 1:
        out = out.withColumn("taken_copy", F.explode(F.sequence(F.lit(1), F.col("taken_copies"))))
    return out.select(*(docs[c] for c in columns))
