"""Licence notices by Dice coefficient over word bigrams.

A text is normalised (lower case; ASCII letters and digits make words, so line
breaks inside a notice do not matter) and compared with the licence templates:
Dice = 2 |common bigrams| / (|unit| + |template|) over distinct bigrams. A Dice
of t needs (t / (2 - t)) of a template's bigrams in the text, so a template
with fewer is pruned. For the others a unit is a window of words that begins
at one of the template's bigrams and has its length, or STRETCH times less or
more. Units are taken from left to right: one that overlaps the last one taken
takes its place if it is better, and falls if not.

A text that meets a template is cut into segments of SEGMENT places, each with
what the longest window needs beyond it, so a row that a window is cut from is
short however long the text is, and texts take time in proportion to length.

The templates are a fixed list of a few dozen rows, and are broadcast as such.

Defined results
    null, empty or wordless text: no unit, no match. A text of one word has no
    bigram and matches nothing. Ties: the earlier unit; of those with one
    beginning the better, then the shorter, then the least licence name. null doc_id: scanned; repeated rows: a row each.
    Extra columns aren't read. Very long texts: segments of them; the units of a text are put in order in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD, STRETCH = 0.8, 1.25
#: Places of a text that a row holds, before what their windows reach beyond them.
SEGMENT = 256

#: Licence name and the usual wording of its notice.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD", "Released under the BSD License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "Licensed under the GNU General Public License, version 3."),
    ("GPL", "Released under the GNU General Public License v3.0."),
    ("LGPL", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
]


def normal_words(text) -> F.Column:
    return F.array_remove(F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " +"), "")


def pairs(words) -> F.Column:
    """The bigrams of a word array, in order."""
    both = F.transform(words, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))
    return F.slice(both, 1, F.greatest(F.size(words) - 1, F.lit(0)))


def templates(spark: SparkSession, rows=TEMPLATES) -> DataFrame:
    """(template, license, n words, grams, size)"""
    t = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(rows)], "template int, license string, body string")
    t = t.withColumn("words", normal_words(F.col("body")))
    return t.select("template", "license", F.size("words").alias("n"), F.array_distinct(pairs(F.col("words"))).alias("grams")).withColumn("size", F.size("grams"))


def matches(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text", rows=TEMPLATES) -> DataFrame:
    """(doc_id, row, start, end, license, template, dice): the units that count, in words."""
    known = templates(docs.sparkSession, rows)
    grams = sorted({g for r in known.select("grams").collect() for g in r["grams"]})
    share = threshold / (2 - threshold)
    texts = docs.where(F.col(text).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), normal_words(F.col(text)).alias("words"))
    # explode(array(x)) keeps an expression from being moved into the next ones and evaluated anew there
    texts = texts.select("row", "doc_id", F.explode(F.array(pairs(F.col("words")))).alias("g"))
    texts = texts.where(F.exists("g", lambda g: g.isin(grams)))
    widest = known.agg(F.coalesce(F.max(F.floor(F.col("n") * STRETCH)), F.lit(0))).first()[0]
    cut = F.transform(F.sequence(F.lit(0), F.size("g") - 1, F.lit(SEGMENT)), lambda k: F.struct(k.alias("offset"), F.slice("g", k + 1, F.lit(SEGMENT + int(widest))).alias("g")))
    texts = texts.select("row", "doc_id", F.inline(cut))
    places = F.filter(F.transform("g", lambda g, i: F.when(g.isin(grams), i)), lambda i: i.isNotNull())
    texts = texts.select("row", "doc_id", "offset", "g", F.explode(F.array(places)).alias("at")).where(F.coalesce(F.get("at", F.lit(0)) < SEGMENT, F.lit(False)))
    texts = texts.withColumn("met", F.array_distinct(F.transform("at", lambda i: F.get("g", i))))
    every = known.agg(F.collect_list(F.struct("template", "license", "n", "grams", "size")).alias("every"))  # one row
    texts = texts.crossJoin(F.broadcast(every))
    fits = F.filter("every", lambda t: F.size(F.array_intersect("met", t["grams"])) >= t["size"] * share)
    texts = texts.select("row", "doc_id", "offset", "g", "at", F.explode(fits).alias("t"))
    starts = F.filter("at", lambda i: (i < SEGMENT) & F.array_contains("t.grams", F.get("g", i)))
    n = F.col("t.n")
    lengths = F.array_distinct(F.array(F.ceil(n / STRETCH).cast("int"), n, F.floor(n * STRETCH).cast("int")))
    units = texts.select("row", "doc_id", "offset", "g", "t", F.explode(starts).alias("start"), lengths.alias("lengths")).withColumn("length", F.explode("lengths"))
    units = units.select("row", "doc_id", "t", (F.col("offset") + F.col("start")).alias("start"), F.explode(F.array(F.slice("g", F.col("start") + 1, F.col("length") - 1))).alias("unit"))
    units = units.select("row", "doc_id", "t", "start", (F.col("start") + F.size("unit") + 1).alias("end"), F.explode(F.array(F.array_distinct("unit"))).alias("unit"))
    dice = 2 * F.size(F.array_intersect("unit", "t.grams")) / (F.size("unit") + F.col("t.size"))
    units = units.select("row", "doc_id", "start", "end", "t.license", "t.template", dice.alias("dice")).where(F.col("dice") >= threshold)
    # the units of one text by place; the last of ``taken`` is the only one that the next can overlap
    kind = "struct<start:int,less:double,end:int,license:string,template:int>"
    ordered = F.sort_array(F.collect_set(F.struct("start", (-F.col("dice")).alias("less"), "end", "license", "template").cast(kind)))
    each = units.groupBy("row", "doc_id").agg(ordered.alias("u"))

    def take(s, x):
        last = s["last"]
        apart = last.isNull() | (x["start"] >= last["end"])
        taken = F.when(apart & last.isNotNull(), F.concat(s["taken"], F.array(last))).otherwise(s["taken"])
        return F.struct(taken.alias("taken"), F.when(apart | (x["less"] < last["less"]), x).otherwise(last).alias("last"))

    state = lambda taken, last: F.struct(taken.cast(f"array<{kind}>").alias("taken"), last.cast(kind).alias("last"))

    def some(s, part):
        """``part`` taken up in an array of its own, so the long one is added to once for all of it."""
        one = F.aggregate(part, state(F.array(), s["last"]), take)
        return F.get(F.transform(F.array(one), lambda x: state(F.concat(s["taken"], x["taken"]), x["last"])), F.lit(0))

    parts = F.transform(F.sequence(F.lit(0), F.size("u") - 1, F.lit(SEGMENT)), lambda k: F.slice("u", k + 1, SEGMENT))
    found = each.select("row", "doc_id", F.inline(F.aggregate(parts, state(F.array(), F.lit(None)), some, lambda s: F.concat(s["taken"], F.array(s["last"])))))
    return found.select(F.col("doc_id").alias(doc_id), "row", "start", "end", "license", "template", (-F.col("less")).alias("dice"))


def scan(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text", rows=TEMPLATES) -> DataFrame:
    """(doc_id, licenses, best, best_dice, n_units) of each row with a match."""
    found = matches(docs, threshold, doc_id, text, rows)
    per = found.groupBy("row", doc_id).agg(F.array_sort(F.collect_set("license")).alias("licenses"), F.min(F.struct((-F.col("dice")).alias("d"), F.col("license").alias("l"))).alias("top"), F.count(F.lit(1)).alias("n_units"))
    return per.select(doc_id, "licenses", F.col("top.l").alias("best"), F.round(-F.col("top.d"), 6).alias("best_dice"), "n_units")
