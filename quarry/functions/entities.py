"""What a text names: numbers in figures and words, course rows, a student's courses, near names."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import materialize
from . import text as tx

# Number words in order, the tens from twenty on, and the digits of two other scripts.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
OTHER_DIGITS = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩"
VALUES = {w: n for n, w in enumerate(UNITS)} | {w: 20 + 10 * n for n, w in enumerate(TENS)}
SCALES = {"hundred": 100, "thousand": 1000}
# Kinds of courses in a scheme of studies.
COURSE_KINDS = ["GE", "CC", "DC", "DE", "MS", "ES"]
COURSE_ROW = rf"^\s*([A-Z]{{2,4}}-[0-9]{{3}}):?\s+(.+?)\s+(?:{'|'.join(COURSE_KINDS)})\s+([0-9])(?:\+([0-9]))?\s*$"
# How a student says that a course is done, failed or going on; the group holds the courses.
STATUS = {
    "completed": [
        r"(?:i|i've|ive|i have)\s+(?:already\s+)?(?:passed|completed|finished|done|cleared|taken)\s+([^.,;?!]+)",
        r"(?:i|i've|ive|i have)\s+(?:successfully\s+)?(?:passed|completed)\s+([^.,;?!]+)",
        r"(?:i|i've|ive|i have)\s+(?:already\s+)?done\s+(?:with\s+)?([^.,;?!]+)",
        r"(?:i|i've|ive|i have)\s+(?:already\s+)?(?:taken|studied)\s+(?:and passed\s+)?([^.,;?!]+)",
        r"(?:i|i've|ive)\s+(?:got|gotten|received)\s+(?:a\s+)?[a-cA-C][\+\-]?\s+in\s+([^.,;?!]+)",
        r"([A-Z\-\s\d]+)\s+(?:is|was)\s+(?:already\s+)?(?:passed|completed|done|finished|cleared)",
        r"([A-Z\-\s\d]+)\s+(?:has been|was)\s+(?:successfully\s+)?(?:completed|passed)",
    ],
    "failed": [
        r"(?:i|i've|ive|i have)\s+(?:failed|flunked)\s+([^.,;?!]+)",
        r"(?:i|i've|ive)\s+(?:didn't|didnt|did not)\s+pass\s+([^.,;?!]+)",
        r"(?:i|i've|ive)\s+(?:couldn't|couldnt|could not)\s+(?:pass|clear)\s+([^.,;?!]+)",
        r"(?:i|i've|ive)\s+(?:got|gotten|received)\s+(?:an?\s+)?[fFdD][\+\-]?\s+in\s+([^.,;?!]+)",
        r"([A-Z\-\s\d]+)\s+(?:is|was)\s+(?:failed|not passed)",
        r"([A-Z\-\s\d]+)\s+(?:has been|was)\s+(?:failed)",
    ],
    "in_progress": [
        r"(?:i|i'm|im|i am)\s+(?:currently\s+)?(?:taking|studying|enrolled in|doing)\s+([^.,;?!]+)",
        r"(?:i|i'm|im|i am)\s+(?:currently\s+)?(?:in|attending)\s+([^.,;?!]+)",
        r"(?:i|i'm|im|i am)\s+(?:currently\s+)?(?:registered for)\s+([^.,;?!]+)",
        r"(?:this semester|this term),?\s+(?:i|i'm|im|i am)\s+(?:taking|studying|doing)\s+([^.,;?!]+)",
        r"(?:i|i'm|im|i am)\s+(?:taking|studying|doing)\s+([^.,;?!]+)\s+(?:this semester|this term|right now)",
        r"([A-Z\-\s\d]+)\s+(?:is|are)\s+(?:my\s+)?(?:current|ongoing)\s+(?:course|class)",
    ],
}


def numbers(text: Column) -> Column:
    """The numbers of a text, sorted: figures of three scripts without thousands separators, and number words up to 'ninety nine' or so many hundreds or thousands."""
    value = F.translate(text, OTHER_DIGITS, "0123456789" * 2)
    figures = F.transform(F.regexp_extract_all(value, F.lit("[0-9]+(?:[.,][0-9]+)*"), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit("")))
    words = F.regexp_extract_all(F.lower(value), F.lit("[a-z]+"), F.lit(0))
    known = F.create_map(*(F.lit(x) for pair in VALUES.items() for x in pair))
    scales = F.create_map(*(F.lit(x) for pair in SCALES.items() for x in pair))

    def spoken(here: Column, after: Column) -> Column:
        scale, unit = F.element_at(scales, after), F.element_at(known, after)
        return F.when(scale.isNotNull(), here * scale).when((here >= 20) & (unit < 10), here + unit).otherwise(here)

    found = tx.let(words, lambda ws: F.transform(ws, lambda w, i: F.when(w.isin(list(VALUES)), spoken(F.element_at(known, w), F.get(ws, i + 1)))))
    said = F.filter(found, lambda n: n.isNotNull())
    return F.sort_array(F.array_union(figures, F.transform(said, lambda n: n.cast("string"))))


def course_rows(text: Column) -> Column:
    """(code, title, lecture, lab, total) of each line of a text that is a row of a scheme of studies."""
    part = lambda line, g: F.regexp_extract(line, COURSE_ROW, g)

    def row(line: Column) -> Column:
        lecture, lab = part(line, 3).cast("int"), F.coalesce(part(line, 4).try_cast("int"), F.lit(0))
        return F.struct(part(line, 1).alias("code"), part(line, 2).alias("title"), lecture.alias("lecture"), lab.alias("lab"), (lecture + lab).alias("total"))

    return F.transform(F.filter(F.split(text, "\n"), lambda line: line.rlike(COURSE_ROW)), row)


#: How patterns begin that take a whole run of letters, digits, spaces and hyphens, and what holds them to its first
#: place: no later one can match where that one does not, and looking at each takes the square of the run's length.
RUN, FROM_START = r"([A-Z\-\s\d]+)", r"(?:\G|(?<![A-Z\-\s\d]))"


def course_status(text: Column) -> Column:
    """struct<failed, in_progress, completed>: the codes a student names so; what is failed is nothing else, what goes on is not completed."""

    def named(t: Column, status: str) -> Column:
        held = [(FROM_START if p.startswith(RUN) else "") + p for p in STATUS[status]]
        said = F.flatten(F.array(*(F.regexp_extract_all(t, F.lit("(?i)" + p), F.lit(1)) for p in held)))
        return F.array_distinct(F.flatten(F.transform(F.array_distinct(said), tx.codes)))

    def of(f: Column) -> Column:
        going = F.array_except(f["in_progress"], f["failed"])
        done = F.array_except(F.array_except(f["completed"], f["failed"]), f["in_progress"])
        return F.struct(F.sort_array(f["failed"]).alias("failed"), F.sort_array(going).alias("in_progress"), F.sort_array(done).alias("completed"))

    return tx.let(tx.let(F.lower(text), lambda t: F.struct(*(named(t, status).alias(status) for status in STATUS))), of)


def nearest_name(asked: DataFrame, names: DataFrame, query: str, item: str, least: float = 0.6) -> DataFrame:
    """(query, item, ratio): for each ``asked(query, text)`` the most similar of ``names(item, name)`` that share a word with it, if the ratio of
    matching characters reaches ``least``; ties go to the lesser item.

    Equal texts are compared once, with the least item of each name; pairs whose lengths or letters rule ``least`` out are not matched up.
    """
    told = asked.select(query, F.lower("text").alias("_text"))
    owner = names.select(F.lower("name").alias("_name"), item).groupBy("_name").agg(F.min(item).alias(item))
    words = lambda df, *kept: df.select(*kept, F.explode(F.array_distinct(tx.words(F.col(kept[0])))).alias("word"))
    fits = 2 * F.least(F.length("_text"), F.length("_name")) >= F.lit(least) * (F.length("_text") + F.length("_name")) - 1e-6
    met = words(told.select("_text").distinct(), "_text").join(words(owner, "_name", item), "word").where(fits).drop("word").distinct()

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        def of(x: str, y: str) -> float:
            match = difflib.SequenceMatcher(None, x, y)
            return match.ratio() if match.quick_ratio() >= least else 0.0  # never below the ratio

        return pd.Series([of(x, y) for x, y in zip(a, b)], dtype="float64")

    scored = met.select("_text", item, ratio("_text", "_name").alias("ratio")).where(F.col("ratio") >= least)
    best = scored.groupBy("_text").agg(F.min(F.struct((-F.col("ratio")).alias("less"), F.col(item).alias("item"))).alias("b"))
    return told.join(best, "_text").select(query, F.col("b.item").alias(item), F.round(-F.col("b.less"), 6).alias("ratio"))


def _found(text: Column, shortest: int, skip: list[str]) -> Column:
    """The words of a text that count, each once."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0)), lambda w: (F.length(w) >= shortest) & ~w.isin(skip)))


def _meet(asked: DataFrame, names: DataFrame, query: str, item: str, shortest: int, skip: list[str], most: int):
    """(own, said, classes): words of one name with it; for each text its words of one name (``own``), its words that several have (``common``)
    and whether it says a word that none has; and names alike in the words that they share, with their number and their ``most`` least items."""
    held = names.select(item, _found(F.col("name"), shortest, skip).alias("held"))
    by_word = held.select(item, F.explode("held").alias("word"))
    owners = by_word.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(item).alias(item))
    own = owners.where("n = 1").select("word", item)
    of_name = own.groupBy(item).agg(F.collect_list("word").alias("_own"))  # as many as the name has
    none = F.array().cast("array<string>")
    shared = held.join(of_name, item, "left").select(item, F.array_sort(F.array_except("held", F.coalesce("_own", none))).alias("shared")).where(F.size("shared") > 0)
    least = F.row_number().over(Window.partitionBy("shared").orderBy(item))
    sizes = shared.groupBy("shared").agg(F.count(F.lit(1)).alias("n"))
    firsts = shared.withColumn("_k", least).where(F.col("_k") <= most).groupBy("shared").agg(F.array_sort(F.collect_list(item)).alias("items"))
    words = asked.select(query, F.explode(_found(F.col("text"), shortest, skip)).alias("word")).join(owners.select("word", "n"), "word", "left")
    pick = lambda when: F.collect_set(F.when(when, F.col("word")))
    said = words.groupBy(query).agg(pick(F.col("n") == 1).alias("own"), F.array_sort(pick(F.col("n") > 1)).alias("common"), F.bool_or(F.col("n").isNull()).alias("unknown"))
    return own, said, sizes.join(firsts, "shared")


def _alike(said: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """(common, both, n, items): classes of names that share ``least`` words with texts, each different ``common`` once.

    They meet by all words but ``least`` - 1 of a text's, which loses none.
    """
    texts = said.select("common").where(F.size("common") >= least).distinct()
    by = texts.select("common", F.explode(F.slice("common", 1, F.size("common") - (least - 1))).alias("word"))
    met = by.join(classes.select("shared", F.explode("shared").alias("word")), "word").select("common", "shared").distinct()
    return met.withColumn("both", F.size(F.array_intersect("common", "shared"))).where(F.col("both") >= least).join(classes, "shared").drop("shared")


def people(asked: DataFrame, names: DataFrame, query: str, item: str, most: int = 3) -> DataFrame:
    """(query, item, score): the ``most`` best of ``names(item, name)`` for each ``asked(query, text)``.

    A word of a name counts two if no other name has it, else one; a name needs a word of its own or three shared ones.
    Texts meet names by words of one owner, and classes of names alike in their shared words by those; of a class no
    more than its ``most`` least items can be among the best, as all of them score alike but those met by a word of
    their own. Ties go to the lesser item. Null texts and names have no words; items are unique.
    """
    own, said, classes = _meet(asked, names, query, item, 3, tx.TITLE_WORDS, most)
    held = names.select(item, _found(F.col("name"), 3, tx.TITLE_WORDS).alias("held"))
    hit = said.select(query, "common", F.explode("own").alias("word")).join(own, "word").groupBy(query, item).agg(F.count(F.lit(1)).cast("int").alias("n"), F.first("common").alias("common"))
    hit = hit.join(held, item).select(query, item, (2 * F.col("n") + F.size(F.array_intersect("common", "held"))).alias("score"))
    alike = _alike(said, classes, 3).select("common", F.explode("items").alias(item), F.col("both").alias("score"))
    best = Window.partitionBy("common").orderBy(F.desc("score"), item)
    alike = alike.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= most).drop("_rank")
    every = hit.unionByName(said.select(query, "common").join(alike, "common").select(query, item, "score"))
    met = every.groupBy(query, item).agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), item))
    return met.withColumn("_rank", rank).where(F.col("_rank") <= most).select(query, item, "score")


def partial_names(asked: DataFrame, names: DataFrame, query: str, item: str, skip: list[str], most: int = 2) -> DataFrame:
    """(query, item): the names that hold all of a text's words of four letters or more, if it has two such words and ``most`` names fit at most.

    A text with a word of one owner fits that name alone, if any; others are held against classes of names alike in the
    words that they share. A word in no name fits none; null texts and names have no words; items are unique.
    """
    own, said, classes = _meet(asked, names, query, item, 4, skip, most)
    held = names.select(item, _found(F.col("name"), 4, skip).alias("held"))
    full = said.where(~F.col("unknown") & (F.size("own") + F.size("common") >= 2))
    one = full.where(F.size("own") > 0).withColumn("word", F.get("own", F.lit(0))).join(own, "word").join(held, item)
    one = one.where((F.size(F.array_except("own", "held")) == 0) & (F.size(F.array_except("common", "held")) == 0)).select(query, item)
    open_ = full.where(F.size("own") == 0)
    fits = _alike(open_, classes, 2).where(F.col("both") == F.size("common"))
    few = fits.groupBy("common").agg(F.sum("n").alias("n"), F.flatten(F.collect_list(F.when(F.col("n") <= most, F.col("items")))).alias("items")).where(F.col("n") <= most)
    return one.unionByName(open_.select(query, "common").join(few, "common").select(query, F.explode("items").alias(item)))


def text_diff(df: DataFrame, keys: list[str], old: str, new: str, most: int = 2000) -> DataFrame:
    """(keys, diff, truncated): the unified line diff of two texts, of ``most`` lines at most, as the report is defined."""

    @F.pandas_udf("array<string>")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([list(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), "old", "new", n=3, lineterm="")) for x, y in zip(a, b)])

    made = df.select(*keys, diff(old, new).alias("diff"))
    return made.select(*keys, F.slice("diff", 1, most).alias("diff"), (F.size("diff") > most).alias("truncated"))


def mentions(docs: DataFrame, names: DataFrame, doc: str, text: str, entity: str, lead: int = 4) -> DataFrame:
    """(doc, entity, start, length): where a name of ``names(entity, name)`` stands in a text, in words.

    Names meet the texts by an equi-join on their first word, then by their first ``lead`` words if they have more; the
    rest of such a name is then compared with the text. Longer names take their words first, then earlier ones; words taken
    are in no other mention. That is decided within each stretch of overlapping names by itself. A name of several
    entities is a mention of each. ``doc`` is unique; null texts and names have no words.
    """
    told = names.select(entity, tx.words(F.col("name")).alias("words")).where("size(words) > 0")
    known = told.groupBy("words").agg(F.sort_array(F.collect_set(entity)).alias("entities"))
    known = known.select(F.get("words", F.lit(0)).alias("first"), F.array_join(F.slice("words", 1, lead), " ").alias("phrase"), F.size("words").alias("length"), F.array_join("words", " ").alias("whole"), "entities")
    known = materialize(known, "names")  # the planner then knows its size
    runs = lambda ws: F.transform(ws, lambda w, i: F.struct(i.alias("start"), w.alias("first"), F.array_join(F.slice(ws, i + 1, lead), " ").alias("run")))
    placed = docs.select(doc, F.inline(tx.let(tx.words(F.col(text)), runs))).join(known.select("first").distinct(), "first", "left_semi")
    parts = F.split("run", " ")
    begun = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), " "))
    found = placed.select(doc, "start", F.explode(begun).alias("phrase")).join(known.drop("first"), "phrase")
    short = found.where(F.col("length") <= lead).select(doc, "start", "length", "entities")
    long = found.where(F.col("length") > lead).join(docs.select(doc, tx.words(F.col(text)).alias("words")), doc)
    long = long.where(F.array_join(F.slice("words", F.col("start") + 1, F.col("length")), " ") == F.col("whole")).select(doc, "start", "length", "entities")
    place = Window.partitionBy(doc).orderBy("start", F.desc("length"))
    ends = F.max(F.col("start") + F.col("length")).over(place.rowsBetween(Window.unboundedPreceding, -1))
    every = short.unionByName(long).withColumn("_open", F.when(F.col("start") >= F.coalesce(ends, F.lit(0)), 1).otherwise(0))
    every = every.withColumn("_stretch", F.sum("_open").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    each = every.groupBy(doc, "_stretch").agg(F.array_sort(F.collect_list(F.struct((-F.col("length")).alias("less"), "start", "length", "entities"))).alias("m"))
    first = F.slice("m", 1, 0)

    def take(taken, x):
        free = ~F.exists(taken, lambda y: (y["start"] < x["start"] + x["length"]) & (x["start"] < y["start"] + y["length"]))
        return F.when(free, F.concat(taken, F.array(x))).otherwise(taken)

    chosen = each.select(doc, F.inline(F.aggregate("m", first, take)))
    return chosen.select(doc, F.explode("entities").alias(entity), "start", "length")


def grounded(answer: Column, evidence: Column) -> Column:
    """The sentences of an answer whose acronyms, course numbers and titled names all stand in the evidence."""
    number = lambda s: F.regexp_extract_all(s, F.lit("[A-Z]{2,4}[- ]?([0-9]{3})"), F.lit(1))
    acronym = lambda s: F.regexp_extract_all(s, F.lit("(?:^|[^A-Za-z0-9])([A-Z]{2,6})(?:$|[^A-Za-z0-9-])"), F.lit(1))
    person = lambda s: F.regexp_extract_all(s, F.lit("(?:Dr|Prof|Mr|Ms|Mrs|Engr)[.]? ([A-Z][A-Za-z]{2,})"), F.lit(1))
    held = lambda found: F.forall(found, lambda x: F.contains(evidence, x))
    return F.filter(tx.sentences(answer), lambda s: held(number(s)) & held(acronym(s)) & held(person(s)))
