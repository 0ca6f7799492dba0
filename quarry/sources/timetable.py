"""Timetables as JSON documents: read into entries, and searched.

A document is parsed once into nested arrays; what its slots need of its courses
is looked up within the row, so nothing is shuffled. A document that is no such
JSON gives one row that says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = """courses array<struct<course_code:string,course_title:string,abbreviation:string,program_semester:string,instructors:array<string>>>,
schedule_slots array<struct<course_code:string,course_title:string,day:string,room:string,time_slot:string>>, _corrupt string"""
# Roman numbers of semesters, number words in a question, words that say nothing in one, and the days.
ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6, "VII": 7, "VIII": 8}
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9}
FILLERS = ["what", "is", "the", "time", "table", "for", "when", "in", "class", "classes", "course"]
DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
SECTIONS = {"R": "Regular", "S": "Self-Support"}


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def entries(documents: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, corrupt, code, day, start, end, room, section, instructor, title, semester, abbreviation): a row a slot.

    Of several courses of one code the last counts. Without a time a slot is at
    TBA, without an instructor by TBA; R and S in brackets name sections.
    """
    parsed = documents.select(key, F.from_json(F.col(raw), SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"}).alias("j"))
    broken = F.col("j").isNull() | F.col("j._corrupt").isNotNull()

    def row(slot: Column) -> Column:
        course = F.try_element_at(F.filter(F.coalesce("j.courses", F.array().cast("array<struct<course_code:string,course_title:string,abbreviation:string,program_semester:string,instructors:array<string>>>")), lambda c: c["course_code"] == slot["course_code"]), F.lit(-1))
        times = F.split(F.coalesce(slot["time_slot"], F.lit("00:00-00:00")), "-")
        clock = lambda k: F.when(F.size(times) == 2, F.get(times, F.lit(k))).otherwise("TBA")
        named = F.regexp_extract(slot["course_title"], r"\(([^()]*)\)[^(]*$", 1)
        semester = F.regexp_extract(course["program_semester"], r"Semester\s+(\S+)", 1)
        return F.struct(
            slot["course_code"].alias("code"), slot["day"].alias("day"), clock(0).alias("start"), clock(1).alias("end"), slot["room"].alias("room"),
            F.when(F.coalesce(named, F.lit("")) == "", "Regular").otherwise(F.coalesce(F.element_at(_map(SECTIONS), named), named)).alias("section"),
            F.coalesce(F.get(course["instructors"], F.lit(0)), F.lit("TBA")).alias("instructor"), F.coalesce(course["course_title"], slot["course_title"], slot["course_code"]).alias("title"),
            F.coalesce(F.element_at(_map(ROMAN), semester), semester.try_cast("int")).alias("semester"), F.coalesce(F.trim(F.regexp_replace(course["abbreviation"], r"\s*\([RS]\)\s*", "")), F.lit("")).alias("abbreviation"),
        )

    rows = F.when(broken, F.slice(F.transform(F.array(F.struct(*(F.lit(None).cast("string").alias(c) for c in ("course_code", "course_title", "day", "room", "time_slot")))), row), 1, 0)).otherwise(F.transform("j.schedule_slots", row))
    return parsed.select(key, broken.alias("corrupt"), F.inline_outer(rows)).where(F.col("corrupt") | F.col("code").isNotNull())


def questions(asked: DataFrame, query: str, text: str) -> DataFrame:
    """(query, day, code, semester, tokens) of each question."""
    q = F.lower(text)
    none = lambda c: F.nullif(c, F.lit(""))
    number = none(F.regexp_extract(q, r"\bsemester\s+([0-9]+|one|two|three|four|five|six|seven|eight|nine)\b", 1))
    words = F.split(F.regexp_replace(q, rf"\b({'|'.join(FILLERS)})\b", " "), r"\s+")
    return asked.select(
        query, none(F.regexp_extract(q, rf"\b({'|'.join(DAYS)})\b", 1)).alias("q_day"), F.upper(none(F.regexp_extract(q, r"\b([a-z]{2,5}-[0-9]{3,4}[a-z]?)\b", 1))).alias("q_code"),
        F.coalesce(F.element_at(_map(NUMBERS), number), number.try_cast("int")).alias("q_semester"), F.array_distinct(F.filter(words, lambda w: F.length(w) > 1)).alias("tokens"),
    )


def search(found: DataFrame, asked: DataFrame, query: str) -> DataFrame:
    """(query, rule, code, day, start, section): the entries that each of ``questions`` means, once each.

    An entry fits by the code (rule 1); else, if a semester is named, by that
    alone (2); else by the day, if only a day is named (3); else by the words of
    title, code, instructor and abbreviation, all but one of which must hold (4).
    A named day must be the entry's as well. Codes, semesters and days meet by
    equi-joins, words by their first two letters, so no question meets all entries.
    Questions that ask the same are answered once and joined with what they got.
    """
    same = F.sha2(F.to_json(F.struct("q_day", "q_code", "q_semester", "tokens")), 256)
    by_text = asked.select(query, same.alias("_same"))
    asked = asked.select(same.alias("_same"), "q_day", "q_code", "q_semester", "tokens").dropDuplicates(["_same"])
    e = found.where(~F.col("corrupt")).select("code", "day", "start", "section", "semester", F.lower(F.concat_ws(" ", "title", "code", "instructor", "abbreviation")).alias("held")).distinct()
    columns = ["_same", "rule", "code", "day", "start", "section"]
    own_day = F.col("q_day").isNull() | F.contains(F.lower("day"), F.col("q_day"))
    only_day = F.coalesce((F.size("tokens") == 1) & (F.get("tokens", F.lit(0)) == F.col("q_day")), F.lit(False))
    q = asked.withColumn("only_day", only_day)
    rule = lambda df, n: df.where(own_day).withColumn("rule", F.lit(n)).select(columns)
    by_code = rule(q.where("q_code is not null").join(e, F.col("q_code") == F.col("code")), 1)
    by_semester = rule(q.where("q_semester is not null").join(e, F.col("q_semester") == F.col("semester")), 2)
    days = e.withColumn("named", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("day"), F.lit("[a-z]+"), F.lit(0)))))
    by_day = rule(q.where("q_semester is null and only_day").join(days, F.col("q_day") == F.col("named")), 3)
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("held") - 1, F.lit(1))), lambda i: F.substring("held", i, F.lit(2))))
    texts = e.select("held").distinct().withColumn("pair", F.explode(pairs))
    open_ = q.where("q_semester is null and not only_day").withColumn("pair", F.explode(F.array_distinct(F.transform("tokens", lambda w: F.left(w, F.lit(2))))))
    n = F.size(F.filter("tokens", lambda w: F.contains(F.col("held"), w)))
    met = open_.join(texts, "pair").where((n > 0) & (n >= F.size("tokens") - 1)).drop("pair").distinct()
    by_words = rule(met.join(e, "held"), 4)
    every = by_code.union(by_semester).union(by_day).union(by_words)
    found = every.groupBy("_same", "code", "day", "start", "section").agg(F.min("rule").alias("rule"))
    return by_text.join(found, "_same").select(query, "code", "day", "start", "section", "rule")


