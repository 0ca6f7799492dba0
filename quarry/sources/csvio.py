"""CSV import with header aliases and row errors, and export that spreadsheets can't run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clock_minutes, csv_safe

# Names that headers go by.
ALIASES = {"day": ["day", "weekday"], "start": ["start", "from", "begins"], "end": ["end", "to", "ends"], "room": ["room", "venue"], "code": ["code", "course_code", "course"], "teacher": ["teacher", "instructor"]}
DAYS = ["MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY"]


def read(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """The file with canonical column names, all strings; the separator is told from the header."""
    if sep is None:
        head = spark.read.text(path).first()
        line = head["value"] if head else ""
        sep = max(";\t,", key=line.count)
    raw = spark.read.option("header", True).option("sep", sep).option("escape", '"').csv(path)
    names = {alias: name for name, all_of in ALIASES.items() for alias in all_of}
    return raw.select(*(F.col(f"`{c}`").alias(names.get(c.lower().strip("\ufeff ").replace(" ", "_"), c)) for c in raw.columns))


def registry(spark: SparkSession, path: str, key: str, names: Column | None = None) -> DataFrame:
    """A registry with a header, all strings, a row for each key: cells may hold quotes, separators and line breaks.

    Rows without a key are left out. ``names`` turns the key into what others go by (default: as it is). Of several
    rows of one key the greatest counts, column by column, so neither the order of files nor a repeated task matters.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    rows = raw.where(F.coalesce(F.trim(key), F.lit("")) != "").withColumn(key, F.trim(key) if names is None else names)
    rest = [c for c in raw.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(*rest)).alias("_row")).select(key, "_row.*")


def validate(rows: DataFrame) -> DataFrame:
    """Adds start_min, end_min and errors; a row is good if it has no error."""
    has = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    day = F.upper(F.trim("day"))
    start, end = clock_minutes(F.col("start")), clock_minutes(F.col("end"))
    rules: list[tuple[Column, str]] = [(day.isin(DAYS), "day"), (start.isNotNull(), "start"), (end.isNotNull(), "end"), (F.coalesce(end > start, F.lit(True)), "order"), (has(F.col("room")), "room"), (has(F.col("code")), "code")]
    errors = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in rules)))
    return rows.withColumns({"start_min": start, "end_min": end, "errors": errors})


def write(df: DataFrame, path: str) -> None:
    text = [c for c, t in df.dtypes if t == "string"]
    df.withColumns({c: csv_safe(F.col(c)) for c in text}).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
