"""Versioned Parquet builds with a manifest and a pointer to the current one.

A build is written whole, then its manifest (rows and a checksum for each part
file, which the order of rows doesn't change), and last the pointer. A load
works the checksums out again from the files, so damage, loss or a stray file
shows before anything is answered from the build.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def parts(df: DataFrame) -> DataFrame:
    """(file, n, checksum) of the files a table is read from; a file without rows isn't listed."""
    row = F.xxhash64(*(F.to_json(F.struct(c)) if t.startswith("map") else F.col(c) for c, t in df.dtypes))
    return df.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("checksum"))


def publish(df: DataFrame, root: str, build: str) -> None:
    """Writes ``build`` and its manifest and then names it as the current one; readers see the old or the new build, whole."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{root}/build={build}")
    parts(spark.read.parquet(f"{root}/build={build}")).write.mode("overwrite").json(f"{root}/manifests/{build}")
    spark.createDataFrame([(build,)], "build string").coalesce(1).write.mode("overwrite").text(f"{root}/_next")
    fs, pointer = _fs(spark, f"{root}/_CURRENT")
    fs.delete(pointer, True)
    fs.rename(_fs(spark, f"{root}/_next")[1], pointer)


def problems(spark: SparkSession, root: str, build: str) -> DataFrame:
    """(file, problem): files of a build that are missing, not in its manifest, or differ from it."""
    was = spark.read.schema("file string, n long, checksum string").json(f"{root}/manifests/{build}")
    now = parts(spark.read.parquet(f"{root}/build={build}"))
    both = was.alias("a").join(now.alias("b"), "file", "full")
    problem = F.when(F.col("b.n").isNull(), "missing").when(F.col("a.n").isNull(), "unknown").when((F.col("a.n") != F.col("b.n")) | (F.col("a.checksum") != F.col("b.checksum")), "differs")
    return both.select("file", problem.alias("problem")).where("problem is not null")


def current(spark: SparkSession, root: str, checked: bool = True) -> DataFrame:
    """The current build; with ``checked``, ValueError if any of its files has a problem or can't be read."""
    name = spark.read.text(f"{root}/_CURRENT").first()["value"]
    if checked:
        try:
            bad = problems(spark, root, name).limit(5).collect()
        except Exception as why:
            raise ValueError(f"build {name} can't be read") from why
        if bad:
            raise ValueError(f"build {name}: {', '.join(f'{r.file} {r.problem}' for r in bad)}")
    return spark.read.parquet(f"{root}/build={name}")


def builds(spark: SparkSession, root: str) -> list[str]:
    """The names of all builds, the oldest by name first."""
    fs, path = _fs(spark, root)
    return sorted(s.getPath().getName().removeprefix("build=") for s in fs.listStatus(path) if s.getPath().getName().startswith("build="))


def prune(spark: SparkSession, root: str, keep: int = 3) -> list[str]:
    """Removes all but the last ``keep`` builds by name, never the current one; returns the names removed."""
    now = spark.read.text(f"{root}/_CURRENT").first()["value"]
    gone = [b for b in reversed(builds(spark, root)[: -keep or None]) if b != now]
    for b in gone:
        for path in (f"{root}/build={b}", f"{root}/manifests/{b}"):
            fs, p = _fs(spark, path)
            fs.delete(p, True)
    return gone


def checksum(df: DataFrame, columns: list[str]) -> str:
    """A hash of the rows that their order does not change."""
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
    return f"{row[0]}-{row[1] or 0}"
