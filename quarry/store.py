"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).

    Where it is unset, a temporary one serves a local session; on a cluster
    that would be a folder of one machine, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/quarry-{tag}-{uuid.uuid4().hex[:12]}"
    _written[path] = spark
    return path


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.pop(path, None)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, so a lost executor costs no recomputation of what came
    before, and gives the planner the true size, so it broadcasts only what
    is under its threshold.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes the files of materialized tables that nothing will read again."""
    for df in tables:
        remove(df.sparkSession, df.written_to)


@atexit.register
def _clean() -> None:
    for path, spark in list(_written.items()):
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the session is gone; the job's shared folder goes with it
            return
