"""A content-addressed object store: each distinct content is one file, named by its SHA-256.

Contents are reduced to one row each by aggregation before anything is written,
so a content that a third of all rows share is one write. A task writes to a
name of its own in ``tmp`` and moves the file to its place; what is there
already is left alone, and moving equal content over itself changes nothing. So
a repeated or lost attempt leaves either the object or a file in ``tmp``, which
the end of ``put`` clears. Paths are what pyarrow's file systems open.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import materialize


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def put(rows: DataFrame, root: str, content: str, ext: str = "") -> DataFrame:
    """(sha256, bytes, rows, stored) of each distinct content; ``stored`` is whether the store didn't have it before. Null and empty contents are no objects (Spark's readers pass over files without bytes)."""
    data = F.col(content).cast("binary")
    objects = rows.where(F.octet_length(data) > 0).groupBy(sha256(data).alias("sha256")).agg(F.first(data).alias("data"), F.count(F.lit(1)).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(root)
        for batch in batches:
            stored = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                place = posixpath.join(base, "objects", name[:2], name + ext)
                new = store.get_file_info(place).type == fs.FileType.NotFound
                if new:
                    temporary = posixpath.join(base, "tmp", uuid.uuid4().hex)
                    for folder in (posixpath.dirname(temporary), posixpath.dirname(place)):
                        store.create_dir(folder, recursive=True)
                    with store.open_output_stream(temporary) as out:
                        out.write(data.as_buffer())
                    store.move(temporary, place)
                stored.append(new)
            sizes = pa.array([len(x.as_buffer()) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, batch.column(2), pa.array(stored, pa.bool_())], names=["sha256", "bytes", "rows", "stored"])

    done = materialize(objects.select("sha256", "data", "rows").mapInArrow(run, "sha256 string, bytes long, rows long, stored boolean"), "objects")
    store, base = _open(root)
    if store.get_file_info(posixpath.join(base, "tmp")).type != fs.FileType.NotFound:
        store.delete_dir(posixpath.join(base, "tmp"))
    return done


def read(spark: SparkSession, root: str) -> DataFrame:
    """(sha256, content, intact) of every object; ``intact`` is whether its content still has the name's hash. An empty store has no rows."""
    store, base = _open(root)
    if store.get_file_info(posixpath.join(base, "objects")).type == fs.FileType.NotFound:
        return spark.createDataFrame([], "sha256 string, content binary, intact boolean")
    name = F.regexp_extract("path", "/([0-9a-f]{64})[^/]*$", 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/objects")
    return files.select(name.alias("sha256"), "content", (sha256(F.col("content")) == name).alias("intact"))


def catalogue(pages: DataFrame, key: str, order: str, first: str) -> DataFrame:
    """The last row of each key by ``order``, with the first one's value of ``first`` that isn't null."""
    every = pages.groupBy(key).agg(F.max_by(F.struct(*(c for c in pages.columns if c not in (key, first))), order).alias("last"), F.min_by(first, F.when(F.col(first).isNotNull(), F.col(order))).alias(first))
    return every.select(key, "last.*", first)
