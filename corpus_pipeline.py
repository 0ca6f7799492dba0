"""Training-data pipeline over ``documents``: each stage is one corpus operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``. Rows without a doc_id pass the stages that work
by id and are encoded with the empty key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontam, langid, minhash, mixing, sstable
from quarry.llm.common import materialize
from quarry.llm.queries import MIX_SEED, MIX_WEIGHTS, tokenizer_path, with_domain

#: Share of the tokens that reach the mix which it hands on.
MIX_PART = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compressor can tell; the others go."""
    return langid.accept(docs, langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked at five words and 0.8."""
    return minhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the benchmark's phrases; texts of nothing else go."""
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, each document once at most."""
    domain = "domain"
    while domain in docs.columns:
        domain += "_"
    weights = spark.createDataFrame(MIX_WEIGHTS, "path string, weight long")
    return mixing.select_rows(with_domain(docs, domain), weights, epochs=1, seed=MIX_SEED, levels=(domain, "lang", "source"), columns=docs.columns, part=MIX_PART)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in the shared folder, read back: a row for each document."""
    return sstable.round_trip(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("token_output", token_output)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Compression, hashing and file formats are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None
