"""From raw documents to packed sequences: quality rules, quality classifier, near-duplicates, mixing, packing."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rostrum.llm import mixing, packing, resampling, rules, similar
from rostrum.llm.common import drop_staged, reads_staged, stage_table, staged_count
from rostrum.session import ship_package

#: The staged tables that the last stage made, which its output needs until it is written.
_last = [0, 0]


def stage(body):
    """A stage but the first frees what the stage before it staged, unless its documents still read that."""

    @functools.wraps(body)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        if body.__name__ != STAGES[0][1].__name__ and not reads_staged(docs, *_last):
            drop_staged(*_last)
        start = staged_count()
        out = body(spark, docs, sf_dir)
        _last[:] = [start, staged_count()]
        return out

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled thresholds."""
    return rules.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws; as many as are good by the labels of these documents."""
    return resampling.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, Jaccard similarity of 0.8 or more."""
    return similar.keep_one(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for each time that a document is taken, in shards."""
    return mixing.mixture(docs)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences, with their token ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("near_duplicates", near_duplicates), ("mixing", mix_sources), ("packing", pack_sequences)]

#: No SQL expresses the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage_table(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
