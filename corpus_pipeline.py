"""From raw documents to shards, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontamination import drop_leaking
from tessera.llm.language_id import keep_identified
from tessera.llm.mixing import take_mix
from tessera.llm.near_dedup import drop_near_duplicates
from tessera.llm.scratch import written
from tessera.llm.sharding import assign_shards
from tessera.llm.shipping import ship
from tessera.llm.tables import table

#: SQL can't express the language model, the sketches or the passage index.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; letterless and undecided ones go."""
    ship(spark)
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingles at 0.8 or more."""
    ship(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    ship(spark)
    return drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their weights; a document that the mix takes twice is there twice."""
    return take_mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard and slot."""
    return assign_shards(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("source_mix", source_mix), ("sharding", sharding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
