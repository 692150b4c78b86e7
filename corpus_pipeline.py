"""From raw documents to training shards, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``; the last adds ``shard``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdigris.llm import decontaminate, langid, mixing, sharding, simhash
from verdigris.llm._common import durable, read
from verdigris.sources.scratch import scope

# In every stage: extra columns pass through whatever their names, an empty table
# gives an empty one, texts are read whole, and of rows that repeat an id all stay or all go.


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: those with a null or empty text
    or too few known words among them. Rows with a null id go. Equal scores
    are a lead of 0, which is rejected."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that of the smallest
    id. Rows with a null id and texts without a word stay."""
    return simhash.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go. Rows with a null id, and null or
    empty texts, stay; an empty benchmark removes nothing."""
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents beyond their source's part of the token budget go. Rows with a null id
    go; a null source counts as ''; null and empty texts cost nothing and
    follow the hash of their id."""
    return mixing.keep_mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its ``shard``; nulls in language and source count as '', a null
    text as no bytes. A row with a null id has a null shard."""
    return sharding.add_shards(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("source_mixing", mixed),
    ("sharding", sharded),
]

#: The connected components of the second stage take as many rounds as the data
#: ask for, which one SQL statement for whole tables can't; tests hold run()
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with scope(spark):  # a stage's own tables go once its result is written
            docs = durable(stage(spark, docs, sf_dir), outlives=True)
    return docs
