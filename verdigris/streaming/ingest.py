"""Indexing a stream of documents: each micro-batch becomes part of the store.

A batch is written under its own number before it is counted as applied, so a
batch that is run again after a failure replaces its earlier attempt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdigris.functions.analysis import Analyzer
from verdigris.operators.index import SearchIndex, build_index, empty_index


def ingest(stream: DataFrame, path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", analyzer: Analyzer | None = None, available_now: bool = True) -> StreamingQuery:
    """Start indexing ``stream`` to ``path``; with ``available_now`` it ends when
    what is there has been read."""
    analyzer = analyzer or Analyzer()

    def apply(batch: DataFrame, number: int) -> None:
        index = build_index(batch, id_col, text_col, analyzer)
        index.postings.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        index.doc_stats.write.mode("overwrite").parquet(f"{path}/doc_stats/batch={number}")

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def open_ingested(spark: SparkSession, path: str, analyzer: Analyzer | None = None) -> SearchIndex:
    """The index of all batches so far; of a document that came more than once, the latest
    batch counts."""
    try:
        postings, docs = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/doc_stats")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return empty_index(spark, analyzer)
        raise
    latest = docs.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return SearchIndex(
        postings.join(latest, ["doc_id", "batch"]).select("term", "doc_id", "tf", "dl", "positions"),
        docs.join(latest, ["doc_id", "batch"]).select("doc_id", "slug", "num_terms"),
        analyzer or Analyzer(),
    )
