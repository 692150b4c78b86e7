"""Documents from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str, encoding: str | None = None, pattern: str = "*", slug: str | None = None) -> DataFrame:
    """``(slug, path, text)``: every file below ``path`` is one document.

    Without ``encoding``, UTF-8. ``slug`` is a regular expression whose first group,
    found in the path, names the document; without it, the whole path does.
    """
    if encoding is None:
        rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
        rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    else:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
        rows = rows.select("path", F.decode("content", encoding).alias("text"))
    return rows.select((F.regexp_extract("path", slug, 1) if slug else F.col("path")).alias("slug"), "path", "text")


def with_ids(docs: DataFrame, slug_col: str = "slug") -> DataFrame:
    """``docs`` with ``doc_id``, a 63-bit hash of the slug: the same slug has the
    same id in every run, and ids are never reused for another document."""
    return docs.withColumn("doc_id", F.xxhash64(slug_col).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)))
