"""Helpers shared by the operators: durable tables, key hashes, tokens."""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.sources.scratch import durable, release, shared_dir

# Worker functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: Tokens everywhere in this subpackage: maximal runs of letters and digits.
WORD = re.compile(r"[^\W_]+")
#: The same class for RE2 (DuckDB).
WORD_RE2 = r"[\p{L}\p{N}]+"


def key_hash(*columns: Column) -> Column:
    """60 uniform bits of MD5 over the columns as text, joined by '|'."""
    text = F.concat_ws("|", *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """``docs`` less the rows whose id is in ``gone`` (one column of ids). The
    columns of ``docs`` may have any names; rows with a null id stay. ``gone`` is
    written first, so that Spark broadcasts it only if it is small in fact."""
    name = fresh(docs, "__gone")
    ids = durable(gone.toDF(name).distinct())
    return docs.join(ids, F.col(f"`{id_col}`").cast("bigint") == F.col(name), "left_anti")


__all__ = ["WORD", "WORD_RE2", "durable", "fresh", "key_hash", "read", "release", "shared_dir", "without"]
