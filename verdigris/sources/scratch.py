"""Tables between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or a fresh temporary one where the
    session names none and runs on one machine (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="verdigris-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/verdigris/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


#: Paths that each open ``scope`` has written.
_scopes: list[list[str]] = []


def durable(df: DataFrame, outlives: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    This cuts lineage in a way that survives the loss of executors, and gives
    the optimizer true sizes for the joins that follow. The table goes with the
    ``scope`` that it is written in, or if it ``outlives`` that, with the next one.
    """
    return durable_all([df], outlives)


def durable_all(parts: Iterable[DataFrame], outlives: bool = False) -> DataFrame:
    """``durable`` of tables of one schema, one at least, written one after the other."""
    path = None
    for df in parts:
        path = path or fresh_path(df.sparkSession)
        df.write.mode("append").parquet(path)
    at = len(_scopes) - 1 - outlives
    if at >= 0:
        _scopes[at].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes what ``durable`` has written inside it when it ends. Results that
    read these tables must have been stored by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Delete every table that ``durable`` wrote for this application. Call it
    once the results that read them have been stored."""
    _delete(spark, f"{shared_dir(spark)}/verdigris/{spark.sparkContext.applicationId}")
