"""Intermediate tables in the folder that all executors share."""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []  # of the jobs under way, innermost last


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which the cluster or whoever built the session names."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    return folder


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a scan of it.

    This cuts the lineage: what was written is not computed again, also when executors are lost.
    Unlike ``checkpoint()`` it leaves a columnar table, so later reads prune columns and Spark knows
    its size when it chooses joins. Within ``table_scope`` the table goes when the scope ends.
    """
    return materialise_each([df], name)


def materialise_each(frames: list[DataFrame], name: str) -> DataFrame:
    """Write ``frames``, which have one schema, as one table, a job for each, and return a scan of it.

    Adaptive execution plans a query anew whenever a stage of it ends, and the driver keeps what it
    plans. Of frames with long plans, a union in one job takes the product of stages and plan there;
    one after another they take the largest frame's share.
    """
    spark = frames[0].sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    for number, df in enumerate(frames):
        df.write.mode("append" if number else "error").parquet(path, compression="zstd")
    return spark.read.schema(frames[0].schema).parquet(path)


@contextmanager
def table_scope(spark: SparkSession) -> Iterator[None]:
    """Drops the tables that are materialised inside, for jobs that store their results elsewhere.

    A frame that reads such a table must not be used after the scope. Queries that return a lazy
    frame run outside of any scope; their tables stay as long as the folder does.
    """
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(hadoop).delete(place, True)
