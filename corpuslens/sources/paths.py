"""Paths as their file systems spell them."""

from __future__ import annotations

from pyspark.sql import SparkSession


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder as its file system spells it: scheme, absolute path, no dots."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return path.makeQualified(store.getUri(), store.getWorkingDirectory()).toString()
