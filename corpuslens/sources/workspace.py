"""Written intermediate tables: parse once, analyse many times.

A table is written below the folder named in ``spark.checkpoint.dir`` and read
back, which cuts its lineage: a lost executor costs a re-read, never a re-parse.
Tables are bucketed by their key, so later joins, aggregates and windows on that
key need no shuffle.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT = "spark.checkpoint.dir"
_local_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach; a temporary one only in local mode."""
    named = spark.conf.get(_CHECKPOINT, None) or spark.sparkContext.getConf().get(_CHECKPOINT)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT} to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_folder:
        _local_folder[app] = tempfile.mkdtemp(prefix="corpuslens-")
    return _local_folder[app]


def run_folder(spark: SparkSession, *key: str) -> str:
    """A folder for one (application, key) pair."""
    digest = hashlib.sha256("\x00".join(key).encode()).hexdigest()[:16]
    return f"{shared_folder(spark)}/corpuslens/{spark.sparkContext.applicationId}/{key[0]}_{digest}"


def _table_name(folder: str) -> str:
    return "corpuslens_" + hashlib.sha256(folder.encode()).hexdigest()[:20]


def written_table(spark: SparkSession, key: tuple[str, ...]) -> DataFrame | None:
    """The table for `key`, if this application has written it."""
    table = _table_name(run_folder(spark, *key))
    return spark.table(table) if spark.catalog.tableExists(table) else None


def written(
    spark: SparkSession,
    key: tuple[str, ...],
    build: Callable[[], DataFrame],
    bucket_by: str,
    redistribute: bool,
) -> DataFrame:
    """The table for `key`: written on first use in this application, then read.

    `redistribute` hashes the rows on the bucket key first, so that every task
    writes one bucket; leave it off when the rows already come bucket by bucket
    (a map over another table written here with the same key).
    """
    folder = run_folder(spark, *key)
    table = _table_name(folder)
    if not spark.catalog.tableExists(table):
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = build()
        if redistribute:
            rows = rows.repartition(buckets, bucket_by)
        (
            rows.write.mode("overwrite").format("parquet").option("path", folder)
            .bucketBy(buckets, bucket_by).saveAsTable(table)
        )
    return spark.table(table)


def release(spark: SparkSession) -> None:
    """Drop the tables of this application and delete their files."""
    for table in spark.catalog.listTables():
        if table.name.startswith("corpuslens_") and not table.isTemporary:
            spark.sql(f"DROP TABLE IF EXISTS {table.name}")
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/corpuslens/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
