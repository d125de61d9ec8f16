"""Written stages and reading helpers shared by the operators of this folder.

A stage is a Parquet folder below the shared folder of the session
(``spark.checkpoint.dir``); reading it back cuts the lineage, so that a lost
executor costs a re-read and not a recomputation from the texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.sources.workspace import shared_folder


def stage_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one written stage of this application."""
    return f"{shared_folder(spark)}/corpuslens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(spark: SparkSession, rows: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """`rows`, written once and read back; `row_group` bounds the rows that are held together when large ones are written or read."""
    folder = stage_folder(spark, name)
    (rows.write if row_group is None else rows.write.option("parquet.block.row.count.limit", row_group)).parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def numbered(spark: SparkSession, rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`rows` with their `number` (0, 1, 2 ...) in that order, written.

    Rows are sorted by ranges, so no task holds more than its range.  The driver
    sees one size for each range, of which there are spark.sql.shuffle.partitions.
    """
    ranges = written(spark, rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    sizes = sorted((r["_range"], r["n"]) for r in ranges.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("n")).collect())
    firsts, total = [], 0
    for part, n in sizes:
        firsts.append((part, total))
        total += n
    first = F.broadcast(spark.createDataFrame(firsts, "_range long, _first long"))
    number = F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return ranges.withColumn("_range", F.shiftright("_at", 33)).join(first, "_range").withColumn("number", number).drop("_range", "_at", "_first")
