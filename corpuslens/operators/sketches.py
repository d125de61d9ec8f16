"""Overview counts of a huge corpus from sketches that are kept and united.

Files fall into buckets by a hash of their path.  A bucket has, for each metric, a
HyperLogLog sketch of its items and the sum of their weights, and a signature of the
files it was made from.  When the corpus changes, only buckets with another signature
are read again; the overview is the union of all buckets' sketches.  With 2^14
registers the relative standard error is about 0.8 %; `BOUND` is three of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators.entities import OVERVIEW_METRICS, overview_items

BUCKETS = 64
REGISTER_BITS = 14
BOUND = 0.025
_SUMMED = ["Files", "Transformations"]
_SHAPE = "bucket int, metric string, sketch binary, total long, signature string"


def bucket_of(path, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def signatures(listing: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, signature of listing(path, blob): equal when the files and their contents are, in any order."""
    of_file = F.xxhash64("path", "blob")
    halves = [F.sum(F.shiftright(of_file, 32)), F.sum(of_file.bitwiseAND(0xFFFFFFFF)), F.count("*")]
    return listing.groupBy(bucket_of("path", buckets).alias("bucket")).agg(F.concat_ws(":", *[h.cast("string") for h in halves]).alias("signature"))


def bucket_sketches(nodes: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, metric, sketch, total of the overview's items."""
    items = overview_items(nodes).withColumn("bucket", bucket_of("path", buckets))
    return items.groupBy("bucket", "metric").agg(
        F.hll_sketch_agg(F.coalesce("item", F.lit("")), F.lit(REGISTER_BITS)).alias("sketch"), F.sum("weight").alias("total"))


def update(spark: SparkSession, folder: str, nodes: DataFrame, listing: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Bring the sketches below `folder` up to date; returns the buckets that were made anew.

    `nodes` is filtered by bucket before anything is read from it.  A bucket without files any
    more becomes empty.  The driver sees one number for each changed bucket.
    """
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    known = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    old = read(spark, folder) if known else spark.createDataFrame([], _SHAPE)
    now = signatures(listing, buckets)
    before = old.groupBy("bucket").agg(F.max("signature").alias("before"))
    both = now.join(before, "bucket", "full").filter(~F.col("signature").eqNullSafe(F.col("before"))).select("bucket", "signature")
    stale = sorted((r.bucket, r.signature) for r in both.collect())
    if not stale:
        return []
    changed = [b for b, _ in stale]
    marks = spark.createDataFrame(stale, "bucket int, signature string")
    fresh = bucket_sketches(nodes.filter(bucket_of("path", buckets).isin(changed)), buckets)
    # every stale bucket has its rows replaced, also if nothing is left in it
    empty = F.lit(None).cast("binary")
    rows = marks.join(fresh, "bucket", "left").select(
        "metric", F.coalesce("sketch", empty).alias("sketch"), F.coalesce("total", F.lit(0)).cast("long").alias("total"), "signature", "bucket")
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
    return changed


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_SHAPE).parquet(folder)


def overview(sketches: DataFrame) -> DataFrame:
    """metric, count: estimated distinct items, or the exact sum where everything counts."""
    every = sketches.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, OVERVIEW_METRICS))).alias("metric"))
    united = sketches.filter("sketch IS NOT NULL").groupBy("metric").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"), F.sum("total").alias("total"))
    count = F.when(F.col("metric").isin(_SUMMED), F.col("total")).otherwise(F.col("n"))
    return every.join(united, "metric", "left").select("metric", F.coalesce(count, F.lit(0)).cast("bigint").alias("count"))
