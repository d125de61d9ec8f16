"""Mixing of sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words.  Every source has a weight and a target: its share of all words by
weight, at most `MOST_PASSES` times what it has; what is over goes to the others by
weight until no target is above.

The documents of a source are dealt into blocks by a hash of id and text, in
proportion to the source's size, `BLOCKS` in all (and one for each source more).  A
source gives its quota of blocks: all of them once for every whole pass in the
target; for the rest, blocks in the order of their number while their sum fits, `FILLS`
times over those that are not too large for what is open, and then the one block that
comes nearest to it.

Quotas are dealt to output shards by a binary tree: at each node the left half of the
shards gets its exact number of blocks, and how many of each source is a draw from the
multivariate hypergeometric distribution of what the node holds.  A node's draw has a
seed of its own, so every task walks from the root to its own shards alone.  The shards'
counts cut the permuted blocks of a source into disjoint runs.  Last, the documents of
a shard's blocks are shuffled within the shard.

The texts are moved once, to their shards.  What meets them on the way is the table of
blocks, of a size bounded by `BLOCKS` and not by the documents.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.llm.staging import numbered, stage_folder, written

# executors need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
BLOCKS = 1 << 16
SHARD_WORDS = 20_000_000
FILLS = 4
SHARD_BLOCKS = 32           # a shard gets so many blocks at least, on average
SEED = 2024
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permuting_hash(doc_id: Column, text: Column, seed: int) -> Column:
    """60 bits of an id and a text; equal rows stay together."""
    named = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.sha2(named, 256), 1, 15), 16, 10).cast("long")


def source_targets(spark: SparkSession, sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """source, number (by code point, null last), weight, source_size, target of sizes(source, size)."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = numbered(spark, per_source, [F.asc_nulls_last("source")], "sources").withColumn(
        "weight", F.element_at(F.lit(list(weights)), (F.col("number") % len(weights) + 1).cast("int")))
    wide = lambda c: c.cast("decimal(38,0)")
    limit = most * F.col("source_size")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    full, open_words, open_weight = F.lit(False), total, None
    stopped = -1
    while True:
        # one round of sharing: who is full by the last round's level stops at its limit
        round_ = sources.agg(
            F.count_if(full).alias("n"), F.coalesce(F.sum(F.when(full, limit)), F.lit(0)).alias("stopped"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight")).first()
        open_words, open_weight = total - round_.stopped, round_.weight
        if round_.n == stopped:
            break
        stopped = round_.n
        full = wide(limit) * F.lit(open_weight).cast("decimal(19,0)") < wide(F.lit(open_words)) * F.col("weight").cast("decimal(19,0)")
    share = F.col("weight") * F.lit(float(open_words)) / F.lit(float(open_weight or 1))
    return sources.withColumn("target", F.when(full, limit.cast("double")).otherwise(share))


def block_draws(blocks: DataFrame, sources: DataFrame, most: int = MOST_PASSES) -> DataFrame:
    """number, block, times: how often the mix takes each block of blocks(number, block, words).

    The windows hold the blocks of one source, of which there are at most BLOCKS and one.
    """
    passes = F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size"))).cast("int")
    per = sources.filter("source_size > 0").select("number", passes.alias("passes"), (F.col("target") - passes * F.col("source_size")).alias("rest"))
    by_source = W.partitionBy("number")
    rows = blocks.join(per, "number").withColumn("open", F.when(F.col("passes") < most, F.col("rest")).otherwise(0)).withColumn("fits", F.lit(False))
    for _ in range(FILLS):
        small = ~F.col("fits") & (F.col("words") <= F.col("open"))
        running = F.sum(F.when(small, F.col("words")).otherwise(0)).over(by_source.orderBy("block"))
        rows = rows.withColumn("more", small & (running <= F.col("open")))
        filled = F.sum(F.when(F.col("more"), F.col("words")).otherwise(0)).over(by_source)
        rows = rows.withColumn("open", F.col("open") - filled).withColumn("fits", F.col("fits") | F.col("more"))
    rows = rows.withColumn("off", F.abs(F.col("words") - F.col("open")))
    better = ~F.col("fits") & (F.col("off") < F.col("open"))
    nearest = F.min(F.when(better, F.struct("off", "block"))).over(by_source)
    last = better & (F.struct("off", "block") == nearest)
    return rows.select("number", "block", (F.col("passes") + (F.col("fits") | F.coalesce(last, F.lit(False))).cast("int")).alias("times"))


def _split(quota: np.ndarray, shards: int, seed: int, wanted: range) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, first draw, number of draws, each by source) of the wanted shards."""
    total = int(quota.sum())
    before = lambda shard: total * shard // shards

    def node(low: int, high: int, first: np.ndarray, held: np.ndarray):
        if high <= wanted.start or low >= wanted.stop:
            return
        if high - low == 1:
            yield low, first, held
            return
        middle = (low + high) // 2
        draw = np.random.default_rng([seed, low, high])
        left = draw.multivariate_hypergeometric(held, before(middle) - before(low), method="marginals")
        yield from node(low, middle, first, left)
        yield from node(middle, high, first + left, held - left)

    yield from node(0, shards, np.zeros_like(quota), quota)


def shard_quotas(spark: SparkSession, quota: dict[int, int], shards: int, seed: int) -> DataFrame:
    """shard, number, first, count: which of the permuted draws of each source a shard gets."""
    numbers = np.array(sorted(quota), np.int64)
    held = np.array([quota[n] for n in numbers.tolist()], np.int64)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            if not ids:
                continue
            for shard, first, count in _split(held, shards, seed, range(ids[0], ids[-1] + 1)):
                some = count > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(int(some.sum()), shard, np.int32)), *(pa.array(x[some]) for x in (numbers, first, count))],
                    ["shard", "number", "first", "count"])

    return spark.range(0, shards).mapInArrow(walk, "shard int, number long, first long, count long")


class Mixture:
    """A mix of documents(doc_id, source, text).

    Defined cases: a null text has size 0; a null source is a source, the last by name;
    rows with one id and text share a block; a doc_id may repeat; documents without words
    are in their source's blocks and taken like others; a table without words mixes to
    nothing; further columns are not read.
    """

    def __init__(self, spark: SparkSession, documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES,
                 blocks: int = BLOCKS, shard_words: int = SHARD_WORDS, seed: int = SEED):
        self.spark, self.seed, self.documents = spark, seed, documents
        self.sizes = written(spark, documents.select(
            "doc_id", "source", words_of(F.col("text")).alias("size"), permuting_hash(F.col("doc_id"), F.col("text"), seed).alias("hash")), "sizes")
        self.sources = written(spark, source_targets(spark, self.sizes, weights, most), "targets")
        total = self.sources.agg(F.sum("source_size")).first()[0] or 0
        # bigger sources have more blocks; their sum is at most `blocks` and one for each source
        n_blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") * F.lit(float(blocks)) / F.lit(float(max(total, 1))))).cast("long")
        self._dealt = self.sources.select(F.col("source").alias("of_source"), "number", n_blocks.alias("n_blocks"))
        per_block = self._blocked(self.sizes).groupBy("number", "block").agg(F.sum("size").alias("words"))
        self.blocks = written(spark, block_draws(per_block, self.sources, most), "block-draws")
        # one number for each source of the mix
        quota = {r.number: r.n for r in self.blocks.groupBy("number").agg(F.sum("times").alias("n")).collect() if r.n}
        self.shards = max(1, min(-(-total // shard_words), sum(quota.values()) // SHARD_BLOCKS))
        self.small = self.blocks.count() <= 2 * blocks
        self.plan = written(spark, self._plan(quota), "mix-plan") if quota else None

    def _blocked(self, rows: DataFrame) -> DataFrame:
        """Rows with source and hash get the number of their source and their block."""
        return rows.join(self._dealt, rows["source"].eqNullSafe(self._dealt["of_source"])).withColumn(
            "block", F.pmod("hash", "n_blocks")).drop("of_source", "n_blocks")

    def _plan(self, quota: dict[int, int]) -> DataFrame:
        """number, block, copies: the shards that get a block, with the pass of each copy."""
        passes = self.blocks.filter("times > 0").withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("times"))))
        # the blocks of one source, at most MOST_PASSES times: bounded by BLOCKS
        order = W.partitionBy("number").orderBy("pass", F.xxhash64(F.lit(self.seed), "number", "block", "pass"), "block")
        permuted = passes.withColumn("draw", (F.row_number().over(order) - 1).cast("long"))
        runs = shard_quotas(self.spark, quota, self.shards, self.seed)
        drawn = runs.select("shard", "number", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("draw"))
        return permuted.join(drawn, ["number", "draw"]).groupBy("number", "block").agg(F.collect_list(F.struct("shard", "pass")).alias("copies"))

    def texts(self) -> DataFrame:
        """shard, place, pass, doc_id, source, hash, text of every copy that the mix takes; place orders a shard."""
        rows = self.documents.select("doc_id", "source", "text").withColumn("hash", permuting_hash(F.col("doc_id"), F.col("text"), self.seed))
        if self.plan is None:
            return rows.limit(0).select(F.lit(0).alias("shard"), F.lit(0).cast("long").alias("place"), F.lit(0).alias("pass"), *rows.columns)
        # at most `blocks` rows and one for each source; with very many sources, a shuffle
        plan = F.broadcast(self.plan) if self.small else self.plan
        copies = self._blocked(rows).join(plan, ["number", "block"]).withColumn("copy", F.explode("copies"))
        place = F.xxhash64(F.lit(self.seed), "copy.shard", "copy.pass", "hash")
        return copies.select("copy.shard", place.alias("place"), "copy.pass", "doc_id", "source", "hash", "text")

    def write(self, folder: str) -> None:
        """The shards as Parquet folders shard=0, 1, ..., each in its shuffled order."""
        self.texts().repartitionById(self.shards, F.col("shard")).sortWithinPartitions("shard", "place").write.partitionBy("shard").parquet(folder)


def mixed(spark: SparkSession, documents: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes the mix and returns doc_id, source, size, source_size, target, taken of every document, as found in its files."""
    mix = Mixture(spark, documents, **options)
    folder = folder or stage_folder(spark, "mix")
    mix.write(folder)
    key = ["doc_id", "source", "hash"]
    shape = mix.texts().schema
    taken = spark.read.schema(shape).parquet(folder).select(*key, F.lit(None).cast("long").alias("size"))
    both = mix.sizes.select(*key, "size").unionByName(taken).groupBy(*key).agg(
        F.count("size").alias("rows"), F.max("size").alias("size"), (F.count("*") - F.count("size")).alias("copies"))
    # equal rows are taken equally often
    rows = both.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    targets = mix.sources.select(F.col("source").alias("of_source"), "source_size", "target")
    return rows.join(targets, rows["source"].eqNullSafe(targets["of_source"])).select(
        "doc_id", "source", "size", "source_size", "target", F.expr("size * (copies div rows)").alias("taken"))
