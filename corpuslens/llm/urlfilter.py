"""URL verdicts: host/path rules first, then exact list membership by a Bloom filter cascade.

The cascade encodes a set of listed keys against the complete set of keys that
occur (the universe).  Level 1 is a Bloom filter of the listed keys; level 2 one
of the unlisted keys that pass level 1; level 3 one of the listed keys that pass
level 2; and so on until nothing passes wrongly.  A key of the universe is
listed exactly if the first level that it fails has an even number, or if it
passes all of an odd number of levels.  Membership is then an expression over a
few bit arrays: the pages are neither shuffled nor joined.

Size: keys are cut into blocks of at most about `block_keys` listed keys by a
hash, and every block has its own cascade (some 10 bits a key, so 5 MB at the
default).  One block is read as scalar subqueries; of several blocks each one is
a pass over the pages whose key falls into it.  Nothing is broadcast whose size
grows with the data.

Everything is DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.staging import written

FIRST_LEVEL = (10, 4)   # bits a key, hash functions
LATER_LEVELS = (2, 1)   # their false positives halve about from level to level
BLOCK_KEYS = 4_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def first_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits.

    A rule is (verdict, "host/path start"); it fits its host and all subdomains.
    """
    rule = verdict = None
    for decision, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        rule_host, slash, start = text.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(slash + start))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


class Cascade:
    """Built filters: one (level, block) row of words each, and how to ask them."""

    def __init__(self, filters: DataFrame, words: list[int], blocks: int):
        self.filters, self.words, self.blocks = filters, words, blocks

    def block_of(self, key: Column) -> Column:
        return _block(key, self.blocks)

    def contains(self, key: Column, block: int) -> Column:
        """Exact membership of a key of the universe that belongs to `block`."""
        listed = F.lit(len(self.words) % 2 == 1)
        for level in range(len(self.words), 0, -1):
            bits = self.filters.where((F.col("level") == level) & (F.col("block") == block)).select("words").scalar()
            passes = _passes(key, level, self.words[level - 1], bits)
            listed = F.when(passes, listed).otherwise(F.lit(level % 2 == 0))
        return listed


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks)).cast("int")


def _bit(key: Column, level: int, probe: int, words: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(probe)), F.lit(64 * words))


def _passes(key: Column, level: int, words: int, bits: Column) -> Column:
    probes = (FIRST_LEVEL if level == 1 else LATER_LEVELS)[1]
    each = [_bit(key, level, p, words) for p in range(probes)]
    word = lambda at: F.coalesce(F.get(bits, (at / 64).cast("int")), F.lit(0))
    return reduce(lambda a, b: a & b, [F.getbit(word(at), F.pmod(at, F.lit(64)).cast("int")) == 1 for at in each])


def _filter_rows(keys: DataFrame, level: int, words: int) -> DataFrame:
    """One row of `words` longs for each block that has keys."""
    probes = (FIRST_LEVEL if level == 1 else LATER_LEVELS)[1]
    bits = F.explode(F.array(*[_bit(F.col("key"), level, p, words) for p in range(probes)]))
    ones = keys.select("block", bits.alias("at")).groupBy("block", (F.col("at") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))).alias("bits"))
    zeros = ones.select("block").distinct().select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(words - 1))).alias("word"), F.lit(0).cast("long").alias("bits"))
    dense = ones.unionByName(zeros).groupBy("block", "word").agg(F.bit_or("bits").alias("bits"))
    return dense.groupBy("block").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words")).select(
        F.lit(level).alias("level"), "block", "words")


def build_cascade(spark: SparkSession, universe: DataFrame, block_keys: int = BLOCK_KEYS) -> Cascade:
    """Cascade of universe(key STRING, listed BOOLEAN), keys distinct; null keys belong to no set.

    An empty list gives a cascade without levels, which lists nothing.
    """
    keys = universe.filter("key IS NOT NULL")
    n_listed = keys.filter("listed").count()
    blocks = max(1, -(-n_listed // block_keys))
    keys = keys.select("key", "listed", _block(F.col("key"), blocks).alias("block"))
    inside, outside = keys.filter("listed"), keys.filter("NOT listed")
    words: list[int] = []
    filters = None
    while True:
        most = inside.groupBy("block").count().agg(F.max("count")).first()[0]
        if not most:
            break
        level = len(words) + 1
        words.append(max(1, -(-(FIRST_LEVEL if level == 1 else LATER_LEVELS)[0] * most // 64)))
        rows = written(spark, _filter_rows(inside, level, words[-1]), "bloom")
        filters = rows if filters is None else filters.unionByName(rows)
        # the rows of one level: one for each block, so this join is on a table of `blocks` rows
        wrong = outside.join(rows.withColumnRenamed("words", "level_bits"), "block").filter(
            _passes(F.col("key"), level, words[-1], F.col("level_bits"))).select("key", "listed", "block")
        inside, outside = written(spark, wrong, "passed"), inside
    if filters is None:
        filters = spark.createDataFrame([], "level int, block int, words array<bigint>")
    return Cascade(filters, words, blocks)


def judge_urls(
    spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str]], is_listed, key: Column | None = None,
    url: str = "url", keep: tuple[str, ...] = ("page_id",), block_keys: int = BLOCK_KEYS,
) -> DataFrame:
    """The columns `keep`, host, path, rule and verdict (allow or block) of every page.

    Where no rule fits, a page is blocked exactly if its key (the host by
    default, an expression over `host` and `path`) is listed.  `is_listed` is
    either a DataFrame with a column `key`, or a function from the key column to
    a boolean column that marks the listed keys of the universe.

    Defined cases: a null url, or one without `://`, has empty host and path and
    the key ""; repeated rows each give a row; an empty table gives no rows;
    other columns of `pages` are not read, whatever their names.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(*keep, host.alias("host"), path.alias("path"))
    key = F.col("host") if key is None else key
    found = rows.select(key.alias("key")).distinct()
    if isinstance(is_listed, DataFrame):
        listed = is_listed.select(F.col("key"), F.lit(True).alias("listed")).filter("key IS NOT NULL").distinct()
        universe = found.join(listed, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))
    else:
        universe = found.select("key", F.coalesce(is_listed(F.col("key")), F.lit(False)).alias("listed"))
    cascade = build_cascade(spark, written(spark, universe, "universe"), block_keys)
    rule, decided = first_rule(F.col("host"), F.col("path"), rules)

    def judged(part: DataFrame, block: int) -> DataFrame:
        by_list = F.when(cascade.contains(key, block), "block").otherwise("allow")
        return part.select(*keep, "host", "path", rule.alias("rule"), F.coalesce(decided, by_list).alias("verdict"))

    if cascade.blocks == 1:
        return judged(rows, 0)
    mine = F.coalesce(cascade.block_of(key), F.lit(0))
    return reduce(DataFrame.unionByName, [judged(rows.filter(mine == b), b) for b in range(cascade.blocks)])
