"""File sources: a script, a folder tree, and text normalised to UTF-8."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.sources import listing
from corpuslens.sources.paths import qualified

FILE_COLUMNS = ["path", "content", "encoding", "size", "read_ok"]


def _decoded(files: DataFrame) -> DataFrame:
    """(path, content BINARY) -> text, encoding and read_ok; bad bytes give a row, not a failure."""
    raw = F.col("content")
    mark = F.hex(F.substring(raw, 1, 2))
    utf16 = mark.isin("FFFE", "FEFF") & (F.length(raw) % 2 == 0)
    utf8 = F.is_valid_utf8(raw.cast("string"))
    return files.select(
        "path",
        F.when(utf16, F.try_validate_utf8(F.decode(_or_empty(raw, utf16), "UTF-16")))
        .when(utf8, raw.cast("string")).alias("content"),
        F.when(utf16, "utf-16").when(utf8, "utf-8").otherwise("unknown").alias("encoding"),
        F.length(raw).cast("bigint").alias("size"),
    ).withColumn("read_ok", F.col("content").isNotNull())


def _or_empty(raw: Column, condition: Column) -> Column:
    # decode() raises on malformed input; it must only ever see what the test let through
    return F.when(condition, raw).otherwise(F.lit(b""))


def to_utf8(files: DataFrame) -> DataFrame:
    """UTF-16 files (by byte-order mark) become UTF-8 text; the source stays untouched."""
    return _decoded(files).select(*FILE_COLUMNS)


def _text(raw: DataFrame, path: Column) -> DataFrame:
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    return raw.select(
        path.alias("path"), F.when(valid, F.col("content").cast("string")).alias("content"),
        F.when(valid, "utf-8").otherwise("unknown").alias("encoding"), F.col("length").alias("size"), valid.alias("read_ok"))


def read_script(spark: SparkSession, path: str) -> DataFrame:
    """One `.py` file as UTF-8 text, or all files that a pattern of paths names.

    What a pattern names is listed and read by tasks.  Spark's reader, which takes each file for a folder
    to be listed and keeps all on the driver, reads single files, and stores that tasks cannot list.
    """
    fixed, steps = _pattern(path)
    files = listing.listed_as_spark(spark, fixed, "(?s:.*)", steps) if steps and listing.reachable(spark, fixed) else None
    if files is None or files.isEmpty():   # of a pattern that names nothing Spark's reader says so
        raw = spark.read.format("binaryFile").load(path).select("path", "content", "length")
    else:
        raw = listing.read_as_spark(spark, fixed, files)
    return _text(raw, F.substring_index("path", "/", -1))


def _pattern(path: str) -> tuple[str, list[str]]:
    """The folder before the first wildcard, and patterns of the names below; none if there is no wildcard, or one of a kind that is left to Spark."""
    names = path.split("/")
    first = next((i for i, name in enumerate(names) if re.search(r"[*?\[{\\]", name)), 0)
    if not first or not all(names[first:]):
        return path, []
    steps = [listing.name_pattern(name) for name in names[first:]]
    return "/".join(names[:first]) or "/", [] if None in steps else steps


def scan_folder(spark: SparkSession, folder: str, glob: str = "*.py") -> DataFrame:
    """All matching files below a folder, by path relative to it.

    A file that is not UTF-8 is a row with `read_ok = false`; the rest goes on.  Files are listed and read
    by tasks; a store that they cannot list, and a pattern with braces or escapes, are left to Spark's reader,
    which lists on the driver.
    """
    pattern = listing.name_pattern(glob)
    if pattern is not None and listing.reachable(spark, folder):
        return _text(listing.read_as_spark(spark, folder, listing.listed_as_spark(spark, folder, pattern)), F.col("path"))
    base = qualified(spark, folder).rstrip("/") + "/"
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
        .load(folder).select("path", "content", "length")
    )
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # an empty authority may be left out
    return _text(raw, F.regexp_replace(F.substr(plain(F.col("path")), F.length(plain(F.lit(base))) + 1), "^/+", ""))
