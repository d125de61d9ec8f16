"""Folder scan whose listing and reading are both done by tasks.

`listed` goes down a tree level by level: tasks list folders, the folders found are the
next level's rows, written before they are listed in turn.  The driver sees the number
of folders of each level, never a path.  `read_listed` deals the files to tasks by
their size and reads each where it is decoded.  A folder or file that cannot be read is
a row with its error.

Tasks reach the store through pyarrow's file systems (local disks, HDFS, object stores);
for other stores, and for an inventory kept elsewhere, `read_listed` takes any table of
path, size.
"""

from __future__ import annotations

import fnmatch
import re
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.sources.dealing import dealt_by_size
from corpuslens.sources.paths import qualified
from corpuslens.sources.workspace import run_folder, shared_folder

# executors need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LISTED = "path string, is_folder boolean, size long, error string"
_BATCH_ROWS, _BATCH_BYTES = 10_000, 1 << 26


def _base(spark: SparkSession, folder: str) -> str:
    return re.sub("^file:/+", "file:///", qualified(spark, folder)).rstrip("/")


def _hidden(name: str) -> bool:
    """Whether Spark's own readers skip a name."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _lister(base: str, pattern: str, step: str | None = None, last: bool = True):
    """`step` is the pattern of all names of this level, if it is one of a path; files are found at the last such level and below."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(base)
        matched, stepped = re.compile(pattern).fullmatch, re.compile(step or "").fullmatch
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64(), pa.string()))], ["path", "is_folder", "size", "error"])

        for b in batches:
            for folder in b.column(0).to_pylist():
                place = f"{root}/{folder}" if folder else root
                try:
                    found = store.get_file_info(fs.FileSelector(place))
                except OSError as error:
                    rows.append((folder, False, None, str(error)[:500]))
                    continue
                for x in found:
                    name = x.base_name
                    if not stepped(name) if step else _hidden(name):
                        continue
                    path = f"{folder}/{name}" if folder else name
                    if x.type == fs.FileType.Directory:
                        rows.append((path, True, None, None))
                    elif last and matched(name) and not _hidden(name):
                        rows.append((path, False, x.size, None))
                    if len(rows) >= _BATCH_ROWS:
                        yield batch()
                        rows = []
        if rows:
            yield batch()

    return run


def listed(spark: SparkSession, folder: str, stage: str, glob: str = "*.py", tasks: int | None = None) -> DataFrame:
    """path, size, error of all matching files below `folder`, by path relative to it; `stage` holds the levels.

    A folder that cannot be listed is a row with its error.  Links are followed as the store does.
    """
    return _levels(spark, folder, stage, fnmatch.translate(glob), [], tasks)[0]


def _levels(spark: SparkSession, folder: str, stage: str, pattern: str, steps: list[str], tasks: int | None) -> tuple[DataFrame, DataFrame]:
    """The files, and the folders of the last level; with `steps` that is one below the last of them."""
    base, tasks = _base(spark, folder), tasks or spark.sparkContext.defaultParallelism
    stage = f"{stage}/{uuid.uuid4().hex[:12]}"
    level, folders, rows = 0, spark.createDataFrame([("",)], "path string"), 1
    while rows and not 0 < len(steps) < level:
        run = _lister(base, pattern, *((steps[level], level + 1 == len(steps)) if level < len(steps) else ()))
        # of one level; hashed by path, so that folders of one parent are listed by many tasks
        dealt = folders.select("path").repartition(min(tasks, rows), "path")
        dealt.mapInArrow(run, _LISTED).write.parquet(f"{stage}/{level}")
        folders = spark.read.schema(_LISTED).parquet(f"{stage}/{level}").filter("is_folder")
        rows, level = folders.count(), level + 1
    files = spark.read.schema(_LISTED).parquet(*[f"{stage}/{i}" for i in range(level)]).filter("NOT is_folder").select("path", "size", "error")
    return files, folders


def name_pattern(glob: str) -> str | None:
    """A regular expression for one name of Hadoop's globs, None for what it is not given for: braces, escapes, sets with a sign."""
    if re.search(r"[{}\\]|\[[!^]|\[[^\]]*\[|\[\]", glob) or glob.count("[") != glob.count("]"):
        return None
    return fnmatch.translate(glob)


def reachable(spark: SparkSession, folder: str) -> bool:
    """Whether tasks can list a folder: it exists in a store that pyarrow knows, and there is a shared folder for the levels."""
    from pyarrow import fs

    try:
        shared_folder(spark)
        store, root = fs.FileSystem.from_uri(_base(spark, folder))
        return store.get_file_info(root).type == fs.FileType.Directory
    except (pa.ArrowException, OSError, ValueError):
        return False


def listed_as_spark(spark: SparkSession, folder: str, pattern: str, steps: list[str] | None = None) -> DataFrame | None:
    """path, size, error of the files that Spark's readers find below `folder`.

    With `steps`, patterns of the first levels' names, that are the files they name and those in the folders they name;
    None if these hold folders named as partitions are.
    """
    files, folders = _levels(spark, folder, run_folder(spark, "listing", folder), pattern, steps or [], None)
    return None if steps and not folders.filter("contains(substring_index(path, '/', -1), '=')").isEmpty() else files


def read_as_spark(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """path, content, length as Spark's binary reader has them: files of no bytes are passed over, what cannot be listed or read fails."""
    raw = _raw(spark, folder, files.filter("size > 0 OR error IS NOT NULL"), None)
    path = F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "path", "error"))).otherwise(F.col("path"))
    return raw.select(path.alias("path"), F.col("raw").alias("content"), F.length("raw").cast("bigint").alias("length"))


def _reader(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(base)
        for b in batches:
            rows, held = [], 0
            for path, error in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                content = None
                if error is None:
                    try:
                        with store.open_input_stream(f"{root}/{path}") as file:
                            content = file.read()
                    except OSError as failed:
                        error = str(failed)[:500]
                rows.append((path, content, error))
                held += len(content or b"")
                if held >= _BATCH_BYTES:
                    yield _contents(rows)
                    rows, held = [], 0
            if rows:
                yield _contents(rows)

    return run


def _contents(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary(), pa.string()))], ["path", "raw", "error"])


def _raw(spark: SparkSession, folder: str, files: DataFrame, tasks: int | None) -> DataFrame:
    tasks = tasks or spark.sparkContext.defaultParallelism
    error = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    dealt = dealt_by_size(files.select("path", "size", error.alias("error")), "path", F.col("size"), tasks)
    return dealt.select("path", "error").mapInArrow(_reader(_base(spark, folder)), "path string, raw binary, error string")


def read_listed(spark: SparkSession, folder: str, files: DataFrame, tasks: int | None = None) -> DataFrame:
    """path, content, encoding, size, read_ok, error of files(path, size[, error]) below `folder`.

    A file that is not UTF-8, or cannot be read, is a row with `read_ok = false`.
    """
    raw = _raw(spark, folder, files, tasks)
    valid = F.col("raw").isNotNull() & F.coalesce(F.is_valid_utf8(F.col("raw").cast("string")), F.lit(False))
    return raw.select(
        "path", F.when(valid, F.col("raw").cast("string")).alias("content"), F.when(valid, "utf-8").otherwise("unknown").alias("encoding"),
        F.length("raw").cast("bigint").alias("size"), valid.alias("read_ok"), "error")


def listed_scan(spark: SparkSession, folder: str, stage: str, glob: str = "*.py", tasks: int | None = None) -> DataFrame:
    """What `scan_folder` reads, without a list of files on the driver; files of no bytes, which Spark's reader passes over, are rows too."""
    return read_listed(spark, folder, listed(spark, folder, stage, glob, tasks), tasks)
