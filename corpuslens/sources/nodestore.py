"""Content-addressed store of syntax nodes: every distinct content is parsed once.

Below a folder the store keeps, for each version, the listing (path, blob) of all files
then present, the blobs that were first seen in it, and their nodes, whose `path` is the
blob: the SHA-256 of the content.  An update hashes the files, finds unseen blobs by
an anti-join on hashes, and reads and parses one file of each; renamed, copied and
unchanged files cost a hash.  The listing is written last and makes the version
valid, so an update that fails leaves nothing that is ever read.

Analyses run on `nodes` by blob, each content once; `by_path` gives their rows to all
paths of a version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.sources.dealing import dealt_by_size
from corpuslens.sources.syntax import SCHEMA, syntax_nodes

_LISTING, _BLOBS = "path string, blob string", "blob string"


class NodeStore:
    """A store below `folder`, which every executor can reach."""

    def __init__(self, spark: SparkSession, folder: str, entities: bool = True):
        self.spark, self.folder, self.entities = spark, folder.rstrip("/"), entities

    def versions(self) -> list[int]:
        """Numbers of the valid versions; the driver lists one folder."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/listing")
        store = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(root):
            return []
        found = [s.getPath() for s in store.listStatus(root)]
        return sorted(int(p.getName()) for p in found if store.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _read(self, kind: str, versions: list[int], shape) -> DataFrame:
        folders = [f"{self.folder}/{kind}/{v}" for v in versions]
        return self.spark.read.schema(shape).parquet(*folders) if folders else self.spark.createDataFrame([], shape)

    def listing(self, version: int | None = None) -> DataFrame:
        """path, blob of the files of a version, by default the last."""
        versions = self.versions()
        return self._read("listing", versions[-1:] if version is None else [version], _LISTING)

    def blobs(self, version: int | None = None) -> DataFrame:
        """Blobs first seen in a version, by default in any."""
        return self._read("blobs", self.versions() if version is None else [version], _BLOBS)

    def nodes(self) -> DataFrame:
        """Nodes of all blobs in the store, with the blob as `path`; of a blob that is in no listing any more too."""
        return self._read("nodes", self.versions(), SCHEMA)

    def current_nodes(self) -> DataFrame:
        """Nodes of the blobs of the last version, each blob once."""
        blobs = self.listing().select(F.col("blob").alias("path")).distinct()
        return self.nodes().join(blobs, "path", "left_semi")

    def update(self, files: DataFrame, tasks: int | None = None) -> int:
        """Make files(path, content) the next version and return its number.

        Files are those of the whole corpus.  Paths are unique; a null content is the blob
        null and has no nodes.  Parsing tasks are of about equal size.
        """
        spark, versions = self.spark, self.versions()
        version = versions[-1] + 1 if versions else 0
        staged = f"{self.folder}/staged/{version}-{uuid.uuid4().hex[:8]}"
        files.select("path", F.sha2("content", 256).alias("blob")).write.parquet(staged)
        listing = spark.read.schema(_LISTING).parquet(staged)
        # one path for each unseen blob; only hashes and paths move
        unseen = listing.filter("blob IS NOT NULL").groupBy("blob").agg(F.min("path").alias("path")).join(
            self.blobs().select("blob"), "blob", "left_anti")
        unseen.write.parquet(f"{staged}-unseen")
        unseen = spark.read.schema("blob string, path string").parquet(f"{staged}-unseen")
        contents = files.select("path", "content").join(unseen, "path").select(F.col("blob").alias("path"), "content")
        dealt = dealt_by_size(contents, "path", F.length("content"), tasks)
        # the nodes and blobs of a version that was not finished are overwritten
        syntax_nodes(dealt, self.entities).write.mode("overwrite").parquet(f"{self.folder}/nodes/{version}")
        unseen.select("blob").write.mode("overwrite").parquet(f"{self.folder}/blobs/{version}")
        listing.write.mode("overwrite").parquet(f"{self.folder}/listing/{version}")
        return version

    def by_path(self, rows: DataFrame, version: int | None = None) -> DataFrame:
        """Rows whose `path` is a blob, for every path of a version with that blob."""
        listing = self.listing(version).select(F.col("path").alias("_path"), F.col("blob").alias("path"))
        return rows.join(listing, "path").withColumn("path", F.col("_path")).drop("_path")
