"""A corpus made ready for training: five stages over `documents`, each written before the next.

1. toxicity       documents that the model predicts as toxic go
2. near copies    one document of each class of near duplicates stays, that with the smallest id
3. benchmark      documents with a twentieth of their words in benchmark windows go
4. secrets        found secrets are replaced by a mark; n_chars follows
5. pieces         ids of the text (the last stage: doc_id, ids, n_tokens)

The first four return the columns of `documents`.  A stage judges what its
predecessor kept, row by row: rows are told apart by their doc_id (null is an id
like others) and the hash of their text, so a repeated doc_id with another text
is judged for itself.  Of equal rows the second stage keeps one.
Texts of any length are read whole; further columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import decontamination, neardup, pieces, secrets, toxicity
from corpuslens.llm.piece_queries import tokenizer_file
from corpuslens.llm.staging import table, written

# Learned scores, near-duplicate components and token ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    """The texts under a key of doc_id and text hash, for operators that take a doc_id."""
    return docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("doc_id"), "text")


def _without(docs: DataFrame, gone: DataFrame, many: bool = False) -> DataFrame:
    """Rows of docs whose key is not in gone(key).

    `many` is for keys that grow with the documents: always a merge join then,
    so that small tables take the plan that large ones need.
    """
    keys = gone.select(F.col("key.doc_id").alias("gone_id"), F.col("key.h").alias("gone_hash"))
    keys = keys.hint("merge") if many else keys
    return docs.join(keys, docs["doc_id"].eqNullSafe(keys["gone_id"]) & (F.xxhash64(docs["text"]) == keys["gone_hash"]), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.fit(spark, docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = written(spark, neardup.near_duplicates(spark, _keyed(docs)).withColumnRenamed("doc_id", "key"), "classes")
    kept = _without(docs, written(spark, classes.filter("key <> class_id").select("key").distinct(), "copies"), many=True)
    # equal rows are one key; they are few or none, and only they are made distinct
    again = classes.filter("key = class_id AND class_size > 1").groupBy("key").count().filter("count > 1").select("key")
    again = written(spark, again, "repeated")
    equal = docs.join(again, docs["doc_id"].eqNullSafe(again["key.doc_id"]) & (F.xxhash64(docs["text"]) == again["key.h"]), "left_semi")
    # rows are held in a struct, whatever their columns are called
    one = equal.select(F.struct(*docs.columns).alias("row"), F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key")).dropDuplicates(["key"]).select("row.*")
    return _without(kept, again).unionByName(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hits = decontamination.benchmark_hits(spark, _keyed(docs), table(spark, sf_dir, "benchmark"))
    bad = decontamination.contaminated(hits).filter("contaminated").select(F.col("doc_id").alias("key"))
    return _without(docs, written(spark, bad, "contaminated"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Findings are joined to the texts by their content address, of blobs that have some."""
    _, entries = secrets.scan_versions(spark, docs, path="doc_id")
    blobs = written(spark, entries.filter("size(findings) > 0").select("blob", "findings"), "found")
    # rows are held in a struct, whatever their columns are called
    rows = docs.select(F.struct(*docs.columns).alias("row"), secrets.blob_id(F.col("text")).alias("own"))
    joined = rows.join(blobs.hint("merge"), F.col("own") == F.col("blob"), "left")
    found, text = F.col("findings"), F.col("row.text")
    marked = joined.select("row", "findings", F.when(found.isNull(), text).otherwise(secrets.redact(text, found)).alias("marked"))
    columns = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("marked")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(found.isNull(), columns["n_chars"]).otherwise(F.length("marked")).cast(docs.schema["n_chars"].dataType)
    return marked.select(*[c.alias(n) for n, c in columns.items()])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary = pieces.read_vocabulary(tokenizer_file("piece_bpe_32k.model"))
    return pieces.encode_documents(docs, vocabulary).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("benchmark", drop_contaminated),
    ("secrets", redact_secrets),
    ("pieces", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`; each is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
