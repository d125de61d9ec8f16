"""Secret scan over an incremental ledger of blobs.

Every historical version of every path is content-addressed by the SHA-256 of
its text.  The ledger holds one entry for a blob and the rule versions it was
scanned with; only pairs of blob and rule version that it lacks are scanned, and
each blob once however many paths and versions hold it.  Findings are then
joined back to all paths.

Moved data: hashes and ids (two small shuffles), and the texts of unseen blobs
once.  A blob that a third of all rows hold is one row after the partial
aggregate; joining its findings back is a join on a unique right side, which
adaptive execution splits.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.staging import written

# executors need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Rule:
    """A pattern and the length its checked group needs; a changed rule gets a new version."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


# --- fixed values: the rules in the order of their kinds; the first three are the base ------------
_ANY_CASE = lambda word: "".join(f"[{c.upper()}{c}]" for c in word)
_NAMES = "|".join([_ANY_CASE("password"), _ANY_CASE("passwd"), _ANY_CASE("secret"), _ANY_CASE("token"),
                   _ANY_CASE("api") + "_?" + _ANY_CASE("key")])
BASE_RULES = [
    Rule("assign", 1, rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]+", 0, 16),
]
MORE_RULES = [
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("forge_token", 1, r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", 1, r"xox[abpr]-[A-Za-z0-9-]{10,}"),
]
RULES = BASE_RULES + MORE_RULES

LEDGER = "blob string, rules array<string>, findings array<struct<rule: string, kind: string, start: int, end: int>>"


def find_spans(text: str, rules: Iterable[Rule]) -> list[tuple[str, str, int, int]]:
    """(rule, kind, start, end) in code points: leftmost matches of each rule, not
    overlapping within it, of which those with a too short group are dropped.

    Sorted by start, then in the order of the rules.
    """
    found = []
    for order, rule in enumerate(rules):
        for m in _compiled(rule)(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((m.start(), order, rule.id, rule.kind, m.end()))
    return [(rule, kind, start, end) for start, _, rule, kind, end in sorted(found)]


_cache: dict = {}


def _compiled(rule: Rule):
    """finditer of a rule.

    A rule that is one class repeated matches whole runs, so its least length
    can go into the pattern; other rules keep their short matches, which hide
    what they cover.
    """
    if rule not in _cache:
        pattern = rule.pattern
        if rule.group == 0 and rule.least and re.fullmatch(r"\[[^]]+\]\+", pattern):
            pattern = pattern[:-1] + f"{{{rule.least},}}"
        _cache[rule] = re.compile(pattern).finditer
    return _cache[rule]


def blob_id(text: Column) -> Column:
    """Content address of a text; null is the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_unseen(
    spark: SparkSession, versions: DataFrame, ledger: DataFrame | None = None, path: str = "path", text: str = "text",
    rules: list[Rule] = RULES,
) -> DataFrame:
    """New ledger entries: every blob of `versions` with the rules it was not yet scanned with.

    `ledger` has the columns of LEDGER, any number of rows for a blob; entries
    of older rule versions may stay in it.  Append the result to it.
    """
    wanted = F.array(*[F.lit(r.id) for r in rules])
    blobs = versions.select(blob_id(F.col(text)).alias("blob"), F.col(path).alias("path")).groupBy("blob").agg(
        F.min("path").alias("path"))
    if ledger is not None:
        # of the whole ledger only the entries of this batch's blobs
        ours = ledger.select("blob", "rules").join(blobs.select("blob"), "blob", "left_semi")
        seen = ours.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(seen, "blob", "left")
    else:
        blobs = blobs.withColumn("seen", F.array().cast("array<string>"))
    todo = blobs.select("blob", F.col("path").alias("at"), F.array_except(
        wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("missing")).filter("size(missing) > 0")
    todo = written(spark, todo, "unseen")  # its size is then known: a small rest is broadcast, and no text is shuffled
    # the row that holds each blob, by path and blob: copies of a hot blob lie at many paths, versions of a hot path are many blobs
    texts = versions.select(F.col(path).alias("at"), blob_id(F.col(text)).alias("own"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    held = texts.join(todo, texts["at"].eqNullSafe(todo["at"]) & (F.col("own") == F.col("blob"))).select("blob", "missing", "text")
    by_id = {r.id: r for r in rules}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            findings, missing = [], batch.column("missing").to_pylist()
            for one, ids in zip(batch.column("text"), missing):
                findings.append([dict(zip(("rule", "kind", "start", "end"), f))
                                 for f in find_spans(one.as_py(), [by_id[i] for i in ids])])
            yield pa.RecordBatch.from_arrays(
                [batch.column("blob"), pa.array(missing, _RULES), pa.array(findings, _FINDINGS)], ["blob", "rules", "findings"])

    entries = held.mapInArrow(scan, LEDGER)
    # a path may hold the same text twice
    return entries.groupBy("blob").agg(F.first("rules").alias("rules"), F.first("findings").alias("findings"))


_RULES = pa.list_(pa.string())
_FINDINGS = pa.list_(pa.struct([("rule", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan_versions(
    spark: SparkSession, versions: DataFrame, ledger: DataFrame | None = None, path: str = "path", text: str = "text",
    rules: list[Rule] = RULES,
) -> tuple[DataFrame, DataFrame]:
    """(findings of all paths, new ledger entries).

    The first holds a row for each row of `versions`: path, blob, and findings in
    ascending (start, order of the rules), of the rule versions asked for only.
    The second is written and is to be appended to the ledger.

    Defined cases: a null text is the empty text; a null path is a path like
    others; repeated rows each give a row, and their blob is scanned once; empty
    tables give no rows; further columns are not read, whatever their names.
    """
    new = written(spark, scan_unseen(spark, versions, ledger, path, text, rules), "ledger")
    ids = [r.id for r in rules]
    rows = versions.select(F.col(path).alias("path"), blob_id(F.col(text)).alias("blob"))
    known = new if ledger is None else new.unionByName(ledger.select("blob", "rules", "findings").join(rows.select("blob").distinct(), "blob", "left_semi"))
    order = F.array(*[F.lit(i) for i in ids])
    if ledger is not None:
        # entries of one blob, at most one for each batch that met it; written first, as a join with the
        # aggregate itself could not be split where many rows hold a blob
        known = written(spark, known.groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("findings")), "known")
    asked = F.filter("findings", lambda f: F.array_contains(order, f["rule"]))
    ranked = F.array_sort(F.transform(asked, lambda f: F.struct(
        f["start"].alias("start"), F.array_position(order, f["rule"]).alias("rank"), f["end"].alias("end"),
        f["rule"].alias("rule"), f["kind"].alias("kind"))))
    known = known.select("blob", F.transform(F.array_distinct(ranked), lambda f: F.struct(
        f["rule"].alias("rule"), f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end"))).alias("findings"))
    return rows.join(known, "blob", "left").select("path", "blob", "findings"), new


def redact(text: Column, findings: Column, mark: str = "[secret]") -> Column:
    """The text with every found span, overlapping ones together, replaced by `mark`."""
    start = F.array_min(F.transform(findings, lambda f: f["start"]))
    empty = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda s, f: F.struct(
        F.when(f["end"] <= s["at"], s["out"])
        .when(f["start"] < s["at"], s["out"])
        .otherwise(F.concat(s["out"], F.substring(text, s["at"] + 1, f["start"] - s["at"]), F.lit(mark))).alias("out"),
        F.greatest(s["at"], f["end"]).alias("at"))
    done = F.aggregate(findings, empty, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(text.isNull() | start.isNull(), text).otherwise(done)
