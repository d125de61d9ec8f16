"""Languages, key files, dependencies and frameworks of projects.

files(project, seq, path, content): `seq` is the listing order in the project;
`content` is null for a listed file that was not read.  A project may hold a
third of all files, so per-project results are either counts (combined map-side)
or top-k windows (cut to k per task before the shuffle).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslens import fixed_values as fv
from corpuslens.functions.text import basename, contains_any, extension, first_hit, readable_json, strip


def attach_contents(paths: DataFrame, contents: DataFrame) -> DataFrame:
    """Listed paths with their contents where there is one."""
    return paths.join(contents.withColumn("read_ok", F.lit(True)), "path", "left").withColumn(
        "read_ok", F.coalesce("read_ok", F.lit(False)))


# --- language ---------------------------------------------------------------
def language_table(spark: SparkSession) -> DataFrame:
    """53 fixed rows: safe to broadcast at any corpus size."""
    return spark.createDataFrame(list(fv.LANGUAGE_BY_EXTENSION.items()), "ext string, language string")


def language_by_extension(files: DataFrame) -> DataFrame:
    table = F.broadcast(language_table(files.sparkSession).withColumnRenamed("language", "ext_language"))
    return files.withColumn("ext", F.lower(extension(F.col("path")))).join(table, "ext", "left")


def language_by_name() -> Column:
    name = F.lower(basename(F.col("path")))
    return (
        F.when(name == "dockerfile", "dockerfile").when(name.isin(fv.MAKEFILE_NAMES), "makefile")
        .when(F.startswith(name, F.lit("requirements")) & F.endswith(name, F.lit(".txt")), "requirements")
        .when(name.isin(fv.IGNORE_NAMES), "ignore")
    )


def language_by_shebang() -> Column:
    first_line = F.substring_index("content", "\n", 1)
    language = first_hit(first_line, [(lang, [word]) for word, lang in fv.SHEBANG_LANGUAGES])
    return F.when(F.startswith(first_line, F.lit("#!")), language)


def language_by_content(probe: int | None = fv.CONTENT_PROBE_CHARS) -> Column:
    """Language by telling words in the first `probe` characters, or in the whole content (None)."""
    head = F.col("content") if probe is None else F.left(F.col("content"), F.lit(probe))
    has = lambda word: F.contains(head, F.lit(word))
    return (
        F.when(has("<?php"), "php")
        .when(contains_any(F.lower(head), ["<html", "<!doctype html"]), "html")
        .when(has("import React") | has("from 'react'"), "jsx")
        .when(has("package ") & has("import ") & has("{"), "java")
        .when(has("#include") & (has(".h") | has(".hpp")), "cpp")
    )


def detect_language(files: DataFrame, given: str | None = None, probe: int | None = fv.CONTENT_PROBE_CHARS) -> DataFrame:
    """Adds language and decided_by: given, extension, name, shebang, content or default.

    `given` names a column with the caller's language; empty and `unknown` fall back to detection.
    """
    known = F.when(~F.coalesce(F.col(given), F.lit("")).isin("", "unknown"), F.col(given)) if given else F.lit(None).cast("string")
    steps = [
        ("given", known),
        ("extension", F.col("ext_language")), ("name", language_by_name()),
        ("shebang", language_by_shebang()), ("content", language_by_content(probe)),
    ]
    decided = reduce(lambda w, s: w.when(s[1].isNotNull(), s[0]), steps[1:], F.when(steps[0][1].isNotNull(), steps[0][0]))
    return language_by_extension(files).select(
        *files.columns, F.coalesce(*[c for _, c in steps], F.lit("unknown")).alias("language"),
        decided.otherwise("default").alias("decided_by"),
    )


def read_files(files: DataFrame) -> DataFrame:
    return files.filter("content IS NOT NULL")


def language_counts(files: DataFrame) -> DataFrame:
    """project, language, n and first_seen over files that were read."""
    return detect_language(read_files(files)).groupBy("project", "language").agg(
        F.count("*").alias("n"), F.min(F.struct("seq", "path")).alias("first_seen"))


def language_summary(files: DataFrame) -> DataFrame:
    """Largest first, ties by first seen; `unknown` is left out."""
    by_size = W.partitionBy("project").orderBy(F.desc("n"), "first_seen")
    return language_counts(files).filter("language <> 'unknown'").select(
        "project", "language", "n", F.row_number().over(by_size).alias("rank"))


def file_entries(files: DataFrame) -> DataFrame:
    """`path (language)`; an unread file is listed by its path alone."""
    entry = F.when(F.col("content").isNull(), F.col("path")).otherwise(
        F.concat("path", F.lit(" ("), "language", F.lit(")")))
    return detect_language(files).select("project", "seq", "path", "language", entry.alias("entry"))


def file_list(files: DataFrame, limit: int | None = fv.LISTED_FILES) -> DataFrame:
    """The first `limit` entries per project with the project's total.

    With None all entries, without ranks: nothing is gathered by project then.
    """
    entries = file_entries(files)
    in_order = W.partitionBy("project").orderBy("seq", "path")
    shown = entries.select("project", "seq", "path", "entry")
    if limit is None:
        shown = shown.withColumn("rank", F.lit(None).cast("int"))
    else:
        shown = shown.withColumn("rank", F.row_number().over(in_order)).filter(F.col("rank") <= limit)
    totals = files.groupBy("project").agg(F.count("*").alias("total"))
    return shown.join(totals, "project").select("project", "rank", "entry", "total")


def main_languages(files: DataFrame, limit: int | None = fv.TOP_LANGUAGES) -> DataFrame:
    """Top languages per project (all with None) by trailing `(language)`; ties by first seen."""
    counted = (
        file_entries(files).withColumn("language", F.regexp_extract("entry", r"(?d)\((.*?)\)$", 1))
        .filter(F.col("entry").rlike(r"(?d)\((.*?)\)$"))
        .groupBy("project", "language").agg(F.count("*").alias("n"), F.min(F.struct("seq", "path")).alias("first_seen"))
    )
    best = W.partitionBy("project").orderBy(F.desc("n"), "first_seen")
    ranked = counted.withColumn("rank", F.row_number().over(best)).select("project", "language", "n", "rank")
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def file_stats(files: DataFrame) -> DataFrame:
    """Total files and language map per project."""
    totals = files.groupBy("project").agg(F.count("*").alias("total_files"))
    maps = language_counts(files).groupBy("project").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("languages"))
    return totals.join(maps, "project", "left")


# --- key files --------------------------------------------------------------
def key_files(files: DataFrame, limit: int | None = fv.KEY_FILE_LIMIT) -> DataFrame:
    """project, path, tier, rank: at most `limit` files per project.

    With None all that the tiers let through, without ranks.

    Tier 1 are known names, tier 2 telling words in the name, tier 3 long files.
    A later tier counts only while fewer than 10 files were found.  No tier can
    contribute more than the limit, so each is cut to it before the gates are
    evaluated: at most three times as many rows per project meet in one place.
    """
    name = basename(F.col("path"))
    exact = F.array_position(F.lit(fv.KEY_FILE_NAMES), name)
    tier = (
        F.when(exact > 0, 1)
        .when(contains_any(F.lower(name), fv.KEY_FILE_WORDS), 2)
        .when(F.length("content") > fv.KEY_FILE_MIN_CHARS, 3)
    )
    candidates = files.select(
        "project", "seq", "path", tier.alias("tier"), F.when(tier == 1, exact).otherwise(0).alias("pattern")
    ).filter("tier IS NOT NULL")
    gate = fv.KEY_FILE_GATE
    passes = (
        (F.col("tier") == 1)
        | ((F.col("tier") == 2) & (F.col("n1") < gate))
        | ((F.col("tier") == 3) & (F.col("n2") < gate))
    )
    if limit is None:
        up_to = lambda t: F.count_if(F.col("tier") <= t)
        counts = candidates.groupBy("project").agg(up_to(1).alias("n1"), up_to(2).alias("n2"))
        return candidates.join(counts, "project").filter(passes).select("project", "path", "tier", F.lit(None).cast("int").alias("rank"))
    # the gates look at fewer than ten files, so a cut below that would change them
    kept = max(limit, gate)
    per_tier = W.partitionBy("project", "tier").orderBy("pattern", "seq", "path")
    leading = candidates.withColumn("tier_rank", F.row_number().over(per_tier)).filter(
        F.col("tier_rank") <= kept)
    per_project = W.partitionBy("project")
    found = lambda t: F.count_if(F.col("tier") <= t).over(per_project)
    gated = leading.withColumn("n1", found(1)).withColumn("n2", found(2)).filter(passes)
    in_order = per_project.orderBy("tier", "tier_rank")
    return gated.withColumn("rank", F.row_number().over(in_order)).filter(
        F.col("rank") <= limit).select("project", "path", "tier", "rank")


def of_key_files(rows: DataFrame, key: DataFrame | None) -> DataFrame:
    """Rows (project, path, ...) of key files only; all rows without `key`.

    Called on names that were found, never on contents: only small arrays move.
    """
    return rows if key is None else rows.join(key.select("project", "path"), ["project", "path"], "left_semi")


# --- dependencies: arrays of names found in one content ----------------------
def _all_matches(pattern: str) -> Column:
    return F.regexp_extract_all("content", F.lit(pattern), F.lit(1))


def _is_python() -> Column:
    return F.lower(extension(F.col("path"))) == ".py"


def _python_modules(*matches: Column) -> Column:
    """Top-level modules, the standard ones of a fixed list left out."""
    top = F.transform(F.concat(*matches), lambda m: F.substring_index(m, ".", 1))
    return F.filter(F.array_distinct(top), lambda m: ~m.isin(fv.PYTHON_STD_MODULES))


def _is_javascript() -> Column:
    return F.lower(extension(F.col("path"))).isin(fv.JS_EXTENSIONS)


def _javascript_packages() -> Column:
    return F.array_union(_all_matches(fv.JS_IMPORT_PATTERN), _all_matches(fv.JS_REQUIRE_PATTERN))


def _is_named(name: str) -> Column:
    return basename(F.col("path")) == name


def _manifest_keys() -> Column:
    """Keys of dependencies and devDependencies; none when the manifest is broken.

    A repeated key is no error, as for most JSON readers.
    """
    manifest = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    keys = lambda part: F.coalesce(F.map_keys(manifest[part]), F.array().cast("array<string>"))
    return F.when(readable_json(F.col("content")), F.array_union(keys("dependencies"), keys("devDependencies")))


def _required_packages() -> Column:
    """Names of a requirements file, version marks cut off."""
    lines = F.filter(F.split("content", "\n"), lambda l: ~F.startswith(strip(l), F.lit("#")))
    names = F.transform(lines, lambda l: strip(F.get(F.split(strip(l), "[=<>~]"), F.lit(0))))
    return F.filter(F.array_distinct(names), lambda n: n != "")


def _found(files: DataFrame, declares: Column, key: DataFrame | None, **names: Column) -> DataFrame:
    """Arrays of names in the contents of declaring files, then those of key files."""
    found = read_files(files).filter(declares).select("project", "path", *[c.alias(n) for n, c in names.items()])
    return of_key_files(found, key)


def _exploded(found: DataFrame) -> DataFrame:
    return found.select("project", "path", F.explode("names").alias("dependency"))


def python_dependencies(files: DataFrame, key: DataFrame | None = None) -> DataFrame:
    """Imported top-level modules.  `import X` also matches the tail of a
    from-import; a name found in no other way is kept and flagged."""
    tail = rf"{fv.PYTHON_FROM_PATTERN}(?U:\s+)([a-zA-Z0-9_.]+)"
    tails = F.regexp_extract_all("content", F.lit(tail), F.lit(2))
    imported, named = _all_matches(fv.PYTHON_IMPORT_PATTERN), _all_matches(fv.PYTHON_FROM_PATTERN)
    found = _found(files, _is_python(), key, certain=_python_modules(F.array_except(imported, tails), named),
                   names=_python_modules(imported, named))
    return found.select("project", "path", "certain", F.explode("names").alias("dependency")).select(
        "project", "path", "dependency", (~F.array_contains("certain", F.col("dependency"))).alias("is_import_tail"))


def javascript_dependencies(files: DataFrame, key: DataFrame | None = None) -> DataFrame:
    """Packages imported or required, relative ones left out."""
    return _exploded(_found(files, _is_javascript(), key, names=_javascript_packages()))


def package_json_dependencies(files: DataFrame, key: DataFrame | None = None) -> DataFrame:
    return _exploded(_found(files, _is_named("package.json"), key, names=_manifest_keys()))


def requirements_dependencies(files: DataFrame, key: DataFrame | None = None) -> DataFrame:
    return _exploded(_found(files, _is_named("requirements.txt"), key, names=_required_packages()))


def dependencies(files: DataFrame, key: DataFrame | None = None) -> DataFrame:
    """Distinct (project, dependency) over the key files.

    Names are found where the contents lie; the join with the key files and the
    distinct move names only.
    """
    names = (
        F.when(_is_python(), _python_modules(
            _all_matches(fv.PYTHON_IMPORT_PATTERN), _all_matches(fv.PYTHON_FROM_PATTERN)))
        .when(_is_javascript(), _javascript_packages())
        .when(_is_named("package.json"), _manifest_keys())
        .when(_is_named("requirements.txt"), _required_packages())
    )
    declares = _is_python() | _is_javascript() | _is_named("package.json") | _is_named("requirements.txt")
    found = _found(files, declares, key_files(files) if key is None else key, names=names)
    return _exploded(found).select("project", "dependency").distinct()


# --- frameworks and file facts ----------------------------------------------
def framework_names() -> Column:
    """Framework names occurring in the content, in dictionary order; null for
    languages without a list.  The content is lowered once per file."""
    names = F.create_map(*[
        c for language, words in fv.FRAMEWORKS.items() for c in (F.lit(language), F.lit(words))])
    found = F.transform(F.array(F.lower("content")), lambda text: F.filter(
        F.try_element_at(names, F.col("language")), lambda n: F.contains(text, n)))
    return F.filter(found, lambda hits: F.size(hits) > 0)


def frameworks(files: DataFrame) -> DataFrame:
    """One row per file with a hit.  Map-only: the fixed lists are one literal."""
    return detect_language(read_files(files)).filter(F.col("language").isin(list(fv.FRAMEWORKS))).select(
        "path", "language", F.explode(framework_names()).alias("frameworks"))


def file_facts(files: DataFrame) -> DataFrame:
    return files.select(
        "path", basename(F.col("path")).alias("file_name"), extension(F.col("path")).alias("file_extension"))
