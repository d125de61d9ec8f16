"""Prompt tables and the answers attached back to their subjects.

No model is called: prompts leave as a table of distinct texts, answers come
back as a table keyed by the prompt's hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslens import fixed_values as fv
from corpuslens.functions.text import basename, fill, is_blank
from corpuslens.operators import project


def prompt_text(content_type: Column, text: Column) -> Column:
    head = None
    for kind, words in fv.EXPLAIN_PROMPTS.items():
        if kind != "other":
            head = (F.when if head is None else head.when)(content_type == kind, words)
    return F.concat(head.otherwise(fv.EXPLAIN_PROMPTS["other"]), text)


def prompt_hash(content_type: Column, text: Column) -> Column:
    return F.sha2(prompt_text(content_type, text), 256)


def explain_prompts(subjects: DataFrame) -> DataFrame:
    """subjects(content_type, text) -> distinct prompts; each text is asked once.

    The group key is the hash.  The witness of a group is its text, so each task sorts
    its prompts by hash and keeps one of each before the shuffle.
    """
    prompt = prompt_text(F.col("content_type"), F.col("text"))
    return (
        subjects.select("content_type", prompt.alias("prompt")).withColumn("prompt_hash", F.sha2("prompt", 256))
        .groupBy("prompt_hash").agg(F.min("content_type").alias("content_type"), F.min("prompt").alias("prompt"))
    )


def subjects(queries: DataFrame, transformations: DataFrame, rules: DataFrame) -> DataFrame:
    """Everything that gets explained: queries, transformations, business rules."""
    pick = lambda df, kind, text: df.select(F.lit(kind).alias("content_type"), text.alias("text"))
    return (
        pick(queries.filter(~is_blank(F.col("sql"))), "sql", F.col("sql"))
        .unionByName(pick(transformations, "transformation", F.coalesce("details", F.lit(""))))
        .unionByName(pick(rules, "business_rule", F.coalesce("condition", "full_call", F.lit(""))))
    )


def attach_explanations(rows: DataFrame, content_type: str, text: str, answers: DataFrame) -> DataFrame:
    """Adds `explanation`; null while there is no answer.

    One text may occur in a third of all rows: the answers are unique per hash
    and the join is left-outer, so adaptive execution can split the hot hash.
    """
    keyed = rows.withColumn("prompt_hash", prompt_hash(F.lit(content_type), F.col(text)))
    return keyed.join(answers.select("prompt_hash", F.col("answer").alias("explanation")), "prompt_hash", "left")


def file_prompts(files: DataFrame) -> DataFrame:
    """Analysis prompt per distinct (language, name, content): the same file is asked once.

    Distinct are the hashes; with each goes the first path that has it.  Contents are read
    again for those paths only, where they lie: when the files are bucketed by path, only
    paths and hashes are exchanged.  Paths are unique.
    """
    tail = F.lit(fv.FILE_PROMPT_TAIL)
    prompt = lambda language: F.concat(
        fill(fv.FILE_PROMPT_HEAD, language=language, filename=basename(F.col("path")), content=F.col("content")), tail)
    keys = project.detect_language(project.read_files(files)).select(
        "path", F.col("language").alias("content_type"), F.sha2(prompt(F.col("language")), 256).alias("prompt_hash"))
    # cut to one row for each hash in every task before the exchange
    first = W.partitionBy("prompt_hash").orderBy("path")
    chosen = keys.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    return files.select("path", "content").join(chosen, "path").select("prompt_hash", "content_type", prompt(F.col("content_type")).alias("prompt"))


WHOLE = 2_147_483_647  # as a limit: everything, still in order


def project_prompts(
    files: DataFrame, listed_files: int | None = fv.LISTED_FILES, key_files: int | None = fv.PROMPT_KEY_FILES,
    dependencies: int | None = fv.PROMPT_DEPENDENCIES,
) -> DataFrame:
    """One prompt per project: 100 files, languages, 10 key files, 20 dependencies; all of them with None.

    Dependencies are those of the project's key files, or of all candidates with `key_files` None.
    """
    bullet = lambda c: F.concat(F.lit("- "), c)
    ordered = lambda rank, text: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), text.alias("t")))), lambda s: s.t), "\n")
    listed = project.file_list(files, listed_files or WHOLE).groupBy("project").agg(
        F.count("*").alias("shown"), F.max("total").alias("total"), ordered("rank", F.col("entry")).alias("files"))
    languages = (
        project.language_summary(files).groupBy("project").agg(ordered("rank", F.concat(
            F.lit("- "), "language", F.lit(": "), F.col("n").cast("string"), F.lit(" files"))).alias("languages"))
    )
    key = project.key_files(files, fv.KEY_FILE_LIMIT if key_files else WHOLE)
    keys = key.filter(F.col("rank") <= (key_files or WHOLE)).groupBy("project").agg(
        ordered("rank", bullet(F.col("path"))).alias("key_files"))
    deps = first_dependencies(project.dependencies(files, key), dependencies or WHOLE).groupBy("project").agg(
        ordered("rank", bullet(F.col("dependency"))).alias("dependencies"))
    joined = listed
    for part in (languages, keys, deps):
        joined = joined.join(part, "project", "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    prompt = F.concat(fill(fv.PROJECT_PROMPT_HEAD, **{
        c: text(c) for c in ("shown", "total", "files", "languages", "key_files", "dependencies")
    }), F.lit(fv.PROJECT_PROMPT_TAIL))
    return joined.select("project", prompt.alias("prompt")).select(
        "project", F.sha2("prompt", 256).alias("prompt_hash"), F.lit("project").alias("content_type"), "prompt")


def first_dependencies(dependency_rows: DataFrame, limit: int) -> DataFrame:
    """The first dependencies per project, by name: a set has no order of its own."""
    by_name = W.partitionBy("project").orderBy("dependency")
    return dependency_rows.withColumn("rank", F.row_number().over(by_name)).filter(F.col("rank") <= limit)
