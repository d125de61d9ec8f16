"""Model answers about single files, as JSON or plain text, made into structs.

Every function is row-local: sections and list items come from array and string
functions over the answer text, so nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens import fixed_values as fv
from corpuslens.functions.lenient import read_json
from corpuslens.functions.text import basename, extension, first_hit, readable_json, strip, strip_sql

# --- fixed values: shape of a file answer ------------------------------------
FILE_ANSWER = """struct<
 code_quality: struct<score: int, strengths: array<string>, weaknesses: array<string>>,
 variables: struct<important_variables: array<struct<name: string, type: string, purpose: string,
   transformations: array<string>>>>,
 functions: struct<count: int, important_functions: array<struct<name: string, purpose: string,
   parameters: array<string>, return_value: string>>>,
 classes: struct<count: int, important_classes: array<struct<name: string, purpose: string,
   properties: array<string>, methods: array<string>>>>,
 external_communications: struct<apis: array<struct<name: string, purpose: string, method: string>>,
   databases: array<struct<type: string, operations: array<string>>>, file_operations: array<string>>,
 data_transformations: array<struct<description: string, input: string, output: string, type: string>>,
 architecture: struct<patterns: array<string>, anti_patterns: array<string>, suggestions: array<string>>,
 security: struct<vulnerabilities: array<string>, severity: string, mitigations: array<string>>,
 summary: string>"""

_QUOTED = (r"`([^`]+)`", r'"([^"]+)"', r"'([^']+)'")
_ITEM = r"^(?:[-*.] |\p{Nd}{1,2}\. )"


def is_json(raw: Column) -> Column:
    return readable_json(raw)


def parse_json(answers: DataFrame) -> DataFrame:
    """Adds parsed_from (json or text) and, for JSON, the answer struct; members of another type are read as they can be."""
    valid = is_json(F.col("raw"))
    shape = T.DataType.fromDDL(FILE_ANSWER.replace("\n", " "))
    return answers.withColumn("parsed_from", F.when(valid, "json").otherwise("text")).withColumn(
        "answer", F.when(valid, read_json(F.col("raw"), shape)))


# --- text tools ---------------------------------------------------------------
def sections(rows: DataFrame, text: str, names: list[str]) -> DataFrame:
    """Adds `section_<name>`: the text from the first occurrence of the name to the
    nearest later header, stripped, without its first line; empty when there is none.

    The lowered text and the starts are columns of their own, so that they are
    computed once per row and not once per header.
    """
    lowered = rows.select("*", F.lower(text).alias("lowered"))
    started = lowered.select("*", *[F.locate(n, F.col("lowered")).alias(f"start_{n}") for n in names])
    cut = started.select("*", *[F.expr(_section_sql(text, n)).alias(f"body_{n}") for n in names])
    after_first_line = lambda body: strip_sql(f"substring({body}, locate(chr(10), {body}) + 1)")
    later_lines = lambda body: f"CASE WHEN contains({body}, chr(10)) THEN {after_first_line(body)} ELSE '' END"
    return cut.select(*rows.columns, *[F.expr(later_lines(f"`body_{n}`")).alias(f"section_{n}") for n in names])


def _section_sql(text: str, name: str) -> str:
    headers = ", ".join(f"'{h}'" for h in fv.SECTION_HEADERS if h != name)
    start = f"`start_{name}`"
    later = f"filter(transform(array({headers}), h -> locate(h, lowered, {start} + {len(name)})), at -> at > 0)"
    end = f"coalesce(array_min({later}), length({text}) + 1)"
    return f"CASE WHEN {start} > 0 THEN {strip_sql(f'substring({text}, {start}, {end} - {start})')} ELSE '' END"


def list_items(text: str) -> Column:
    """Bulleted and numbered lines of a text column, marks removed.

    A bare mark does not count: stripping a line removes the blank after it.
    """
    lines = f"transform(split({text}, chr(10)), l -> {strip_sql('l')})"
    marked = f"filter({lines}, l -> l rlike r'{_ITEM}')"
    return F.expr(f"transform({marked}, l -> {strip_sql(f"regexp_replace(l, r'{_ITEM}', '')")})")


def quoted_name(item: Column) -> Column:
    """First quoted name of an item, by position in the text."""
    first = F.regexp_extract(item, "|".join(f"(?:{q})" for q in _QUOTED), 0)
    return F.when(first == "", "unknown").otherwise(first.substr(F.lit(2), F.length(first) - 2))


def _has(text: Column, *words: str) -> Column:
    lowered = F.lower(text)
    out = F.lit(False)
    for word in words:
        out = out | F.contains(lowered, F.lit(word))
    return out


# --- figures and lists of a plain-text answer ---------------------------------
def quality_score(text: Column) -> Column:
    """All digits of the last line on code quality that stay within 0..100."""
    lines = F.filter(F.split(text, "\n"), lambda l: _has(l, "code quality") & _has(l, "score"))
    digits = F.transform(lines, lambda l: F.regexp_replace(l, r"[^0-9]", "").try_cast("int"))
    valid = F.filter(digits, lambda d: d.isNotNull() & d.between(0, 100))
    return F.coalesce(F.try_element_at(valid, F.lit(-1)), F.lit(0))


def mentioned_count(part: Column, pattern: str) -> Column:
    found = F.regexp_extract(F.lower(part), pattern, 1)
    return F.coalesce(found.try_cast("int"), F.lit(0))


def severity(part: Column) -> Column:
    return (
        F.when(_has(part, "high") & _has(part, "severity"), "high")
        .when(_has(part, "medium") & _has(part, "severity"), "medium").otherwise("low")
    )


def summary(part: Column) -> Column:
    """First paragraph of the section."""
    first = strip(F.substring_index(part, "\n\n", 1))
    return F.when(first == "", fv.NO_SUMMARY).otherwise(first)


def transformation_kind(description: Column) -> Column:
    return first_hit(F.lower(description), fv.TRANSFORMATION_KINDS, default="other")


ANSWER_COLUMNS = ["code_quality", "variables", "functions", "classes", "external_communications",
                  "data_transformations", "architecture", "security", "summary"]


_LISTED_SECTIONS = ["strength", "weakness", "variable", "function", "class", "api", "transformation", "security"]


def _with_sections(parsed: DataFrame) -> DataFrame:
    """Adds the sections of plain texts and their list items, each computed once."""
    texts = parsed.select("*", F.when(F.col("parsed_from") == "text", F.col("raw")).alias("text"))
    cut = sections(texts, "text", [*_LISTED_SECTIONS, "summary"])
    return cut.select("*", *[list_items(f"section_{n}").alias(f"items_{n}") for n in _LISTED_SECTIONS])


def _text_parts() -> dict[str, Column]:
    """The answer's columns for a plain text, with defaults where a section is missing."""
    text, blank, none = F.col("text"), F.lit(""), F.array().cast("array<string>")

    def named(name: str, **rest: Column | None) -> Column:
        return F.transform(f"items_{name}", lambda item: F.struct(
            quoted_name(item).alias("name"), *[(item if v is None else v).alias(n) for n, v in rest.items()]))

    apis = named("api", purpose=None, method=blank)
    return {
        "code_quality": F.struct(
            quality_score(text).alias("score"), F.col("items_strength").alias("strengths"),
            F.col("items_weakness").alias("weaknesses")),
        "variables": F.struct(named(
            "variable", type=F.lit("unknown"), purpose=None, transformations=none).alias("important_variables")),
        "functions": F.struct(
            mentioned_count(F.col("section_function"), r"(?U)(\d+)\s+functions?").alias("count"),
            named("function", purpose=None, parameters=none, return_value=blank).alias("important_functions")),
        "classes": F.struct(
            mentioned_count(F.col("section_class"), r"(?U)(\d+)\s+classes?").alias("count"),
            named("class", purpose=None, properties=none, methods=none).alias("important_classes")),
        "external_communications": F.struct(
            apis.alias("apis"), F.array().cast("array<struct<type:string,operations:array<string>>>").alias("databases"),
            none.alias("file_operations")),
        "data_transformations": F.transform("items_transformation", lambda item: F.struct(
            item.alias("description"), blank.alias("input"), blank.alias("output"),
            F.lit(None).cast("string").alias("type"))),
        "architecture": F.struct(none.alias("patterns"), none.alias("anti_patterns"), none.alias("suggestions")),
        "security": F.struct(
            F.col("items_security").alias("vulnerabilities"), severity(F.col("section_security")).alias("severity"),
            none.alias("mitigations")),
        "summary": summary(F.col("section_summary")),
    }


def structured(answers: DataFrame) -> DataFrame:
    """file answers -> parsed_from and one column per part, whatever the form.

    Parts stay separate columns: a reader of one part computes only that part.
    Missing transformation kinds are inferred from the descriptions.
    """
    parsed = parse_json(answers)
    texts = _text_parts()
    shape = parsed.schema["answer"].dataType
    whole = lambda n: F.when(F.col("parsed_from") == "json", F.col("answer")[n]).otherwise(texts[n].cast(shape[n].dataType))
    with_kind = F.transform(whole("data_transformations"), lambda t: F.struct(
        t["description"].alias("description"), t["input"].alias("input"), t["output"].alias("output"),
        F.coalesce(t["type"], transformation_kind(F.coalesce(t["description"], F.lit("")))).alias("type")))
    return _with_sections(parsed).select(
        *answers.columns, "parsed_from",
        *[(with_kind if n == "data_transformations" else whole(n)).alias(n) for n in ANSWER_COLUMNS],
    )


def enhanced(structured_answers: DataFrame, files: DataFrame) -> DataFrame:
    """Adds path facts, language and frameworks of the file that was asked about.

    One pass over the files gathers all of them, so contents never reach the join.
    """
    from corpuslens.operators import project

    read = F.col("content").isNotNull()
    facts = project.detect_language(files).select(
        F.col("path").alias("file"), basename(F.col("path")).alias("file_name"),
        extension(F.col("path")).alias("file_extension"), F.when(read, F.col("language")).alias("language"),
        F.get(project.framework_names(), F.lit(0)).alias("frameworks"))
    return structured_answers.join(facts, "file", "left")
