"""Answers about whole projects: structure, lineage graph and export.

answers(project, raw) holds one row per project.  A source, step, sink or
dependency may be a string or an object; elements stay text and are read as
JSON where they are objects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from corpuslens import fixed_values as fv
from corpuslens.functions.lenient import read_json
from corpuslens.functions.text import basename
from corpuslens.operators import project, prompts
from corpuslens.operators.answers import is_json

# --- fixed values: shape of a project answer -----------------------------------
PROJECT_ANSWER = """struct<project_type: string, main_languages: array<string>, architecture: string,
 entry_points: array<string>, dependencies: array<string>,
 code_lineage: struct<purpose: string, history: string, organization: string, complexity: string>,
 technical_stack: struct<frontend: array<string>, backend: array<string>, database: array<string>,
   infrastructure: array<string>>,
 data_flow: struct<sources: array<string>, transformations: array<string>, sinks: array<string>>,
 key_components: array<struct<name: string, purpose: string, files: array<string>>>,
 legacy_aspects: array<string>, modernization_opportunities: array<string>, summary: string>"""
_SHAPE = PROJECT_ANSWER.replace("\n", " ")
_DEPENDENCY = "array<struct<name: string, purpose: string, type: string>>"

_strings = lambda c: F.coalesce(c, F.array().cast("array<string>"))


def parse_projects(answers: DataFrame) -> DataFrame:
    """project, parsed_from (json or default), the answer struct; null when not JSON."""
    valid = is_json(F.col("raw"))
    return answers.select(
        "project", "raw", F.when(valid, "json").otherwise("default").alias("parsed_from"),
        F.when(valid, read_json(F.col("raw"), T.DataType.fromDDL(_SHAPE))).alias("a"))


def _member(element: Column, name: str, default: Column) -> Column:
    """A member of an object element, its default where missing; null for plain strings."""
    is_object = element.rlike(r"^\s*\{") & F.try_parse_json(element).isNotNull()
    return F.when(is_object, F.coalesce(F.get_json_object(element, f"$.{name}"), default))


def _label(element: Column, kind: str, at: Column) -> Column:
    """The string itself, or the object's name, or a numbered default."""
    return F.coalesce(_member(element, "name", F.concat(F.lit(f"{kind} "), at.cast("string"))), element)


# --- default structure -----------------------------------------------------------
def project_structures(
    answers: DataFrame, files: DataFrame, key_files: int | None = fv.KEY_FILE_LIMIT, entry_files: int | None = 5,
    guessed: int | None = fv.PROMPT_DEPENDENCIES, default_dependencies: int | None = 10, top_languages: int | None = fv.TOP_LANGUAGES,
) -> DataFrame:
    """One full structure per project.  A limit of None keeps all.

    JSON answers get file statistics and default dependencies; an answer that is
    not JSON is replaced by a default built from languages, key files and
    dependencies.
    """
    d = fv.DEFAULT_PROJECT
    whole = prompts.WHOLE
    key = project.key_files(files, key_files or whole)
    deps = prompts.first_dependencies(project.dependencies(files, key), max(guessed or whole, default_dependencies or whole))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda s: s[c])
    languages = project.main_languages(files, top_languages).groupBy("project").agg(ordered("language").alias("top_languages"))
    entries = key.filter(F.col("rank") <= (entry_files or whole)).groupBy("project").agg(ordered("path").alias("entry_files"))
    found = deps.groupBy("project").agg(ordered("dependency").alias("found_deps"))
    joined = parse_projects(answers)
    for part in (languages, entries, found, project.file_stats(files)):
        joined = joined.join(part, "project", "left")

    is_json_answer = F.col("parsed_from") == "json"
    pick = lambda given, default: F.when(is_json_answer, given).otherwise(default)
    as_struct = lambda names, purpose, kind: F.transform(
        names, lambda n: F.struct(n.alias("name"), purpose.alias("purpose"), kind.alias("type")))
    given = F.transform(_strings(F.col("a.dependencies")), lambda e, i: F.struct(
        _label(e, "Dependency", i).alias("name"), F.coalesce(_member(e, "purpose", F.lit("")), F.lit("")).alias("purpose"),
        F.coalesce(_member(e, "type", F.lit("library")), F.lit("library")).alias("type")))
    first = lambda n: F.slice(_strings(F.col("found_deps")), 1, n or whole)
    guessed = as_struct(first(guessed), F.lit(d["unknown"]), F.lit("library"))
    default_deps = as_struct(first(default_dependencies), F.lit(d["unknown"]), F.lit(d["unknown"]))
    unknown = F.lit(d["unknown"])
    lineage = lambda purpose: F.struct(purpose.alias("purpose"), unknown.alias("history"),
                                       unknown.alias("organization"), unknown.alias("complexity"))
    none = F.array().cast("array<string>")
    empty_stack = F.struct(*[none.alias(n) for n in ("frontend", "backend", "database", "infrastructure")])
    empty_flow = F.struct(*[none.alias(n) for n in ("sources", "transformations", "sinks")])
    return joined.select(
        "project", "parsed_from",
        pick(F.col("a.project_type"), F.lit(d["project_type"])).alias("project_type"),
        pick(F.col("a.main_languages"), _strings(F.col("top_languages"))).alias("main_languages"),
        pick(F.col("a.architecture"), F.lit(d["architecture"])).alias("architecture"),
        pick(F.col("a.entry_points"), _strings(F.col("entry_files"))).alias("entry_points"),
        F.when(is_json_answer & (F.size(_strings(F.col("a.dependencies"))) > 0), given)
        .when(is_json_answer, guessed).otherwise(default_deps).cast(_DEPENDENCY).alias("dependencies"),
        pick(F.coalesce("a.code_lineage", lineage(unknown)), lineage(F.lit(d["purpose"]))).alias("code_lineage"),
        pick(F.coalesce("a.technical_stack", empty_stack), empty_stack).alias("technical_stack"),
        pick(F.coalesce("a.data_flow", empty_flow), empty_flow).alias("data_flow"),
        F.coalesce("a.key_components", F.array()).alias("key_components"),
        _strings(F.col("a.legacy_aspects")).alias("legacy_aspects"),
        _strings(F.col("a.modernization_opportunities")).alias("modernization_opportunities"),
        pick(F.col("a.summary"), F.lit(d["summary"])).alias("summary"),
        "total_files", "languages", F.col("raw").alias("raw_response"),
        F.when(is_json_answer, F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")).alias("analysis_timestamp"),
    )


def project_results(structures: DataFrame) -> DataFrame:
    """project, project_structure (one nested value), language_stats and raw_response: what an analysis of a project returns.

    An answer that was JSON has the time of its analysis and its file statistics in the structure, a default has neither.
    """
    own = [c for c in structures.columns if c not in ("project", "parsed_from", "total_files", "languages", "raw_response", "analysis_timestamp")]
    stats = F.when(F.col("parsed_from") == "json", F.struct("total_files", F.col("languages").alias("language_distribution")))
    return structures.select(
        "project", F.struct(*own, stats.alias("file_stats"), "analysis_timestamp").alias("project_structure"),
        F.coalesce("languages", F.create_map().cast("map<string,bigint>")).alias("language_stats"), "raw_response")


def dependency_defaults(answers: DataFrame, files: DataFrame, **limits: int | None) -> DataFrame:
    return project_structures(answers, files, **limits).select("project", "dependencies", "code_lineage")


# --- lineage graph ----------------------------------------------------------------
def first_analyses(analyses: DataFrame) -> DataFrame:
    """One analysis per (project, file): the first in listing order."""
    return analyses.groupBy("project", "file").agg(F.min_by("language", "seq").alias("language"))


def _vertex(section: int, kind: str, size: int, i: Column, node_id: Column, label: Column, **more: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(section).alias("section"), i.cast("int").alias("i"), node_id.cast("string").alias("node_id"), label.alias("label"),
        F.lit(kind).alias("type"), F.lit(size).alias("size"),
        *[more.get(n, none).cast("string").alias(n) for n in ("purpose", "description", "language", "dep_type")])


def _analysed_files(structures: DataFrame, analyses: DataFrame) -> DataFrame:
    """project and a map, file to language, of the component files that were analysed.

    A map is no larger than the structure whose files it names; of the analyses only
    those files' keys and languages are gathered.
    """
    named = structures.select("project", F.explode("key_components").alias("c")).select("project", F.explode("c.files").alias("file")).distinct()
    found = first_analyses(analyses).join(named, ["project", "file"])
    language = F.coalesce("language", F.lit("unknown"))
    return found.groupBy("project").agg(F.map_from_entries(F.collect_list(F.struct("file", language))).alias("analysed"))


def graph_nodes(structures: DataFrame, analyses: DataFrame) -> DataFrame:
    """Numbered vertices of every project's structure: the root, each component
    followed by its analysed files, sources, transformations, sinks, dependencies.

    All vertices of a project are one array of its structure row, so a vertex's place in
    it is its number: no union, no window, and the array is as small as the row.
    """
    number = lambda word, i: F.concat(F.lit(f"{word}_"), i.cast("string"))
    rows = structures.join(_analysed_files(structures, analyses), "project", "left")
    analysed = F.coalesce("analysed", F.create_map().cast("map<string,string>"))
    language = lambda f: F.element_at(analysed, f)

    def component(c: Column, i: Column) -> Column:
        own = _vertex(1, "component", 20, i, number("component", i), F.coalesce(c["name"], F.concat(F.lit("Component "), i.cast("string"))),
                      purpose=F.coalesce(c["purpose"], F.lit("")))
        files = F.filter(_strings(c["files"]), lambda f: F.coalesce(F.map_contains_key(analysed, f), F.lit(False)))
        return F.concat(F.array(own), F.transform(files, lambda f: _vertex(
            1, "file", 10, i, F.lit(None), basename(f), language=language(f))))

    def elements(column: str, each) -> Column:
        return F.transform(_strings(F.col(column)), each)

    root = _vertex(0, "project", 30, F.lit(-1), F.lit("project_root"), F.coalesce("project_type", F.lit("Unknown Project")))
    vertices = F.concat(
        F.array(root),
        F.flatten(F.transform("key_components", component)),
        elements("data_flow.sources", lambda e, i: _vertex(2, "data_source", 15, i, number("source", i), _label(e, "Source", i))),
        elements("data_flow.transformations", lambda e, i: _vertex(
            3, "data_transformation", 12, i, number("transform", i), _label(e, "Transform", i),
            description=F.coalesce(_member(e, "description", F.lit("")), F.lit("")))),
        elements("data_flow.sinks", lambda e, i: _vertex(4, "data_sink", 15, i, number("sink", i), _label(e, "Sink", i))),
        F.transform(F.coalesce("dependencies", F.array().cast(_DEPENDENCY)), lambda e, i: _vertex(
            5, "dependency", 8, i, number("dependency", i), e["name"], purpose=e["purpose"], dep_type=e["type"])),
    )
    return rows.select("project", F.posexplode(vertices).alias("node_index", "v")).select("project", "node_index", "v.*").withColumn(
        "node_id", F.coalesce("node_id", number("file", F.col("node_index"))))


def node_table(nodes: DataFrame) -> DataFrame:
    return nodes.select("project", "node_index", F.col("node_id").alias("id"), "label", "type", "size",
                        "purpose", "description", "language", "dep_type")


def graph_edges(nodes: DataFrame) -> DataFrame:
    """contains, data_input, data_flow and depends_on edges between node indexes.

    One pass of windows per project: the enclosing component, the first source
    and the last transformation are running values of the node order.
    """
    in_order = W.partitionBy("project").orderBy("node_index")
    before = in_order.rowsBetween(W.unboundedPreceding, -1)
    kind, at = F.col("type"), F.col("node_index")
    last_of = lambda k: F.last(F.when(kind == k, at), ignorenulls=True).over(before)
    first_of = lambda k: F.first(F.when(kind == k, at), ignorenulls=True).over(before)
    chained = F.coalesce(last_of("data_transformation"), first_of("data_source"))
    root = F.lit(0)
    source = (
        F.when(kind.isin("component", "data_source", "dependency"), root)
        .when(kind == "file", last_of("component"))
        .when(kind.isin("data_transformation", "data_sink"), chained)
    )
    edge = (
        F.when(kind.isin("component", "file"), "contains").when(kind == "data_source", "data_input")
        .when(kind == "dependency", "depends_on").otherwise("data_flow")
    )
    return (
        nodes.select("project", source.alias("source_index"), at.alias("target_index"), edge.alias("edge_type"),
                     F.col("type").alias("target_type"))
        .filter("source_index IS NOT NULL")
        .select("project", "source_index", "target_index", F.col("edge_type").alias("type"), "target_type")
    )


def containment_edges(nodes: DataFrame) -> DataFrame:
    return graph_edges(nodes).drop("target_type")


def transformation_edges(nodes: DataFrame) -> DataFrame:
    return graph_edges(nodes).filter("target_type = 'data_transformation'").drop("target_type")


def sink_edges(nodes: DataFrame) -> DataFrame:
    return graph_edges(nodes).filter("target_type = 'data_sink'").drop("target_type")


def graph_metadata(structures: DataFrame) -> DataFrame:
    return structures.select(
        "project", F.coalesce("project_type", F.lit("Unknown Project")).alias("project_type"),
        _strings(F.col("main_languages")).alias("main_languages"),
        F.coalesce("architecture", F.lit("Unknown")).alias("architecture"),
        F.coalesce("summary", F.lit("")).alias("summary"))


# --- export --------------------------------------------------------------------------
def succeeded(analyses: DataFrame) -> DataFrame:
    """Analyses without an error; a table without the column `error` holds no failed ones."""
    return analyses.filter("error IS NULL") if "error" in analyses.columns else analyses


def lineage_entries(analyses: DataFrame) -> DataFrame:
    """One entry for each file whose analysis succeeded, defaults filled in."""
    or_empty = lambda c: F.coalesce(c, F.array())
    return succeeded(analyses).select(
        "project", "file",
        F.struct(
            F.coalesce("file", F.lit(fv.UNKNOWN_FILE)).alias("file_path"), F.coalesce("language", F.lit("unknown")).alias("language"),
            F.coalesce("summary", F.lit(fv.NO_SUMMARY_EXPORT)).alias("summary"),
            or_empty("functions.important_functions").alias("functions"),
            or_empty("classes.important_classes").alias("classes"),
            or_empty("data_transformations").alias("data_transformations"),
            "external_communications",
        ).alias("entry"))


def lineage_headers(structures: DataFrame, analyses: DataFrame) -> DataFrame:
    """project and header: the nested document of a project but for its files.

    The number of analysed files counts failed analyses too.
    """
    totals = analyses.groupBy("project").agg(F.count("*").alias("n"))
    return structures.join(totals, "project", "left").select(
        "project",
        F.struct(
            F.struct(
                F.coalesce("project_type", F.lit("Unknown")).alias("type"),
                F.coalesce("architecture", F.lit("Unknown")).alias("architecture"),
                _strings(F.col("main_languages")).alias("main_languages"),
                _strings(F.col("entry_points")).alias("entry_points"),
                F.coalesce("summary", F.lit(fv.NO_SUMMARY_EXPORT)).alias("summary"),
            ).alias("project"),
            "code_lineage", "technical_stack", "dependencies", "data_flow", F.col("key_components").alias("components"),
            "legacy_aspects", "modernization_opportunities",
            F.struct(
                F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("generated_at"),
                F.coalesce("n", F.lit(0)).alias("total_files_analyzed"), F.struct("total_files", "languages").alias("file_stats"),
            ).alias("metadata"),
        ).alias("header"),
    )


def lineage_export(structures: DataFrame, analyses: DataFrame) -> DataFrame:
    """project, record, file, document (JSON): the nested export as records.

    One `header` record for each project and one `file` record for each entry of
    its `file_analyses`, the same at every size: nothing is gathered by project,
    so a project that holds a third of all files is spread over all tasks.
    Records of a project without a structure are left out, as it has no document.
    """
    headers = lineage_headers(structures, analyses).select(
        "project", F.lit("header").alias("record"), F.lit(None).cast("string").alias("file"), F.to_json("header").alias("document"))
    # the right side is unique by project, so a hot project is split by adaptive execution
    files = lineage_entries(analyses).join(structures.select("project"), "project", "left_semi").select(
        "project", F.lit("file").alias("record"), "file", F.to_json("entry").alias("document"))
    return headers.unionByName(files)
