"""Size, complexity, documentation and maintainability per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslens import fixed_values as fv
from corpuslens.functions.text import basename, split_lines, without_indent

_CONTROL = ("If", "For", "While", "Try")
_DEFINITIONS = ("FunctionDef", "ClassDef")
# kinds and columns of nodes that functions below read; every file has a Module or a ParseError
_FILE = ("Module", "ParseError")
DEFINITIONS_READ = (_FILE + _DEFINITIONS, ("path", "kind"))
CYCLOMATIC_READS = (_FILE + _CONTROL + ("BoolOp",), ("path", "kind"))
COGNITIVE_READS = (_FILE + _DEFINITIONS + _CONTROL, ("path", "kind", "bfs"))
DOCSTRINGS_READ = (_FILE + _DEFINITIONS, ("path", "kind", "str_value", "parse_ok"))
FACTS_READ = (_FILE + _DEFINITIONS + _CONTROL + ("BoolOp",), ("path", "kind", "str_value", "lineno", "end_lineno", "parse_ok"))
# a docstring that cleans to nothing: blanks, then only line ends
_EMPTY_DOC = r"\A[ \t]*\n*\z"


def has_docstring() -> Column:
    return F.col("str_value").isNotNull() & ~F.col("str_value").rlike(_EMPTY_DOC)


# --- lines ------------------------------------------------------------------
def line_counts(files: DataFrame, id_column: str = "path", text_column: str = "content") -> DataFrame:
    """Lines per file: total, blank, comment, code.

    The lines of a file follow each other in one task, so the partial aggregate
    leaves about one row per file for the shuffle, and none at all is needed when
    the files are bucketed by their id.
    """
    text, line = F.col(text_column), F.col("line")
    lines = files.select(
        id_column, F.explode_outer(F.when(text != "", split_lines(text))).alias("line")
    ).select(id_column, without_indent(line).alias("line"))
    counted = lines.groupBy(id_column).agg(
        F.count("line").cast("int").alias("lines_total"),
        F.count_if(line == "").cast("int").alias("lines_blank"),
        F.count_if(F.startswith(line, F.lit("#"))).cast("int").alias("lines_comment"),
    )
    return counted.withColumn("lines_code", F.expr("lines_total - lines_blank - lines_comment"))


def comment_ratio(lines: DataFrame) -> DataFrame:
    """Comment lines in percent of code lines."""
    return lines.withColumn("comment_ratio", _comment_ratio())


def _comment_ratio() -> Column:
    return F.col("lines_comment") / F.greatest(F.col("lines_code"), F.lit(1)) * 100


# --- counts -----------------------------------------------------------------
def _kinds(*kinds: str) -> Column:
    return F.count_if(F.col("kind").isin(*kinds))


def definition_counts(nodes: DataFrame) -> DataFrame:
    """A row for every file; one that does not parse has none of anything."""
    return nodes.groupBy("path").agg(
        _kinds("FunctionDef").alias("functions"), _kinds("ClassDef").alias("classes")
    )


def imports(nodes: DataFrame) -> DataFrame:
    """Imported names in order of appearance, repeats kept."""
    return nodes.filter("kind IN ('Module', 'ParseError')").select("path").join(_import_names(nodes), "path", "left").select(
        "path", F.coalesce(F.size("import_names"), F.lit(0)).alias("imports"),
        F.coalesce("import_names", F.array().cast("array<string>")).alias("import_names"))


def _import_names(nodes: DataFrame) -> DataFrame:
    name = F.when(F.col("owner").isNull(), F.col("name")).otherwise(F.concat_ws(".", "owner", "name"))
    return (
        nodes.filter("kind = 'alias'").groupBy("path")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("bfs"), name.alias("name")))).alias("a"))
        .select("path", F.transform("a", lambda s: s["name"]).alias("import_names"))
    )


def cyclomatic(nodes: DataFrame) -> DataFrame:
    """Branches, loops, tries and boolean operators; no constant one is added."""
    return nodes.groupBy("path").agg(
        _kinds(*_CONTROL, "BoolOp").alias("cyclomatic"),
        _kinds("If").alias("if_statements"),
        _kinds("For", "While").alias("loops"),
    )


def cognitive(nodes: DataFrame) -> DataFrame:
    """Cognitive complexity in breadth-first order.

    Gaps and islands: a definition opens a new segment; inside a segment the
    n-th control statement costs n.  A definition itself costs one.  The cost of
    a segment with n control statements is 1 + 2 + .. + n, so after numbering
    the segments one aggregate per segment is enough.
    """
    is_definition = F.col("kind").isin(*_DEFINITIONS)
    rows = nodes.filter(F.col("kind").isin(*_DEFINITIONS, *_CONTROL, "Module", "ParseError"))
    so_far = W.partitionBy("path").orderBy("bfs").rowsBetween(W.unboundedPreceding, 0)
    segments = (
        rows.withColumn("segment", F.sum(F.when(is_definition, 1).otherwise(0)).over(so_far))
        .groupBy("path", "segment")
        .agg(F.count_if(is_definition).alias("definitions"), _kinds(*_CONTROL).alias("n"))
    )
    return segments.groupBy("path").agg(
        F.sum(F.col("definitions") + F.col("n") * (F.col("n") + 1) / 2).cast("double").alias("cognitive")
    )


def docstring_coverage(nodes: DataFrame) -> DataFrame:
    """Percent of functions and classes with a docstring; 100 when there are none, 0 for a file that does not parse."""
    is_definition = F.col("kind").isin(*_DEFINITIONS)
    return (
        nodes.groupBy("path")
        .agg(F.count_if(is_definition).alias("n"), F.count_if(is_definition & has_docstring()).alias("with_doc"),
             F.min("parse_ok").alias("parse_ok"))
        .select("path", F.when(~F.col("parse_ok"), 0.0).when(F.col("n") == 0, 100.0).otherwise(
            F.try_divide(F.col("with_doc"), F.col("n")) * 100).alias("docstring_coverage"))
    )


# --- maintainability --------------------------------------------------------
def node_facts(nodes: DataFrame) -> DataFrame:
    """Everything countable about a file, in one hash aggregate over its nodes."""
    is_definition = F.col("kind").isin(*_DEFINITIONS)
    is_long = (F.col("kind") == "FunctionDef") & (
        F.col("end_lineno") - F.col("lineno") > fv.DEBT_LONG_FUNCTION_LINES)
    facts = nodes.groupBy("path").agg(
        F.min("parse_ok").alias("parse_ok"),
        _kinds("FunctionDef").alias("functions"), _kinds("ClassDef").alias("classes"),
        _kinds(*_CONTROL, "BoolOp").alias("cyclomatic"), _kinds("If").alias("if_statements"),
        _kinds("For", "While").alias("loops"),
        F.count_if(is_definition & has_docstring()).alias("with_doc"),
        F.count_if(is_long).alias("long_functions"),
    )
    definitions = F.col("functions") + F.col("classes")
    return facts.withColumn(
        "docstring_coverage",
        F.when(definitions == 0, 100.0).otherwise(F.try_divide(F.col("with_doc"), definitions) * 100),
    )


def maintainability_score() -> Column:
    volume = F.col("lines_code") * (
        F.col("cyclomatic") / F.greatest(F.lit(1), F.col("functions") + F.col("classes")))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - volume / 10))


def debt_ratio() -> Column:
    code = F.col("lines_code")
    step = lambda test: F.when(test, fv.DEBT_STEP).otherwise(0.0)
    debt = (
        step(F.try_divide(F.col("lines_comment"), code) < fv.DEBT_COMMENT_RATIO)
        + step(F.try_divide(F.col("cyclomatic"), code) > fv.DEBT_COMPLEXITY_RATIO)
        + step(F.col("docstring_coverage") < fv.DEBT_DOCSTRING_PERCENT)
        + fv.DEBT_STEP * F.col("long_functions") / F.greatest(F.lit(1), F.col("functions"))
    )
    return F.when(code > 0, F.least(F.lit(100.0), debt)).otherwise(0.0)


def maintainability(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Score and debt of every file; 0 and 100 for one that does not parse."""
    facts = node_facts(nodes).join(line_counts(files), "path")
    ok = F.col("parse_ok")
    return facts.select(
        "path", F.when(ok, maintainability_score()).otherwise(0.0).alias("score"), F.when(ok, debt_ratio()).otherwise(100.0).alias("debt_ratio"))


def flat_metrics(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """The full metric row, one column per figure; a file that does not parse has
    zeros, the largest debt and an error text."""
    facts = (
        node_facts(nodes).join(line_counts(files), "path").join(cognitive(nodes), "path", "left")
        .join(_import_names(nodes), "path", "left")
    )
    ok = F.col("parse_ok")
    names = F.coalesce("import_names", F.array().cast("array<string>"))
    zero_unless_ok = lambda c: F.when(ok, c).otherwise(F.lit(0)).alias
    return facts.select(
        "path", basename(F.col("path")).alias("name"), F.lit(".py").alias("extension"), F.lit("Python").alias("language"),
        *[zero_unless_ok(F.col(c))(c) for c in ("lines_total", "lines_code", "lines_comment", "lines_blank",
                                                "functions", "classes")],
        F.size(names).alias("imports"), names.alias("import_names"),
        zero_unless_ok(F.col("cyclomatic"))("cyclomatic"),
        F.coalesce("cognitive", F.lit(0.0)).alias("cognitive"),
        zero_unless_ok(F.col("if_statements"))("if_statements"),
        zero_unless_ok(F.col("loops"))("loops"),
        F.when(ok, F.col("docstring_coverage")).otherwise(0.0).alias("docstring_coverage"),
        F.when(ok, _comment_ratio()).otherwise(0.0).alias("comment_ratio"),
        F.when(ok, maintainability_score()).otherwise(0.0).alias("score"),
        F.when(ok, debt_ratio()).otherwise(100.0).alias("debt_ratio"),
        F.when(~ok, F.lit(fv.PARSE_ERROR_MESSAGE)).alias("error"),
    )


def nested_metrics(flat: DataFrame) -> DataFrame:
    """The same as six structs plus the issues of a file that does not parse."""
    error = F.struct(
        F.lit("error").alias("type"), F.col("error").alias("message"), F.lit(1).alias("line"),
        F.lit("error").alias("severity"))
    return flat.select(
        "path",
        F.struct("path", "name", "extension", "language").alias("file_info"),
        F.struct("lines_total", "lines_code", "lines_comment", "lines_blank").alias("size"),
        F.struct("functions", "classes", "imports", "import_names").alias("structure"),
        F.struct("cyclomatic", "cognitive", "if_statements", "loops").alias("complexity"),
        F.struct("docstring_coverage", "comment_ratio").alias("documentation"),
        F.struct("score", "debt_ratio").alias("maintainability"),
        F.when(F.col("error").isNotNull(), F.array(error)).otherwise(F.array()).alias("issues"),
    )
