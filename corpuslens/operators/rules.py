"""Issue rules as rows of a table, and reports that roll issues up.

`facts` measures every function, class, handler and unparsable file in one aggregate
over the nodes.  A rule is a row: what it looks at, which measure it compares with
which threshold, and what it says; changing, adding or dropping one needs no code.
Rules meet measures in one equi-join by (scope, measure).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens import fixed_values as fv
from corpuslens.operators.metrics import has_docstring

RULES = ("rule string, rank int, scope string, measure string, comparison string, threshold double, per_unit boolean, "
         "severity string, category string, message string, recommendation string")
MEASURES = {
    "function": ["length", "arguments", "mutable_defaults", "control", "docstring"],
    "class": ["length", "docstring"],
    "handler": ["statements"],
    "file": ["parse_errors"],
}
COMPARISONS = {">": lambda v, t: v > t, ">=": lambda v, t: v >= t, "<": lambda v, t: v < t, "<=": lambda v, t: v <= t, "=": lambda v, t: v == t}
_CONTROL = ("If", "For", "While", "Try")
_MUTABLE = ("List", "Dict", "Set")
_SCOPE = {"FunctionDef": "function", "ClassDef": "class", "ExceptHandler": "handler", "ParseError": "file"}


def facts(nodes: DataFrame) -> DataFrame:
    """path, scope, kind, bfs, lineno, name, and a struct `measured`, of every subject of a rule.

    A node counts for itself if it is a subject, for the function or handler it belongs
    to, and, as a control statement, for every function around it.
    """
    kind, parent, field = F.col("kind"), F.col("parent_kind"), F.col("field")
    subject = kind.isin(*_SCOPE)
    control = kind.isin(*_CONTROL)
    argument = (parent == "FunctionDef") & field.isin("args", "defaults")
    in_handler = (parent == "ExceptHandler") & (field == "body")
    belongs = F.concat(
        F.when(subject, F.array("bfs")).otherwise(F.array().cast("array<int>")),
        F.when(control, F.col("functions")).otherwise(F.array().cast("array<int>")),
        F.when((argument | in_handler), F.array("parent")).otherwise(F.array().cast("array<int>")))
    own = lambda c: F.max(F.when(subject & (F.col("bfs") == F.col("subject")), c))
    count = lambda c: F.count_if(c & (F.col("bfs") != F.col("subject"))).cast("double")
    measured = {
        "length": own(F.col("end_lineno") - F.col("lineno")).cast("double"),
        "arguments": count((parent == "FunctionDef") & (field == "args") & (kind == "arg") & (F.col("parent") == F.col("subject"))),
        "mutable_defaults": count((parent == "FunctionDef") & (field == "defaults") & kind.isin(*_MUTABLE) & (F.col("parent") == F.col("subject"))),
        "control": count(control),
        "docstring": own(has_docstring().cast("int")).cast("double"),
        "statements": count(in_handler & (kind != "Pass") & (F.col("parent") == F.col("subject"))),
        "parse_errors": own((~F.col("parse_ok")).cast("int")).cast("double"),
    }
    rows = nodes.filter(subject | control | argument | in_handler).withColumn("subject", F.explode(belongs))
    scope = reduce(lambda c, k: c.when(F.col("kind") == k, _SCOPE[k]), _SCOPE, F.when(F.lit(False), ""))
    return rows.groupBy("path", "subject").agg(
        own(kind).alias("kind"), own(F.col("lineno")).alias("lineno"), own(F.col("name")).alias("name"),
        F.struct(*[c.alias(n) for n, c in measured.items()]).alias("measured"),
    ).filter("kind IS NOT NULL").select("path", scope.alias("scope"), "kind", F.col("subject").alias("bfs"), "lineno", "name", "measured")


def default_rules(spark: SparkSession) -> DataFrame:
    """The built-in rules as rows."""
    def words(text: str) -> str:
        for mark, name in (("in %s ", "in {kind} "), ("this %s", "this {kind}"), ("'%s'", "'{name}'"), ("%d", "{value}")):
            text = text.replace(mark, name)
        return text

    shape = {
        "syntax": [("file", "parse_errors", ">", 0.0, False)],
        "long_function": [("function", "length", ">", None, False)],
        "too_many_args": [("function", "arguments", ">", None, False)],
        "missing_docstring": [("function", "docstring", "=", 0.0, False), ("class", "docstring", "=", 0.0, False)],
        "too_complex": [("function", "control", ">", None, False)],
        "empty_except": [("handler", "statements", "=", 0.0, False)],
        "mutable_default": [("function", "mutable_defaults", ">", 0.0, True)],
    }
    rows = []
    for rule, (rank, severity, category, threshold, message, advice) in fv.ISSUE_RULES.items():
        for scope, measure, comparison, fixed, per_unit in shape[rule]:
            rows.append((rule, rank, scope, measure, comparison, float(threshold) if fixed is None else fixed, per_unit,
                         severity, category, words(message), words(advice)))
    return spark.createDataFrame(rows, RULES)


def _filled(template: Column) -> Column:
    kind = F.when(F.col("kind") == "ClassDef", "class").otherwise("function")
    value = F.when(F.col("value") == F.floor("value"), F.floor("value").cast("string")).otherwise(F.col("value").cast("string"))
    for mark, text in (("{name}", F.coalesce("name", F.lit(""))), ("{kind}", kind), ("{value}", value), ("{threshold}", F.col("threshold").cast("string"))):
        template = F.replace(template, F.lit(mark), text)
    return template


def issues(found: DataFrame, rules: DataFrame) -> DataFrame:
    """path, rule, line, message, severity, category, recommendation, rule_rank, bfs of facts that break rules.

    A rule with `per_unit` gives as many issues as its measure says.  A rule whose scope,
    measure or comparison is unknown, or whose threshold is null, finds nothing.
    """
    names = sorted({m for part in MEASURES.values() for m in part})
    measures = F.array(*[F.struct(F.lit(n).alias("measure"), F.col(f"measured.{n}").alias("value")) for n in names])
    values = found.select("path", "scope", "kind", "bfs", "lineno", "name", F.explode(measures).alias("m")).select("*", "m.measure", "m.value").drop("m")
    broken = reduce(lambda c, s: c.when(F.col("comparison") == s, COMPARISONS[s](F.col("value"), F.col("threshold"))), COMPARISONS, F.when(F.lit(False), False))
    # a few scopes and measures hold all values: by them nothing can be dealt out, so the rules go to the values
    rows = values.join(F.broadcast(rules), ["scope", "measure"]).filter(broken)
    times = F.when(F.col("per_unit"), F.greatest(F.col("value").cast("int"), F.lit(0))).otherwise(1)
    return rows.withColumn("unit", F.explode(F.array_repeat(F.lit(1), times))).select(
        "path", "rule", F.col("lineno").alias("line"), _filled(F.col("message")).alias("message"), "severity", "category",
        _filled(F.col("recommendation")).alias("recommendation"), F.col("rank").alias("rule_rank"), "bfs")


def folders(path: Column) -> Column:
    """The folders around a path, from the whole corpus ('') inwards."""
    parts = F.split(path, "/")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


def issue_rollup(issue_rows: DataFrame) -> DataFrame:
    """folder, category, severity, issues, files: for every folder with all below it, by category and severity,
    by category, and over all (null: all).

    Issues are counted by file first, so what is given to the folders around and to the
    grouping sets are counts; the root's groups are combined in every task.
    """
    per_file = issue_rows.groupBy("path", "category", "severity").agg(F.count("*").alias("n"))
    rows = per_file.withColumn("folder", F.explode(folders(F.col("path"))))
    sets = [["folder", "category", "severity"], ["folder", "category"], ["folder"]]
    # files by category and severity are rows; above that a file counts once
    by_file = rows.groupingSets([[*map(F.col, s), F.col("path")] for s in sets], "folder", "category", "severity", "path").agg(F.sum("n").alias("n"))
    return by_file.groupBy("folder", "category", "severity").agg(F.sum("n").alias("issues"), F.count("*").alias("files"))
