"""Entities of a script: functions, variables, DataFrames, SQL, business rules.

Input is the syntax-node table.  Everything grouped per file needs no shuffle
when that table is bucketed by path; corpus-wide distincts combine map-side
first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslens import fixed_values as fv
from corpuslens.functions.text import contains_any, strip

TRANSFORMATION_COLUMNS = ["path", "target", "source", "operation", "details", "in_function"]


# --- functions and variables ------------------------------------------------
FUNCTIONS_READ = (("FunctionDef",), ("path", "kind", "name"))   # kinds and columns of nodes


def function_names(nodes: DataFrame) -> DataFrame:
    """Distinct function names per file; async functions are not counted."""
    return nodes.filter("kind = 'FunctionDef'").select("path", "name").distinct()


def assigned_values(nodes: DataFrame) -> DataFrame:
    """Right-hand side of every plain assignment."""
    return nodes.filter("parent_kind = 'Assign' AND field = 'value'")


def assignments(nodes: DataFrame) -> DataFrame:
    """One row per (assignment, plain name target)."""
    return assigned_values(nodes).select(
        "path", "bfs", "kind", F.posexplode("targets").alias("target_pos", "target"),
        F.col("name").alias("method"), "owner", "args", "str_value", "src", "functions",
    )


def variable_names(nodes: DataFrame) -> DataFrame:
    return assignments(nodes).select("path", F.col("target").alias("name")).distinct()


def last_assignment(nodes: DataFrame) -> DataFrame:
    """Text last assigned to each name, in breadth-first order."""
    literal = F.when(F.col("kind") == "Constant", F.col("str_value")).alias("literal")
    return (
        assignments(nodes).groupBy("path", "target")
        .agg(F.max_by(F.struct(F.col("src"), literal, F.col("bfs")), "bfs").alias("w"))
        .select("path", "target", "w.src", "w.bfs", "w.literal")
    )


# --- DataFrames ------------------------------------------------------------
def source_dataframes(nodes: DataFrame) -> DataFrame:
    """`x = pd.read_*(source)`."""
    return (
        assignments(nodes)
        .filter((F.col("kind") == "Call") & F.startswith("method", F.lit("read_")) & (F.col("owner") == "pd"))
        .select(
            "path", "target", F.coalesce(F.get("args", F.lit(0)), F.lit("unknown")).alias("source"),
            F.col("method").alias("operation"), F.col("src").alias("details"),
            F.lit(None).cast("string").alias("in_function"), "bfs",
        )
    )


def _method_calls(nodes: DataFrame, methods: list[str]) -> DataFrame:
    return assignments(nodes).filter((F.col("kind") == "Call") & F.col("method").isin(methods))


def dataframe_transformations(nodes: DataFrame) -> DataFrame:
    """`x = df.groupby(...)` and the like, anywhere in the file."""
    return _method_calls(nodes, fv.DATAFRAME_METHODS).select(
        "path", "target", F.col("owner").alias("source"), F.col("method").alias("operation"),
        F.col("src").alias("details"), F.lit(None).cast("string").alias("in_function"), "bfs",
    )


def function_transformations(nodes: DataFrame) -> DataFrame:
    """The same inside functions, once per enclosing function.

    Each call lists its enclosing functions, so this is an equi-join on the
    function's number, linear in nesting depth, and never a range join.
    """
    calls = _method_calls(nodes, fv.FUNCTION_DATAFRAME_METHODS).select(
        "path", "target", "owner", "method", "src", "bfs", F.explode("functions").alias("function_bfs")
    )
    functions = nodes.filter("kind = 'FunctionDef'").select(
        "path", F.col("bfs").alias("function_bfs"), F.col("name").alias("in_function")
    )
    return calls.join(functions, ["path", "function_bfs"]).select(
        "path", "target", F.col("owner").alias("source"), F.col("method").alias("operation"),
        F.col("src").alias("details"), "in_function", "bfs",
    )


def all_transformations(nodes: DataFrame) -> DataFrame:
    return dataframe_transformations(nodes).unionByName(function_transformations(nodes))


def dataframes(nodes: DataFrame) -> DataFrame:
    """One row per (file, name): the last write wins."""
    method = F.col("method")
    is_source = F.startswith(method, F.lit("read_")) & (F.col("owner") == "pd")
    return (
        _frame_rows(nodes, is_source)
        .groupBy("path", "name").agg(
            F.max_by(F.struct("df_type", "method", "source"), "bfs").alias("w"), F.min("bfs").alias("seq")
        )
        .select("path", "name", "w.df_type", "w.method", "w.source", "seq")
    )


def _frame_rows(nodes: DataFrame, is_source: Column) -> DataFrame:
    # a method cannot be both `read_*` and a transformation: one branch per call
    return (
        assignments(nodes)
        .filter((F.col("kind") == "Call") & (is_source | F.col("method").isin(fv.DATAFRAME_METHODS)))
        .select(
            "path", F.col("target").alias("name"), "bfs", "method",
            F.when(is_source, "source").otherwise("transformation").alias("df_type"),
            F.when(is_source, F.coalesce(F.get("args", F.lit(0)), F.lit("unknown")))
            .otherwise(F.col("owner")).alias("source"),
        )
    )


# --- string constants -------------------------------------------------------
def _string_constants(nodes: DataFrame) -> DataFrame:
    return assigned_values(nodes).filter("kind = 'Constant' AND str_value IS NOT NULL")


def file_paths(nodes: DataFrame, marks: list[str] = fv.FILE_PATH_MARKS) -> DataFrame:
    return (
        _string_constants(nodes).filter(contains_any(F.col("str_value"), marks))
        .select("path", F.col("str_value").alias("value")).distinct()
    )


def older_file_paths(nodes: DataFrame) -> DataFrame:
    """Narrower rule: only a slash marks a path, and only named assignments count."""
    return file_paths(nodes.filter(F.size("targets") > 0), fv.OLDER_FILE_PATH_MARKS)


def configs(nodes: DataFrame) -> DataFrame:
    value = F.col("str_value")
    return (
        _string_constants(nodes)
        .filter(~contains_any(value, fv.FILE_PATH_MARKS) & contains_any(F.upper(value), fv.CONFIG_WORDS))
        .select("path", value.alias("value")).distinct()
    )


def older_configs(nodes: DataFrame) -> DataFrame:
    """Strings naming a table, and every assigned subscript."""
    value = F.col("str_value")
    named = assigned_values(nodes).filter(F.size("targets") > 0)
    table = (
        (F.col("kind") == "Constant")
        & ~contains_any(value, fv.OLDER_FILE_PATH_MARKS)
        & contains_any(F.upper(value), fv.OLDER_CONFIG_WORDS)
    )
    subscript = F.col("kind") == "Subscript"
    return (
        named.filter(table | subscript)
        .select("path", F.when(subscript, F.col("src")).otherwise(value).alias("value")).distinct()
    )


# --- SQL --------------------------------------------------------------------
def is_sql(text: Column) -> Column:
    """A substring test, by design: prose with the word "from" passes."""
    return contains_any(F.upper(text), fv.SQL_WORDS)


def sql_variables(nodes: DataFrame) -> DataFrame:
    """Strings that look like SQL, assigned to a name; the last one wins."""
    return (
        _sql_literals(nodes).groupBy("path", "key")
        .agg(F.max_by("sql_text", "bfs").alias("sql_text"))
        .withColumn("origin", F.lit("literal"))
    )


def _sql_literals(nodes: DataFrame) -> DataFrame:
    return assignments(nodes).filter((F.col("kind") == "Constant") & is_sql(F.col("str_value"))).select(
        "path", "bfs", "target_pos", F.col("target").alias("key"), F.col("str_value").alias("sql_text"),
        F.lit("literal").alias("origin"),
    )


def _sql_calls(nodes: DataFrame, methods: list[str]) -> DataFrame:
    return nodes.filter(
        (F.col("kind") == "Call") & (F.col("parent_kind") == "Expr") & F.col("name").isin(methods)
        & (F.size("args") > 0)
    ).select("path", "bfs", F.get("args", F.lit(0)).alias("arg"), "str_value")


def sql_entries(nodes: DataFrame) -> DataFrame:
    """SQL text per file and key: literals, queries passed by name, inline queries.

    An inline query is keyed by the number of entries found before it.  One pass over
    the nodes: a call that passes a name stands with the assignments of that name, and a
    window over the two gives it the last of them.
    """
    literal, value, arg = F.col("kind") == "Constant", F.col("str_value"), F.get("args", F.lit(0))
    assigned = (F.col("parent_kind") == "Assign") & (F.col("field") == "value")
    call = (F.col("kind") == "Call") & (F.col("parent_kind") == "Expr") & F.col("name").isin(fv.SQL_CALL_METHODS) & (F.size("args") > 0)
    event = lambda pos, key, text, origin, given: F.struct(
        pos.alias("target_pos"), key.alias("key"), text.alias("sql_text"), origin.alias("origin"), given.alias("given"))
    none = F.lit(None).cast("string")
    # a literal that looks like SQL is an entry; every assignment is given to the calls that pass its name
    given = F.coalesce(F.when(literal, value), F.col("src"))
    is_entry = literal & F.coalesce(is_sql(value), F.lit(False))
    named = F.transform("targets", lambda t, i: event(
        i, t, F.when(is_entry, value), F.when(is_entry, "literal"), F.struct(F.col("bfs").alias("bfs"), given.alias("text"))))
    no_value = F.lit(None).cast("struct<bfs:int,text:string>")
    called = F.array(F.when(value.isNull(), event(F.lit(0), arg, none, F.lit("call_name"), no_value)).otherwise(
        event(F.lit(0), none, value, F.when(is_sql(value), "call_inline"), no_value)))
    rows = nodes.filter(assigned | call).select("path", "bfs", F.explode(F.when(assigned, named).otherwise(called)).alias("e")).select("path", "bfs", "e.*")
    of_name = W.partitionBy("path", "key")
    by_name = F.col("origin") == "call_name"
    events = (
        rows.withColumn("last", F.max("given").over(of_name))
        .filter(F.col("origin").isNotNull() & (~by_name | F.col("last").isNotNull()))
        .withColumn("sql_text", F.when(by_name, F.col("last.text")).otherwise(F.col("sql_text"))).drop("given", "last")
    )
    in_order = W.partitionBy("path").orderBy("bfs", "target_pos")
    per_key = of_name.orderBy("bfs", "target_pos")
    is_new = F.when(F.col("key").isNull() | (F.row_number().over(per_key) == 1), 1).otherwise(0)
    numbered = (
        events.withColumn("is_new", is_new)
        .withColumn("before", F.sum("is_new").over(in_order.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("key", F.coalesce("key", F.concat(F.lit("inline_sql_"), F.coalesce("before", F.lit(0)))))
    )
    return (
        numbered.groupBy("path", "key")
        .agg(F.max_by(F.struct("sql_text", "origin"), F.struct("bfs", "target_pos")).alias("w"))
        .select("path", "key", "w.sql_text", "w.origin")
    )


def older_sql_entries(nodes: DataFrame) -> DataFrame:
    """Older rule: `.sql(name)` only, with the text known at the time of the call.

    One pass over the file's events in order: the running last assignment of a
    name is what a call to it sees.
    """
    firsts = assignments(nodes).filter("target_pos = 0").select(
        "path", F.col("target").alias("key"), "bfs", F.col("src").alias("assigned"), F.lit(False).alias("is_call")
    )
    # the three constants that look like names are none
    named = F.col("arg").rlike(r"(?U)^[^\W\d]\w*$") & ~F.col("arg").isin("None", "True", "False")
    calls = _sql_calls(nodes, fv.OLDER_SQL_CALL_METHODS).filter(named).select(
        "path", F.col("arg").alias("key"), "bfs", F.lit(None).cast("string").alias("assigned"),
        F.lit(True).alias("is_call"),
    )
    so_far = W.partitionBy("path", "key").orderBy("bfs").rowsBetween(W.unboundedPreceding, 0)
    return (
        firsts.unionByName(calls)
        .withColumn("seen", F.last("assigned", ignorenulls=True).over(so_far))
        .filter("is_call")
        .groupBy("path", "key").agg(F.coalesce(F.max_by("seen", "bfs"), F.lit("")).alias("sql_text"))
    )


def inline_sql_lines(texts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Lines holding SELECT or "create table" in any case, trimmed."""
    lines = texts.select(
        F.col(id_column), F.posexplode(F.split(text_column, "\n")).alias("line_no", "line")
    )
    line = F.upper("line")
    return lines.filter(F.contains(line, F.lit("SELECT")) | F.contains(F.lower("line"), F.lit("create table"))).select(
        id_column, F.col("line_no") + 1, strip(F.col("line")).alias("line")
    ).toDF(id_column, "line_no", "line")


# --- business rules ---------------------------------------------------------
def condition_rules(nodes: DataFrame) -> DataFrame:
    """Each `if`: its test and the statements of its body, nested `if`s left out."""
    is_if = F.col("kind") == "If"
    rows = nodes.filter(is_if | ((F.col("parent_kind") == "If") & (F.col("field") == "body")))
    return (
        rows.withColumn("rule", F.when(is_if, F.col("bfs")).otherwise(F.col("parent")))
        .groupBy("path", "rule")
        .agg(
            F.max(F.when(is_if, F.col("src"))).alias("condition"),
            F.array_sort(F.collect_list(F.when(~is_if, F.struct("pos", "src")))).alias("body"),
        )
        .select("path", "rule", "condition", F.transform("body", lambda s: s.src).alias("actions"))
    )


def call_rules(nodes: DataFrame) -> DataFrame:
    """Method calls whose name suggests a business rule."""
    return nodes.filter(
        (F.col("kind") == "Call") & contains_any(F.lower("name"), fv.RULE_CALL_WORDS)
    ).select(
        "path", F.col("bfs").alias("rule"), F.col("callee").alias("function"), F.col("args").alias("arguments"),
        F.col("src").alias("full_call"),
    )


def business_rules(nodes: DataFrame) -> DataFrame:
    """Both kinds in one table, discriminated by `type`."""
    return (
        condition_rules(nodes).withColumn("type", F.lit("condition"))
        .unionByName(call_rules(nodes).withColumn("type", F.lit("function_call")), allowMissingColumns=True)
    )


# --- per-file row and corpus overview --------------------------------------
def _file_events(nodes: DataFrame) -> DataFrame:
    """What one pass over the nodes gives of each: functions, names, strings, moves and rule calls."""
    kind, value = F.col("kind"), F.col("str_value")
    assigned = (F.col("parent_kind") == "Assign") & (F.col("field") == "value")
    text = assigned & (kind == "Constant") & value.isNotNull()
    is_path = contains_any(value, fv.FILE_PATH_MARKS)
    moved = assigned & (kind == "Call") & F.col("name").isin(fv.DATAFRAME_METHODS)
    ruled = (kind == "Call") & contains_any(F.lower("name"), fv.RULE_CALL_WORDS)
    rows = nodes.filter(kind.isin("Module", "FunctionDef") | assigned | ruled)
    return rows.select(
        "path", F.when(kind == "FunctionDef", F.struct("bfs", "name")).alias("defined"),
        F.when(assigned, F.col("targets")).alias("names"),
        F.when(text & is_path, value).alias("file_path"),
        F.when(text & ~is_path & contains_any(F.upper(value), fv.CONFIG_WORDS), value).alias("config"),
        F.when(moved, F.struct("targets", "owner", "name", "src", "functions")).alias("move"),
        F.when(ruled, F.struct(
            F.col("bfs").alias("rule"), F.lit("function_call").alias("type"), F.lit(None).cast("string").alias("condition"),
            F.lit(None).cast("array<string>").alias("actions"), F.col("callee").alias("function"), F.col("args").alias("arguments"),
            F.col("src").alias("full_call"))).alias("rule"))


def file_entities(nodes: DataFrame) -> DataFrame:
    """One nested row per parsed file; a file without entities has empty arrays.

    All parts meet in one aggregate by path; none is joined.  What needs more than its own
    node (last writes, queries, bodies of conditions) comes as rows of three more passes.
    """
    conditions = condition_rules(nodes).select("path", F.struct(
        "rule", F.lit("condition").alias("type"), "condition", "actions", F.lit(None).cast("string").alias("function"),
        F.lit(None).cast("array<string>").alias("arguments"), F.lit(None).cast("string").alias("full_call")).alias("rule"))
    frames = dataframes(nodes).select("path", F.struct("name", "df_type", "method", "source").alias("frame"))
    sql = sql_entries(nodes).select("path", F.struct("key", "sql_text").alias("query"))
    rows = _file_events(nodes)
    for part in (conditions, frames, sql):
        rows = rows.unionByName(part, allowMissingColumns=True)
    names = ["defined", "names", "file_path", "config", "move", "rule", "frame", "query"]
    # conditions alone make no file: an unparsable one has no nodes of these kinds
    grouped = rows.groupBy("path").agg(*[F.collect_list(n).alias(n) for n in names])
    distinct = lambda c: F.array_sort(F.array_distinct(c))
    of_function = F.map_from_entries("defined")
    move = lambda m, target, inside: F.struct(
        target.alias("target"), m["owner"].alias("source"), m["name"].alias("operation"), m["src"].alias("details"), inside.alias("in_function"))
    none = F.lit(None).cast("string")
    # once for the file, and once for every function around it
    inside = lambda m: F.concat(F.array(none), F.when(m["name"].isin(fv.FUNCTION_DATAFRAME_METHODS), F.transform(
        m["functions"], lambda f: F.element_at("of_function", f))).otherwise(F.array().cast("array<string>")))
    moves = F.flatten(F.transform("move", lambda m: F.flatten(F.transform(m["targets"], lambda t: F.transform(inside(m), lambda i: move(m, t, i))))))
    return grouped.withColumn("of_function", of_function).select(
        "path", distinct(F.transform("defined", lambda d: d["name"])).alias("functions"), distinct(F.flatten("names")).alias("variables"),
        distinct("file_path").alias("file_paths"), distinct("config").alias("configs"),
        F.map_from_entries(F.array_sort("query")).alias("sql_vars"), F.array_sort(moves).alias("df_transformations"),
        F.array_sort("frame").alias("dataframes"), F.array_sort("rule").alias("business_rules"))


OVERVIEW_METRICS = ["Files", "Functions", "Variables", "File Paths", "SQL Queries", "Transformations"]
_SUMMED = ["Files", "Transformations"]


def overview_items(nodes: DataFrame) -> DataFrame:
    """path, metric, item, weight: what the overview counts, in one pass over the nodes, and the SQL texts.

    Distinct items count, and weights where everything counts: files, and
    transformations, which count again for every function around them.
    """
    item = lambda metric, text, weight: F.struct(F.lit(metric).alias("metric"), text.cast("string").alias("item"), weight.cast("long").alias("weight"))
    one, none, value, name = F.lit(1), F.lit(0), F.col("str_value"), F.col("name")
    kind = F.col("kind")
    assigned = (F.col("parent_kind") == "Assign") & (F.col("field") == "value")
    moves = name.isin(fv.DATAFRAME_METHODS).cast("int") + F.when(name.isin(fv.FUNCTION_DATAFRAME_METHODS), F.size("functions")).otherwise(0)
    only = lambda condition, items: F.when(condition, items).otherwise(F.array().cast("array<struct<metric:string,item:string,weight:bigint>>"))
    rows = nodes.filter(kind.isin("Module", "FunctionDef") | assigned).select("path", F.explode(F.concat(
        only(kind == "Module", F.array(item("Files", F.lit(None), one))),
        only(kind == "FunctionDef", F.array(item("Functions", name, none))),
        only(assigned, F.transform("targets", lambda t: item("Variables", t, none))),
        only(assigned & (kind == "Constant") & value.isNotNull() & contains_any(value, fv.FILE_PATH_MARKS), F.array(item("File Paths", value, none))),
        only(assigned & (kind == "Call") & (moves > 0), F.transform("targets", lambda t: item("Transformations", F.lit(None), moves))),
    )).alias("i")).select("path", "i.*")
    return rows.unionByName(sql_entries(nodes).select("path", F.lit("SQL Queries").alias("metric"), F.col("sql_text").alias("item"), none.cast("long").alias("weight")))


def overview(nodes: DataFrame, approximate: bool = False) -> DataFrame:
    """Corpus counts as (metric, count); distincts may be approximated on request."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    every = nodes.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, OVERVIEW_METRICS))).alias("metric"))
    items = overview_items(nodes).drop("path").unionByName(every, allowMissingColumns=True)
    # of files and transformations no item is distinct: only weights move
    counts = items.groupBy("metric").agg(distinct("item").alias("n"), F.coalesce(F.sum("weight"), F.lit(0)).alias("total"))
    return counts.select("metric", F.when(F.col("metric").isin(_SUMMED), F.col("total")).otherwise(F.col("n")).alias("count"))


def variable_report(nodes: DataFrame) -> DataFrame:
    frames = dataframes(nodes).select("path", "name", F.lit(True).alias("is_frame"))
    return variable_names(nodes).join(frames, ["path", "name"], "left").select(
        F.col("path").alias("filename"), F.col("name").alias("variable"),
        F.when(F.col("is_frame"), "DataFrame").otherwise("Regular").alias("type"),
    )


def dataframe_report(nodes: DataFrame) -> DataFrame:
    return dataframes(nodes).select(
        F.col("path").alias("filename"), F.col("name").alias("dataframe"), F.col("df_type").alias("type"),
        F.concat_ws(" / ", F.coalesce("source", F.lit("")), F.coalesce("method", F.lit(""))).alias("source_method"),
    )


def transformation_report(nodes: DataFrame) -> DataFrame:
    return all_transformations(nodes).select(*TRANSFORMATION_COLUMNS)


def used_queries(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(path, sql) by the older rules: SQL-looking lines and arguments of `.sql(name)`."""
    lines = inline_sql_lines(files, "path", "content").select("path", F.col("line").alias("sql"))
    called = older_sql_entries(nodes).select("path", F.col("sql_text").alias("sql"))
    return lines.unionByName(called).filter(strip(F.col("sql")) != "")


def entity_report(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Tables, files and configurations in one list, by the older rules; a table
    names the query that used it."""
    from corpuslens.operators.sqltext import query_tables, sql_tokens

    used = used_queries(nodes, files).withColumn("query_id", F.sha2("sql", 256))
    # parse each distinct text once, then give the tables back to its users
    texts = used.groupBy("query_id").agg(F.min("sql").alias("sql"))
    tables = query_tables(sql_tokens(texts)).select("query_id", F.col("table_name").alias("name"))
    table_rows = used.join(tables, "query_id").select(
        "path", F.lit("Table").alias("entity_type"), "name", F.col("sql").alias("used_in_query")
    )
    plain = [
        (older_file_paths(nodes), "File"),
        (older_configs(nodes), "Config"),
    ]
    rows = [
        df.select("path", F.lit(kind).alias("entity_type"), F.col("value").alias("name"), F.lit("").alias("used_in_query"))
        for df, kind in plain
    ]
    return reduce(DataFrame.unionByName, rows, table_rows)
