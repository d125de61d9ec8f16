"""Tables, columns and clauses of SQL text, from a token table.

No grammar: a query is split into tokens by one regular expression, and windows
over the token rows carry bracket depth and current clause.  Queries are made
distinct first, so a text used in a third of all files is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslens.functions.text import is_blank, sorted_join, strip

_NAME = r'(?:[^\W\d][\w$]*+|"[^"]*+"|`[^`]*+`)'
# leading white space stays with its token, so that joined tokens give the text back
_TOKEN = (
    r"(?U)\s*+(?:--[^\n]*+|/\*(?s:.*?)\*/|'(?:[^']++|'')*+'"
    rf"|{_NAME}(?:\.(?:{_NAME}|\*))*+|\d+(?:\.\d+)?|<>|!=|<=|>=|\|\||\S)"
)
# literals, quoted names and comments that end; a doubled quote is two literals side by side
_CLOSED = r"'[^']*+'|\"[^\"]*+\"|`[^`]*+`|--[^\n]*+|/\*(?s:.*?)\*/"
_IDENTIFIER = rf"(?U)^{_NAME}(?:\.(?:{_NAME}|\*))*$"
_CLAUSES = ["SELECT", "FROM", "JOIN", "WHERE", "ON", "USING", "GROUP", "ORDER", "HAVING", "LIMIT", "UNION",
            "INTERSECT", "EXCEPT", "SET", "VALUES", "INTO", "WINDOW", "QUALIFY"]
_NOT_NAMES = _CLAUSES + ["AS", "BY", "AND", "OR", "NOT", "CASE", "WHEN", "THEN", "ELSE", "END", "IN", "IS", "NULL",
                         "LEFT", "RIGHT", "FULL", "INNER", "OUTER", "CROSS", "NATURAL", "DISTINCT", "ALL",
                         "LATERAL", "ONLY"]


def distinct_queries(entries: DataFrame) -> DataFrame:
    """Distinct non-null SQL texts, keyed by their hash."""
    return (
        entries.filter("sql_text IS NOT NULL")
        .select(F.sha2("sql_text", 256).alias("query_id"), F.col("sql_text").alias("sql"))
        .groupBy("query_id").agg(F.min("sql").alias("sql"))
    )


def sql_tokens(queries: DataFrame) -> DataFrame:
    """queries(query_id, sql) -> query_id, pos, tok, raw, upper, depth, clause.

    Comments are dropped and only the first statement counts.  The clause is
    tracked outside brackets only.  All windows share the partitioning that the
    distinct on `query_id` left behind.
    """
    in_order = W.partitionBy("query_id").orderBy("pos")
    to_here = in_order.rowsBetween(W.unboundedPreceding, 0)
    tok = F.col("tok")
    tokens = (
        queries.select("query_id", F.posexplode(F.regexp_extract_all("sql", F.lit(_TOKEN), F.lit(0))).alias("pos", "raw"))
        .withColumn("tok", F.regexp_replace("raw", r"(?U)^\s+", ""))
        .filter(~F.startswith(tok, F.lit("--")) & ~(F.startswith(tok, F.lit("/*")) & (F.length(tok) > 1)))
        .withColumn("upper", F.upper("tok"))
    )
    step = F.when(tok == "(", 1).when(tok == ")", -1).otherwise(0)
    return (
        tokens
        .withColumn("depth", F.sum(step).over(to_here).cast("int"))
        .withColumn("ended", F.sum(F.when((tok == ";") & (F.col("depth") == 0), 1).otherwise(0)).over(to_here))
        .filter("ended = 0")
        .withColumn("clause", F.last(
            F.when((F.col("depth") == 0) & F.col("upper").isin(_CLAUSES), F.col("upper")), ignorenulls=True
        ).over(to_here))
        .select("query_id", "pos", "tok", "raw", "upper", "depth", "clause")
    )


def query_tables(tokens: DataFrame) -> DataFrame:
    """Tables after FROM and JOIN outside brackets, comma lists included."""
    in_order = W.partitionBy("query_id").orderBy("pos")
    first_of = (
        tokens.withColumn("before", F.lag("upper").over(in_order))
        .filter(
            (F.col("depth") == 0) & F.col("clause").isin("FROM", "JOIN")
            & F.col("before").isin("FROM", "JOIN", ",")
            & F.col("tok").rlike(_IDENTIFIER) & ~F.col("upper").isin(_NOT_NAMES)
        )
    )
    return first_of.select(
        "query_id", "pos",
        F.regexp_replace(F.regexp_extract("tok", rf"(?U)({_NAME}|\*)$", 1), r'^["`]|["`]$', "").alias("table_name"),
        F.col("tok").alias("qualified"),
    )


def select_items(tokens: DataFrame) -> DataFrame:
    """Items of the select lists: query_id, col_idx, column_name, expression.

    The name is the one before an alias; an expression is named by its alias.
    """
    in_order = W.partitionBy("query_id").orderBy("pos")
    to_here = in_order.rowsBetween(W.unboundedPreceding, 0)
    top = F.col("depth") == 0
    starts = top & (F.col("upper") == "SELECT")
    breaks = starts | (top & (F.col("clause") == "SELECT") & (F.col("tok") == ","))
    items = (
        tokens.withColumn("item", F.sum(F.when(breaks, 1).otherwise(0)).over(to_here))
        .filter((F.col("clause") == "SELECT") & ~breaks & ~(top & F.col("upper").isin("DISTINCT", "ALL")))
        .groupBy("query_id", "item")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "raw", "tok", "upper", "depth"))).alias("t"))
    )
    n = F.size("t")
    last, prev, first = (F.try_element_at("t", F.lit(i)) for i in (-1, -2, 1))
    is_name = lambda t: t.tok.rlike(_IDENTIFIER) & ~t.upper.isin(_NOT_NAMES)
    has_as = (n >= 3) & (prev.upper == "AS")
    has_alias = has_as | ((n >= 2) & is_name(last) & (last.depth == 0) & (
        is_name(prev) | prev.tok.rlike(r"^[)'\d]") | (prev.upper == "END")))
    return (
        items.withColumn("core", F.slice("t", 1, n - F.when(has_as, 2).when(has_alias, 1).otherwise(0)))
        .withColumn("alias", F.when(has_alias, last.tok))
        # bare name or one function call: a single token outside its brackets
        .withColumn("outside", F.size(F.filter("core", lambda t: (t.depth == 0) & (t.tok != ")"))))
        .select(
            "query_id", (F.col("item") - 1).cast("int").alias("col_idx"),
            F.regexp_replace(F.regexp_extract(
                F.when((F.col("outside") == 1) & is_name(first), first.tok).otherwise(F.col("alias")),
                rf"(?U)({_NAME}|\*)$", 1), r'^["`]|["`]$', "").alias("column_name"),
            strip(F.array_join(F.transform("t", lambda t: t.raw), "")).alias("expression"),
        )
        .withColumn("column_name", F.when(F.col("column_name") != "", F.col("column_name")))
    )


def column_transformations(tokens: DataFrame) -> DataFrame:
    """Select items with an alias keyword or a bracket."""
    text = F.col("expression")
    return select_items(tokens).filter(F.contains(text, F.lit(" AS ")) | F.contains(text, F.lit("("))).select(
        "query_id", F.lit("column_transformation").alias("type"), "expression"
    )


def clause_markers(tokens: DataFrame, queries: DataFrame) -> DataFrame:
    """GROUP BY, ORDER BY and HAVING outside brackets, with the statement text."""
    in_order = W.partitionBy("query_id").orderBy("pos")
    name = F.when(F.col("upper").isin("GROUP", "ORDER") & (F.lead("upper").over(in_order) == "BY"),
                  F.concat("upper", F.lit(" BY"))).when(F.col("upper") == "HAVING", F.lit("HAVING"))
    return (
        tokens.withColumn("type", name).filter("type IS NOT NULL AND depth = 0")
        .join(queries, "query_id")
        .select("query_id", "type", F.col("sql").alias("expression"))
    )


def query_edges(queries: DataFrame, tables: DataFrame) -> DataFrame:
    """Lineage edges table -> result of a SELECT on it."""
    selecting = queries.filter(~is_blank(F.col("sql")) & F.contains(F.upper("sql"), F.lit("SELECT")))
    return tables.join(selecting, "query_id", "left_semi").select(
        F.lit("table").alias("source_type"), F.col("table_name").alias("source"),
        F.lit("query_result").alias("target_type"),
        F.concat(F.lit("result_of_"), "table_name", F.lit("_query")).alias("target"),
        F.lit("SQL_SELECT").alias("operation"), F.lit("sql_query").alias("filename"),
    )


def reading_error() -> Column:
    """What is wrong with a text that cannot be read whole, else null; a blank text is no error."""
    bare = F.regexp_replace("sql", _CLOSED, " ")
    count = lambda c: F.length(bare) - F.length(F.replace(bare, F.lit(c), F.lit("")))
    return (
        F.when(F.contains(bare, F.lit("'")) | F.contains(bare, F.lit('"')) | F.contains(bare, F.lit("`")), "a quote is not closed")
        .when(F.contains(bare, F.lit("/*")), "a comment is not closed")
        .when(count("(") > count(")"), "a bracket is not closed").when(count("(") < count(")"), "a bracket is not open")
    )


def query_analysis(queries: DataFrame) -> DataFrame:
    """Per query: tables, columns, transformations (empty arrays for a blank text), and what keeps it from being read whole."""
    tokens = sql_tokens(queries)
    tables = query_tables(tokens).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "table_name"))), lambda s: s.table_name).alias("tables"))
    columns = select_items(tokens).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "column_name"))), lambda s: s.column_name).alias("columns"))
    changes = (
        column_transformations(tokens).unionByName(clause_markers(tokens, queries))
        .groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("type", "expression"))).alias("transformations"))
    )
    empty = F.array().cast("array<string>")
    return (
        queries.join(tables, "query_id", "left").join(columns, "query_id", "left").join(changes, "query_id", "left")
        .select(
            "query_id",
            F.coalesce("tables", empty).alias("tables"), F.coalesce("columns", empty).alias("columns"),
            F.coalesce("transformations", F.array()).alias("transformations"),
            reading_error().alias("error"),
        )
    )


def query_report(queries: DataFrame, tables: DataFrame, explanations: DataFrame | None = None) -> DataFrame:
    """query_id, sql, joined table list, explanation (null until answered)."""
    joined = tables.groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "table_name"))), lambda s: s.table_name), ", ").alias("tables"))
    report = queries.filter(~is_blank(F.col("sql"))).join(joined, "query_id", "left")
    if explanations is None:
        report = report.withColumn("explanation", F.lit(None).cast("string"))
    else:
        report = report.join(explanations, "query_id", "left")
    return report.select("query_id", "sql", F.coalesce("tables", F.lit("")).alias("tables"), "explanation")


# --- strict test -------------------------------------------------------------------
# --- fixed values: states of a statement's start, by (state, token); `x` is any other token -----------
STATEMENT_STATES = {
    "start": {"SELECT": "select", "WITH": "with", "INSERT": "insert", "UPDATE": "update", "DELETE": "delete", "CREATE": "create"},
    "select": {"x": "items", "(": "items"},
    "items": {"x": "items", "(": "items", ",": "items", "AS": "items", "FROM": "from"},
    "from": {"x": "whole", "(": "whole"},
    "with": {"x": "named"},
    "named": {"AS": "as", "(": "named"},
    "as": {"(": "bound"},
    "bound": {",": "with", "SELECT": "select", "INSERT": "insert", "UPDATE": "update", "DELETE": "delete"},
    "insert": {"INTO": "into"},
    "into": {"x": "into", "TABLE": "into", "(": "into", "VALUES": "values", "SELECT": "select", "WITH": "with"},
    "values": {"(": "whole"},
    "update": {"x": "update", "SET": "set"},
    "set": {"x": "whole"},
    "delete": {"FROM": "from"},
    "create": {"x": "create", "TABLE": "table"},
    "table": {"x": "whole"},
    "whole": {t: "whole" for t in ["x", "(", ",", "SELECT", "FROM", "WITH", "AS", "INTO", "VALUES", "SET", "TABLE"]} | {";": "ended"},
    "ended": {";": "ended"},
}
_STATEMENT_TOKEN = r"""'(?:[^']++|'')*+'|"[^"]*+"|`[^`]*+`|--[^\n]*+|[A-Za-z_][A-Za-z0-9_$]*|[0-9]+|[^\sA-Za-z0-9_]"""
_STATEMENT_WORDS = sorted({t for moves in STATEMENT_STATES.values() for t in moves} - {"x"})


def is_statement(text: Column) -> Column:
    """A strict test: the text has the shape of one statement, with its brackets closed.

    A small automaton is folded over the tokens of a text; nothing inside brackets moves
    it.  It accepts SELECT..FROM, WITH, INSERT, UPDATE, DELETE and CREATE TABLE, and does not
    look further into them.  Null is no statement.
    """
    tokens = F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_STATEMENT_TOKEN), F.lit(0)), F.upper), lambda t: ~t.startswith("--"))
    moves = F.create_map(*[F.lit(x) for state, to in STATEMENT_STATES.items() for token, after in to.items() for x in (f"{state} {token}", after)])

    def step(s: Column, t: Column) -> Column:
        depth = s["depth"] + (t == "(").cast("int") - (t == ")").cast("int")
        token = F.when(t.isin(_STATEMENT_WORDS), t).otherwise("x")
        closes = (t == ")") & (s["depth"] == 0)
        state = F.when(s["state"] == "no", "no").when(closes, "no").when(s["depth"] > 0, s["state"]).otherwise(
            F.coalesce(F.try_element_at(moves, F.concat_ws(" ", s["state"], token)), F.lit("no")))
        return F.struct(state.alias("state"), depth.alias("depth"))

    end = F.aggregate(tokens, F.struct(F.lit("start").alias("state"), F.lit(0).alias("depth")), step)
    return end["state"].isin("whole", "ended") & (end["depth"] == 0)
