"""Tables, columns and clauses of hand-written queries."""

import pytest

from corpuslens.operators import sqltext

CASES = [
    ("SELECT a FROM t", ["t"], ["a"]), ("SELECT a FROM (t", [], ["a"]),
    ("select x, y from db.t1 a, t2 b", ["t1", "t2"], ["x", "y"]),
    ("SELECT * FROM a LEFT OUTER JOIN b ON a.id = b.id CROSS JOIN c", ["a", "b", "c"], [None]),
    ("SELECT a FROM t WHERE x IN (SELECT y FROM u, v)", ["t"], ["a"]),
    ("SELECT a FROM (SELECT b FROM u) s JOIN w ON 1 = 1", ["w"], ["a"]),
    ("SELECT 'x from y' AS z, count(*) n FROM \"My Table\" -- from q\n", ["My Table"], ["z", "count"]),
    ("INSERT INTO t SELECT a, b FROM s", ["s"], ["a", "b"]),
    ("SELECT DISTINCT a.b c, a + 1 AS d, CASE WHEN x THEN 1 END e, 5 FROM t; SELECT q FROM r", ["t"], ["b", "d", "e", None]),
    ("SELECT f(a, g(b)), t.* FROM /* from z */ t GROUP BY a HAVING count(*) > 1 ORDER BY a", ["t"], ["f", "*"]),
    ("DELETE FROM t WHERE a = 'it''s'", ["t"], []),
    ("SELECT extract(year FROM d) FROM t", ["t"], ["extract"]),
    ("   ", [], []), ("not sql at all", [], []), ("SELECT 'open FROM t", ["t"], ["open"]),  # an unclosed quote is a token of its own
]


@pytest.fixture(scope="module")
def analysed(spark):
    queries = sqltext.distinct_queries(spark.createDataFrame([(q,) for q, _, _ in CASES], "sql_text string")).cache()
    rows = sqltext.query_analysis(queries).join(queries, "query_id").collect()
    return {r.sql: r for r in rows}


@pytest.mark.parametrize("sql, tables, columns", CASES)
def test_tables_and_columns(analysed, sql, tables, columns):
    row = analysed[sql]
    assert row.tables == tables
    # a column without a name is null and array_sort keeps its place
    assert row.columns == columns


def test_clauses_and_errors(analysed):
    found = sorted(t.type for t in analysed[CASES[9][0]].transformations)
    assert found == ["GROUP BY", "HAVING", "ORDER BY", "column_transformation"]
    assert analysed["   "].error is None and analysed[CASES[0][0]].error is None
    assert analysed["DELETE FROM t WHERE a = 'it''s'"].error is None
    assert analysed["SELECT 'open FROM t"].error == "a quote is not closed"
    assert analysed["SELECT a FROM (t"].error == "a bracket is not closed"


def test_long_string_literal(spark):
    sql = "SELECT '" + "it''s " * 50_000 + "' AS a FROM t"
    queries = sqltext.distinct_queries(spark.createDataFrame([(sql,)], "sql_text string"))
    assert sqltext.query_analysis(queries).first().tables == ["t"]
