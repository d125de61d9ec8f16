"""Corpora dealt out before their texts are rendered, and source text without the visitor."""

import ast

import duckdb
import pytest
from pyspark.sql import functions as F

from corpuslens.plans import script_queries
from corpuslens.sources import corpora, syntax, workspace

LINES = [  # two orders, one of them broken; equal lines, and a null that renders no piece
    (97, 1, 13.0, 61, 15, 10.0, 0.06, 0.08, "A", "O"), (97, 2, 45.0, 3, 3, 20.0, 0.0, 0.0, "R", "F"),
    (98, 1, 11.0, 59, 5, 30.0, 0.0, 0.05, "R", "O"), (98, 1, 11.0, 59, 5, 30.0, 0.0, 0.05, "R", "O"),
    (98, 2, 2.0, None, 7, 30.0, 0.1, 0.05, "N", "O"),
]
SHAPE = ("l_orderkey long, l_linenumber int, l_quantity double, l_partkey long, l_suppkey long, l_extendedprice double,"
         " l_discount double, l_tax double, l_returnflag string, l_linestatus string")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(LINES, SHAPE).coalesce(1).write.parquet(f"{where}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in range(1, 41)], "s_suppkey long").coalesce(1).write.parquet(f"{where}/supplier.parquet")
    return where


def exchanges(rows):
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return plan, plan.count("Exchange hashpartitioning(path")


def test_scripts_move_columns_and_no_text(spark, folder):
    rows = corpora.scripts(spark, folder)
    plan, n = exchanges(rows)
    assert n == 1 and plan.count("Exchange") == 1 and "def f" not in plan[plan.index("Exchange"):]
    assert exchanges(rows.groupBy("path").count())[0].count("Exchange") == 1
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    order = ", ".join(corpora.SCRIPT_ORDER)
    expected = con.execute(
        f"SELECT {corpora.SCRIPT_PATH}, concat(string_agg(p, '' ORDER BY {order}), {corpora.SCRIPT_TAIL}) FROM"
        f" (SELECT *, CASE WHEN l_partkey IS NULL THEN NULL ELSE {corpora.SCRIPT_PIECE} END AS p FROM lineitem) l GROUP BY l_orderkey").fetchall()
    assert sorted(map(tuple, rows.collect())) == sorted(expected)


def test_one_pass_parses_and_writes_nothing(spark, folder):
    workspace.release(spark)
    plan, _ = exchanges(script_queries.m1(spark, folder))
    assert "MapInArrow" in plan and not [t for t in spark.catalog.listTables() if t.name.startswith("corpuslens_")]
    parsed = sorted(map(tuple, script_queries.m1(spark, folder).collect()))
    corpora.written_nodes(spark, folder, "scripts")
    plan, _ = exchanges(script_queries.m1(spark, folder))
    assert "MapInArrow" not in plan and sorted(map(tuple, script_queries.m1(spark, folder).collect())) == parsed
    workspace.release(spark)


def test_ranking_renders_texts_before_its_sort(spark, folder):
    workspace.release(spark)
    ranked = script_queries.debt_ranking(spark, folder)
    plan, _ = exchanges(ranked)
    assert "rangepartitioning" in plan and "lineitem" not in plan and "collect_list" not in plan
    rows = [(r.path, r.functions, r.debt_ratio) for r in ranked.collect()]
    assert [r[:2] for r in rows] == [("jobs/job_97.py", 0), ("jobs/job_98.py", 2)] and rows[0][2] == 100.0
    workspace.release(spark)


def test_deep_files_are_dealt_out_and_parsed_once(spark, folder):
    rows = corpora.deep_files(spark, folder)
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    plan, _ = exchanges(script_queries.m10_deep(spark, folder))
    assert "MapInArrow" not in plan and script_queries.m10_deep(spark, folder).count() == 80
    workspace.release(spark)


EXPRESSIONS = [
    "x", "'a'", "u'a'", "1", "1 .real", "True", "None", "...", "1.5", "1e400", "b'x'", "-1", "a.b.c", "'a'.join(x)", "(a + b).c", "(1).real",
    "f(a, *b, c=1, **d)", "f(x for x in y)", "(lambda: 0)()", "a[1]", "a[1, 2]", "a[()]", "a[1:2]", "a < b <= c", "(a < b) < c", "a + 1 < b",
    "not a in b", "a is not b", "a + b - c", "a - (b - c)", "(a + b) * c", "a + b * c", "a * b + c", "a ** b", "(a or b) + c", "a | b & c",
    "a & b | c", "x[a + b]", "f(a < b)", "f(a=b + c)", "f'{a}'", "'a' 'b'", "(yield)", "await_(x)", "(a := 1)", "a if b else c", "'\\n\\t\"\\''",
]


@pytest.mark.parametrize("text", EXPRESSIONS + [f"a = {e}" for e in EXPRESSIONS] + ["a = b = c", "a.b = c", "a, b = c"])
def test_plain_text_is_what_unparse_writes(text):
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, (ast.expr, ast.Expr, ast.Assign)):
            assert syntax._plain(node) in (None, ast.unparse(node))


def test_a_long_sum_needs_no_stack(monkeypatch):
    monkeypatch.setattr(syntax, "_deep_source", lambda node: pytest.fail("rendered on a stack of its own"))
    text = "x" + " + x" * 4000
    assert syntax._source(ast.parse(text, mode="eval").body) == text


def test_projects_and_answers_are_dealt_out_before_rendering(spark, tmp_path):
    rows = [(k, k % 50) for k in range(200)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for build, text in ((corpora.project_files, "content"), (corpora.file_answers, "raw")):
        made = build(spark, str(tmp_path))
        assert made.count() == 200 and made.select(F.spark_partition_id().alias("p")).distinct().count() > 1
        plan, n = exchanges(made)
        assert n == 1 and "import os" not in plan[plan.index("Exchange"):] and "Loads " not in plan[plan.index("Exchange"):]
