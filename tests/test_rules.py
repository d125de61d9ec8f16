"""The rule table against the rules in code, its edges, and the roll-up."""

from collections import Counter

from pyspark.sql import functions as F

from corpuslens.operators import issues, rules
from corpuslens.sources.syntax import syntax_nodes

SCRIPT = '''
class A:
    """Doc."""
    def m(self, a, b, c, d, e, f=[], *, g={}):
        def inner(x, y=(), z=set(), w={1}):
            for i in x:
                if i: pass
        try:
            inner(1)
        except ValueError:
            pass
        except KeyError:
            inner(2)
            pass
%s
class B: pass
async def no(): pass
'''


def nodes(spark):
    body = "".join("        if a: b = 1\n" for _ in range(60))
    files = [("a.py", SCRIPT % body), ("b.py", "def ("), ("c.py", ""), ("d.py", "x = 1\n"), (None, "def f(): pass\n")]
    return syntax_nodes(spark.createDataFrame(files, "path string, content string"), entities=False)


def plain(rows):
    return Counter(tuple(r) for r in rows.select("path", "line", "message", "severity", "category", "recommendation", "rule_rank", "bfs").collect())


def test_built_in_rules_equal_the_rules_in_code(spark):
    found = nodes(spark)
    want = plain(issues.issues(found))
    assert plain(rules.issues(rules.facts(found), rules.default_rules(spark))) == want and len(want) > 8


def test_rules_are_data(spark):
    found = rules.facts(nodes(spark))
    row = lambda *r: ("r", 1, *r, "LOW", "C", "{kind} {name}: {value} of {threshold}", "-")
    table = [row("function", "arguments", ">=", 6.0, False), row("function", "arguments", "<", 1.5, False), row("class", "length", "<=", 0.0, False),
             row("function", "mutable_defaults", ">", 0.0, True), row("nowhere", "length", ">", 0.0, False), row("function", "unknown", ">", 0.0, False),
             row("function", "length", "~", 0.0, False), row("function", "length", ">", None, False), row("file", "parse_errors", "=", 1.0, False)]
    got = Counter(r.message for r in rules.issues(found, spark.createDataFrame(table, rules.RULES)).collect())
    assert got == Counter({
        "function m: 7 of 6.0": 1, "function f: 0 of 1.5": 1, "class B: 0 of 0.0": 1, "function m: 1 of 0.0": 1, "function inner: 1 of 0.0": 1,
        "function : 1 of 1.0": 1})
    assert rules.issues(found, spark.createDataFrame([], rules.RULES)).count() == 0
    assert rules.issues(rules.facts(nodes(spark).limit(0)), rules.default_rules(spark)).count() == 0


def test_values_are_not_dealt_out_by_rule(spark):
    """At any size: without size checks only the hint keeps all values of a scope out of one task."""
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = rules.issues(rules.facts(nodes(spark)), rules.default_rules(spark))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(scope" not in plan and "BroadcastHashJoin" in plan and "BuildRight" in plan
        assert plain(rows) == plain(issues.issues(nodes(spark)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)


def test_roll_up_counts_a_file_once(spark):
    rows = spark.createDataFrame(
        [("a/b/x.py", "C", "LOW"), ("a/b/x.py", "C", "HIGH"), ("a/b/x.py", "D", "LOW"), ("a/y.py", "C", "LOW"), ("a/y.py", "C", "LOW"), ("z.py", "C", "LOW")],
        "path string, category string, severity string")
    got = {(r.folder, r.category, r.severity): (r.issues, r.files) for r in rules.issue_rollup(rows).collect()}
    assert got["", None, None] == (6, 3) and got["a", None, None] == (5, 2) and got["a/b", None, None] == (3, 1)
    assert got["a", "C", None] == (4, 2) and got["a", "C", "LOW"] == (3, 2) and got["", "C", "HIGH"] == (1, 1) and got["a/b", "D", "LOW"] == (1, 1)
    assert {k[0] for k in got} == {"", "a", "a/b"}
    assert rules.issue_rollup(rows.limit(0)).count() == 0


def test_folders(spark):
    rows = spark.createDataFrame([("a/b/c.py",), ("x.py",), ("/r/x",), (None,)], "path string").select(rules.folders(F.col("path")).alias("f"))
    assert [r.f for r in rows.collect()] == [["", "a", "a/b"], [""], ["", "/r"], None]


def test_light_report_reads_its_nodes_once(spark):
    text = "def f(a, b, c, d, e, g):\n" + "    x = 1\n" * 51
    files = spark.createDataFrame([("a.py", text), ("b.py", "def g(a, b, c, d, e, h):\n    pass\n")], "path string, content string")
    found = issues.light_issues(syntax_nodes(files, entities=False, kinds=issues.FACTS_READ[0], columns=issues.FACTS_READ[1]))
    assert sorted((r.path, r.type, r.line, r.severity) for r in found.collect()) == [
        ("a.py", "long_function", 1, "warning"), ("a.py", "too_many_args", 1, "warning"), ("b.py", "too_many_args", 1, "warning")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
