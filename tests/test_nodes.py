"""Node rows, metrics and issues against direct loops over the syntax tree."""

import ast
import random

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import entities, issues, metrics
from corpuslens.sources import syntax
from corpuslens.sources.syntax import syntax_nodes, write_nodes

SHAPES = [
    "if a and b:\n{body}", "for i in x:\n{body}", "while a:\n{body}", "try:\n{body}\nexcept ValueError:\n    pass",
    "def f{n}(a, b=[], *, c={{}}):\n{body}", "class K{n}:\n    '''doc'''\n{body}", "async def g{n}():\n{body}",
    "with a as b:\n{body}", "v{n} = df.merge(x)", "v{n} = w{n} = 'SELECT 1'", "import a.b, c", "from . import d",
    "spark.sql(v{n})", "engine.execute('DELETE FROM t')", "dq.check_all(a, 'b')", "v{n}: int = 3", "pass",
    "try:\n{body}\nexcept ValueError:\n    '''why'''\nfinally:\n    pass", "x = lambda q=[]: q",
    "def h{n}(a, b, c, d, e, f, /, g, *args):\n    '''\n    '''\n{body}",
]


def random_script(seed: int) -> str:
    rng = random.Random(seed)

    def block(depth: int) -> str:
        lines = []
        for _ in range(rng.randint(1, 4)):
            shape = rng.choice(SHAPES if depth < 4 else [s for s in SHAPES if "{body}" not in s])
            body = "\n".join("    " + l for l in block(depth + 1).split("\n")) if "{body}" in shape else ""
            lines.append(shape.format(n=rng.randint(0, 3), body=body))
        return "\n".join(lines)

    return block(0)


SCRIPTS = {f"s{i}.py": random_script(i) for i in range(60)}
SCRIPTS |= {
    "empty.py": "", "broken.py": "def (\n", "comment.py": "# only\n\n", "null.py": "a\x00b",
    "doc.py": 'def a():\n    "  "\n\ndef b():\n    """\n    """\n\nclass C:\n    "x"\n',
    "deep.py": "x = " + "(" * 60 + "1" + ")" * 60 + "\n",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(SCRIPTS.items()), "path string, content string").repartition(5).cache()


@pytest.fixture(scope="module")
def nodes(files):
    return syntax_nodes(files).cache()


def trees():
    for path, text in SCRIPTS.items():
        try:
            yield path, ast.parse(text)
        except (SyntaxError, ValueError):
            pass


def every_file(value):
    """A value for each file, kept for those that do not parse."""
    return dict.fromkeys(SCRIPTS, value)


def test_unparsable_files_are_rows(nodes):
    bad = {r.path for r in nodes.filter("NOT parse_ok").collect()}
    assert bad == set(SCRIPTS) - {p for p, _ in trees()} and bad


def test_cognitive_equals_a_walk(nodes):
    expected = every_file(0.0)
    for path, tree in trees():
        total = level = 0
        for n in ast.walk(tree):
            if type(n).__name__ in ("If", "For", "While", "Try"):
                total, level = total + 1 + level, level + 1
            elif type(n).__name__ in ("FunctionDef", "ClassDef"):
                total, level = total + 1, 0
        expected[path] = float(total)
    assert {r.path: r.cognitive for r in metrics.cognitive(nodes).collect()} == expected


def test_counts_and_docstrings(nodes):
    count = lambda t, *k: sum(type(n).__name__ in k for n in ast.walk(t))
    got = {r.path: (r.cyclomatic, r.loops) for r in metrics.cyclomatic(nodes).collect()}
    assert got == every_file((0, 0)) | {
        p: (count(t, "If", "For", "While", "Try", "BoolOp"), count(t, "For", "While")) for p, t in trees()}
    coverage = every_file(0.0)
    for path, tree in trees():
        defs = [n for n in ast.walk(tree) if type(n).__name__ in ("FunctionDef", "ClassDef")]
        coverage[path] = 100.0 * sum(bool(ast.get_docstring(d)) for d in defs) / len(defs) if defs else 100.0
    got = {r.path: r.docstring_coverage for r in metrics.docstring_coverage(nodes).collect()}
    assert got == pytest.approx(coverage)


def test_imports_keep_order(nodes):
    expected = {path: [] for path in SCRIPTS}
    for path, tree in trees():
        names = expected[path]
        for n in ast.walk(tree):
            if isinstance(n, (ast.Import, ast.ImportFrom)):
                prefix = f"{n.module or ''}." if isinstance(n, ast.ImportFrom) else ""
                names += [prefix + a.name for a in n.names]
    assert {r.path: r.import_names for r in metrics.imports(nodes).collect()} == expected


def test_issue_counts(nodes):
    """(path, category) -> number of issues, by direct loops."""
    expected = {}
    for path, tree in trees():
        def add(category, n=1):
            if n:
                expected[path, category] = expected.get((path, category), 0) + n
        for n in ast.walk(tree):
            if isinstance(n, (ast.FunctionDef, ast.ClassDef)) and not ast.get_docstring(n):
                add("Documentation")
            if isinstance(n, ast.ExceptHandler) and all(isinstance(b, ast.Pass) for b in n.body):
                add("Error Handling")
            if isinstance(n, ast.FunctionDef):
                add("Maintainability", n.end_lineno - n.lineno > 50)
                add("Design", len(n.args.args) > 5)
                add("Bug Risk", sum(isinstance(d, (ast.List, ast.Dict, ast.Set)) for d in n.args.defaults))
                add("Complexity", sum(isinstance(c, (ast.If, ast.For, ast.While, ast.Try)) for c in ast.walk(n)) > 10)
    for path in set(SCRIPTS) - {p for p, _ in trees()}:
        expected[path, "Syntax"] = 1
    got = issues.issues(nodes).groupBy("path", "category").count().collect()
    assert {(r.path, r.category): r["count"] for r in got} == expected


@pytest.mark.parametrize("lines, found", [(50, 0), (51, 1)])
def test_length_threshold(spark, lines, found):
    text = "def f():\n" + "    a = 1\n" * lines
    nodes = syntax_nodes(spark.createDataFrame([("a.py", text)], "path string, content string"), entities=False)
    assert issues.long_functions(issues.function_facts(nodes)).count() == found


@pytest.mark.parametrize("lines, debt", [(30, 40.0), (31, 60.0)])
def test_debt_threshold(spark, lines, debt):
    files = spark.createDataFrame([("a.py", "def f():\n" + "    a = 1\n" * lines)], "path string, content string")
    row = metrics.maintainability(syntax_nodes(files, entities=False), files).first()
    assert (row.score, row.debt_ratio) == (100.0, debt)


def test_metrics_of_edge_files(nodes, files):
    rows = {r.path: r for r in metrics.flat_metrics(nodes, files).collect()}
    assert set(rows) == set(SCRIPTS)
    assert (rows["broken.py"].debt_ratio, rows["broken.py"].lines_total) == (100.0, 0)
    assert (rows["empty.py"].debt_ratio, rows["empty.py"].docstring_coverage, rows["empty.py"].score) == (0.0, 100.0, 100.0)
    assert (rows["comment.py"].lines_comment, rows["comment.py"].lines_blank, rows["comment.py"].comment_ratio) == (1, 1, 100.0)


def test_assignments_and_nested_functions(nodes):
    last, moves = {}, []
    for path, tree in trees():
        for n in ast.walk(tree):
            if isinstance(n, ast.Assign):
                for t in n.targets:
                    if isinstance(t, ast.Name):
                        last[path, t.id] = ast.unparse(n.value)
        for f in ast.walk(tree):
            if isinstance(f, ast.FunctionDef):
                moves += [(path, n.targets[0].id, f.name) for n in ast.walk(f)
                          if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call)]
    assert {(r.path, r.target): r.src for r in entities.last_assignment(nodes).collect()} == last
    got = entities.function_transformations(nodes).select("path", "target", "in_function").collect()
    assert sorted(tuple(r) for r in got) == sorted(moves)


def test_sql_entries_equal_a_walk(nodes):
    expected = {}
    for path, tree in trees():
        known = {t.id: n.value for n in ast.walk(tree) if isinstance(n, ast.Assign) for t in n.targets}
        found = {}
        for n in ast.walk(tree):
            if isinstance(n, ast.Assign) and isinstance(n.value, ast.Constant) and "SELECT" in str(n.value.value):
                found.update({t.id: n.value.value for t in n.targets})
            elif isinstance(n, ast.Expr) and isinstance(n.value, ast.Call) and n.value.func.attr in ("sql", "execute"):
                arg = n.value.args[0]
                if isinstance(arg, ast.Name) and arg.id in known:
                    value = known[arg.id]
                    found[arg.id] = value.value if isinstance(value, ast.Constant) else ast.unparse(value)
                elif isinstance(arg, ast.Constant):
                    found[f"inline_sql_{len(found)}"] = arg.value
        expected |= {(path, k): v for k, v in found.items()}
    assert {(r.path, r.key): r.sql_text for r in entities.sql_entries(nodes).collect()} == expected


def test_condition_rules_equal_a_walk(nodes):
    expected = sorted(
        (p, ast.unparse(n.test), "|".join(ast.unparse(b) for b in n.body if not isinstance(b, ast.If)))
        for p, t in trees() for n in ast.walk(t) if isinstance(n, ast.If))
    got = entities.condition_rules(nodes).select("path", "condition", F.array_join("actions", "|")).collect()
    assert sorted(tuple(r) for r in got) == expected


def test_partitioning_does_not_matter(files):
    pick = lambda n: sorted(map(str, issues.issues(syntax_nodes(files.repartition(n))).collect()))
    assert pick(1) == pick(64)


def test_one_file_holding_most_rows(spark):
    """A generated file far larger than the rest keeps every row."""
    big = "".join(f"def f{i}(a, b, c, d, e, g):\n    x = df.join(a)\n" for i in range(30_000))
    files = spark.createDataFrame([("big.py", big)] + [(f"s{i}.py", "x = 1\n") for i in range(50)], "path string, content string")
    nodes = syntax_nodes(files).cache()
    assert issues.too_many_args(issues.function_facts(nodes)).count() == 30_000
    assert entities.function_transformations(nodes).count() == 30_000
    assert metrics.cognitive(nodes).filter("path = 'big.py'").first().cognitive == 30_000.0


def test_a_call_passed_by_name_keeps_its_text(spark):
    text = "q = pd.read_sql('SELECT 1')\nspark.sql(q)\nr = 'SELECT 2'\nspark.sql(r)\n"
    rows = entities.sql_entries(syntax_nodes(spark.createDataFrame([("a.py", text)], "path string, content string")))
    assert {r.key: r.sql_text for r in rows.collect()} == {"q": "pd.read_sql('SELECT 1')", "r": "SELECT 2"}


def test_deep_expressions_lose_nothing(spark):
    """Metrics and issues do not depend on whether source text is rendered."""
    deep = "def f(a):\n    return a\nq = x" + " + x" * 3000 + "\nspark.sql(" + "(" * 60 + "1" + ")" * 60 + ")\n"
    files = spark.createDataFrame([("deep.py", deep), ("plain.py", "def g():\n    pass\n")], "path string, content string")
    both = [syntax_nodes(files, entities=e).cache() for e in (True, False)]
    flat = [sorted(map(tuple, metrics.flat_metrics(n, files).collect())) for n in both]
    found = [sorted(map(tuple, issues.report(issues.issues(n)).collect())) for n in both]
    assert flat[0] == flat[1] and found[0] == found[1]
    assert all(n.filter("NOT parse_ok").count() == 0 for n in both)
    source = both[0].filter("path = 'deep.py' AND field = 'value' AND array_contains(targets, 'q')").first().src
    assert source == "x" + " + x" * 3000


def test_written_nodes_are_parsed_once_and_grouped_without_exchange(spark):
    files = spark.createDataFrame([(f"f{i}.py", f"def g{i}(a):\n    return a\n") for i in range(40)], "path string, content string")
    nodes = write_nodes(spark, files, "nodes_of_test", buckets=4)
    try:
        counts = metrics.definition_counts(nodes)
        assert counts.count() == 40 and counts.agg(F.sum("functions")).first()[0] == 40
        plan = counts._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "MapInArrow" not in plan
    finally:
        spark.sql("DROP TABLE nodes_of_test")


BOOLEANS = [
    "x = 0xfor 1", "x = 1jor 2\n", "x=1or 2\ny=1.or 3\nz=1e5or 2", "x = 1\\\n or 2\r\ny = 3 and 4\r\n", "a = b\nif a: x = b or c; y = 1\nelif d and e: pass",
    "@(\n a or b)\ndef f(q=c and d, *, k=e or f) -> (g or h):\n  pass\n", "try:\n  pass\nexcept (A or B):\n  x = 1 and 2\n  import a\nelse:\n  y = (1\n or 2)",
    "match a or b:\n  case C(x) if x and y:\n    w = p or q\n    z = 1", "f'{a or b}'\nlambda a=b or c: a and d", "type X[T: (a or b)] = c and d",
    "class A(b or c, metaclass=d and e):\n  async def f(a=1 or 2):\n    async for i in j or k: pass", "for i in x: # or\n  \"\"\"and\nor\"\"\"\n  band = fork\n  pass",
    "try: pass\nexcept* A: x = y or z", "\x0cdef f(): return a or\\\n b", "def f(a, b=[1 or 2], /, c={}, *d, e=[]): 'doc'", "while not (a\n or b):\n  break\nelse: q = 1 or 2",
]


@pytest.mark.parametrize("text", BOOLEANS + list(SCRIPTS.values()))
def test_expressions_left_out_hold_no_boolean(text):
    tree = syntax._parsed(text)
    if tree is not None:
        plain = lambda rows: [(*r[3:7], len(r[7]), *r[8:]) for r in rows]
        rows = list(syntax._structure_rows("p", tree, syntax._boolean_lines(text)))
        assert plain(rows) == plain(syntax._structure_rows("p", tree, None))
        kinds = [r[6] for r in rows]
        for kind in ("If", "FunctionDef", "ClassDef", "alias", "Try"):
            assert kinds.count(kind) == sum(type(n).__name__ == kind for n in ast.walk(tree))
        # a boolean that is itself the default of a keyword, or of a lambda, is an argument of no report
        unseen = [d for n in ast.walk(tree) if isinstance(n, ast.arguments) for d in n.kw_defaults]
        unseen += [d for n in ast.walk(tree) if isinstance(n, (ast.Lambda, ast.AsyncFunctionDef)) for d in n.args.defaults]
        assert kinds.count("BoolOp") == sum(isinstance(n, ast.BoolOp) and n not in unseen for n in ast.walk(tree))


def test_only_lines_with_booleans_are_visited():
    class Untouched(ast.Call):
        def __getattribute__(self, name):
            pytest.fail(f"visited: {name}")

    text = "def f(a):\n    x = g(1)\n    for i in g(2):\n        return g(3)\n    if a or b:\n        del a[1]\n"
    tree = ast.parse(text)
    body = tree.body[0].body
    body[0].value, body[1].iter, body[1].body[0].value = (Untouched(ast.Name("g"), [], []) for _ in range(3))
    rows = list(syntax._structure_rows("p", tree, syntax._boolean_lines(text)))
    assert [r[6] for r in rows] == ["Module", "FunctionDef", "For", "If", "arg", "BoolOp"]


PLAIN = [
    "a = b", "a.b[0] += c(1).d", "f(a, 'x', k=None)", "return x == y", "x = f(a)(b)[1] // 2  # why", "match = type(a)", "a = 'x and y'", "x.y('')",
]
NOT_PLAIN = [
    "a", "'doc'", "a = b = c", "a = b or c", "not a", "a.if = 1", "None = 1", "f() = 1", "f(a=1, b)", "a = 07", "a = 1if b else c", "a = ''''", "a = b'x'",
    "a = (b", "a = b \\", "a: int = b", "x = y; z = 1", "print a", "a = f'{b}'", "a = 1_000", "if a: b()", "import a", "a = b)", "f(a b)", "pass", "a == b",
    "__debug__ = 1", "a = x" + " + x" * 9, "a = '\x00'", "a = é", "except = 1", "f(*a)", "a = b.", "return", "a = 1.e5", "yield x", "a = lambda: b",
]
PLACES = [
    "{0}\n", "{0}\n{0}\n{0}\n{0}\n", "def f(a):\n    {0}\n    {0}\n\n    {0}\n", "if a:\n    {0}\n    # note\n    {0}\nelse:\n  {0}\n{0}\n", "x = [\n{0}\n]\n",
    "x = '''\n{0}\n'''\n", "def f():\n    \"\"\"\n    {0}\n    \"\"\"\n    {0}\n", "x = f'''{{\n{0}\n}}\n{0}\n'''\n", "if a: \\\n{0}\n", "y = \\\n{0}\n", "x = 1; \\\n  {0}\n",
    "try:\n    {0}\nexcept A:\n    {0}\n    {0}\nexcept B:\n    if a:\n        {0}\n    {0}\nfinally:\n    {0}\n", "try:\n  pass\nexcept A:\n\n  {0}\n  pass\n",
    "match a:\n    case 1:\n        {0}\n        {0}\n", "match a:\n    {0}\n", "def f():\n    {0}\n      {0}\n", "def f():\n\t{0}\n        {0}\n", "@a\n{0}\n", "for i in a:\n{0}\n",
    "{0}\r\n{0}\r{0}\n", "class A:\n    {0}\n    def f(self): {0}\n    {0}\n{0}", "x = (\n{0}\n{0}\n", "\x0c{0}\n", "\ufeff{0}\n{0}\n", "if a:\n" + "    {0}\nelif b:\n" * 150 + "    {0}\n",
    "try: pass\nexcept:\n  {0}\n  {0}\n  {0}\n  {0}\n  try: pass\n  except A:\n    pass\n    {0}\n  {0}\n", "{0}\n{0}\n{0}\ndef f(): pass\n{0}\n{0}\nif a: pass\n",
    "async def f():\n  async with a:\n    {0}\n    {0}\n", "lambda: \\\n{0}\n", "x = '\\\n{0}\n'\n", "{0}\n{0}\ndef (\n", "try:\n  {0}\nexcept* A: {0}\n", "{0}\n\x00\n", "def f(\n{0}\n): pass\n",
]


def _rows_of(text, tree):
    """Rows without the numbers of nodes, which only have an order."""
    if tree is None:
        return None
    return [(*r[3:7], len(r[7]), *r[8:]) for r in syntax._structure_rows("p", tree, syntax._boolean_lines(text))]


@pytest.mark.parametrize("place", PLACES)
def test_plain_lines_need_no_parser(place):
    for line in PLAIN + NOT_PLAIN:
        text = place.format(line)
        assert _rows_of(text, syntax._structure(text)) == _rows_of(text, syntax._parsed(text)), text
    assert syntax._structure(None) is None


def test_plain_lines_are_whole_statements():
    assert [s for s in PLAIN if not syntax._PLAIN_RUN.fullmatch(s + "\n")] == []
    assert [s for s in NOT_PLAIN if syntax._PLAIN_RUN.match(s + "\n")] == []
    for line in PLAIN:
        (statement,) = ast.parse(line).body
        assert type(statement) in syntax._SIMPLE and not any(isinstance(n, ast.BoolOp) for n in ast.walk(statement))


def test_only_other_lines_reach_the_parser(monkeypatch):
    parsed, parse = [], syntax._parsed
    monkeypatch.setattr(syntax, "_parsed", lambda text: parsed.append(text) or parse(text))
    text = "def f(a):\n    x = g(1)\n    y = 2\n    h(x, y)\n    z = x or y\n    return z\n"
    tree = syntax._structure(text)
    assert parsed == ["def f(a):\n    pass\n\n    pass\n    z = x or y\n    pass\n"] and tree.body[0].end_lineno == 6


KINDS = [("FunctionDef", "ClassDef", "ParseError"), ("If", "arg"), ("Module",), ("ParseError",), ()]


@pytest.mark.parametrize("kinds", KINDS)
def test_only_rows_of_the_kinds_that_are_read_are_made(kinds):
    texts = [(str(i), t) for i, t in enumerate([*SCRIPTS.values(), *BOOLEANS, None])]
    every = [r for b in syntax._structure_batches(iter(texts)) for r in b.to_pylist()]
    some = [r for b in syntax._structure_batches(iter(texts), frozenset(kinds)) for r in b.to_pylist()]
    assert some == [r for r in every if r["kind"] in kinds] and {"FunctionDef", "ParseError", "Module", "If"} <= {r["kind"] for r in every}


def test_missing_docstrings_read_few_rows(spark):
    files = spark.createDataFrame([(f"{i}.py", t) for i, t in enumerate(SCRIPTS.values())], "path string, content string")
    few = syntax_nodes(files, entities=False, kinds=issues.REPORTED)
    pick = lambda n: sorted(map(str, issues.missing_docstrings(n).collect()))
    assert pick(few) == pick(syntax_nodes(files, entities=False)) != []
    assert {r.kind for r in few.select("kind").distinct().collect()} == set(issues.REPORTED)


def test_lists_without_booleans_are_not_visited():
    class Untouched(ast.Call):
        def __getattribute__(self, name):
            pytest.fail(f"visited: {name}")

    tree = ast.parse("def f(a, b=[g(1)]):\n    pass\n")
    tree.body[0].args.defaults[0].elts[0] = Untouched(ast.Name("g"), [], [])
    assert [r[6] for r in syntax._structure_rows("p", tree, [])] == ["Module", "FunctionDef", "arg", "arg", "List"]


def test_large_texts_leave_in_pieces(monkeypatch):
    monkeypatch.setattr(syntax, "_FLUSH_ROWS", 7)
    text = "".join(f"def f{i}(a):\n    'doc'\n" for i in range(20))
    batches = list(syntax._structure_batches(iter([("a", text), ("b", "x ="), ("c", text)])))
    assert [b.num_rows for b in batches] == [7] * 11 + [6]
    monkeypatch.setattr(syntax, "_FLUSH_CHARS", 3)
    assert sum(b.num_rows for b in syntax._structure_batches(iter([("a", text), ("b", "x ="), ("c", text)]))) == 83
