"""Key files, dependencies, answers and sources on fixed inputs with results found by hand."""

import hashlib
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.functions.lenient import read_json
from corpuslens.operators import answers, project, project_lineage, prompts
from corpuslens.sources import files as sources

WORDY = [("myapp.rb", 10), ("Config.yml", 10)]
MAINS = lambda n: [(f"d{i}/main.py", 10) for i in range(n)]
# name and length of the files of a project in listing order, and the key files, found by hand
KEY_FILES = {
    "all tiers": (
        [("lib/x.txt", 5000), ("requirements.txt", 10), ("src/main.py", 10), ("myapp.rb", 10), ("a/main.py", 10), ("Config.yml", 10), ("lib.c", 1001),
         ("lib2.c", 1000), ("unread.c", None), ("package.json", 10)],
        ["src/main.py", "a/main.py", "requirements.txt", "package.json", "myapp.rb", "Config.yml", "lib/x.txt", "lib.c"]),
    "ten known names": (MAINS(10) + WORDY + [("long.c", 2000)], [f"d{i}/main.py" for i in range(10)]),
    "ten with a word": (MAINS(9) + [("long.c", 2000)] + WORDY, [f"d{i}/main.py" for i in range(9)] + ["myapp.rb", "Config.yml"]),
    "nine with a word": (MAINS(8) + [("long.c", 2000)] + WORDY[:1], [f"d{i}/main.py" for i in range(8)] + ["myapp.rb", "long.c"]),
    "more than twenty": (MAINS(25), [f"d{i}/main.py" for i in range(20)]),
    "words alone": ([("long.c", 2000)] + [(f"index{i}.x", 1) for i in range(30)], [f"index{i}.x" for i in range(20)]),
    "long alone": ([(f"l{i}.c", 1001 + i) for i in range(30)], [f"l{i}.c" for i in range(20)]),
    "none": ([("x.c", 1000), ("y.c", None)], []),
}


def test_key_files(spark):
    rows = [(p, i, name, None if n is None else "y" * n) for p, (names, _) in KEY_FILES.items() for i, (name, n) in enumerate(names)]
    files = spark.createDataFrame(rows, "project string, seq int, path string, content string").repartition(7)
    got = {p: [] for p in KEY_FILES}
    for r in project.key_files(files).orderBy("project", "rank").collect():
        got[r.project].append(r.path)
    assert got == {p: want for p, (_, want) in KEY_FILES.items()}


def test_one_project_holding_most_files(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "small").otherwise("hot").alias("project"), F.col("id").alias("seq"),
        F.concat(F.lit("d"), "id", F.lit("/main.py")).alias("path"), F.lit("import a\n").alias("content"))
    assert {r.project: r["count"] for r in project.key_files(rows).groupBy("project").count().collect()} == {"small": 20, "hot": 20}
    assert project.file_list(rows).filter("project = 'hot'").agg(F.count("*"), F.max("total")).first()[:] == (100, 13333)


def test_dependencies(spark):
    contents = {
        "a.py": "import os, sys\nimport numpy.linalg\nfrom flask.views import View\nfrom __future__ import x\n",
        "b.ts": "import A from 'react'\nconst b = require(\"./local\")\nconst c = require('@scope/pkg')\n",
        "package.json": '{"dependencies": {"a": "1", "b": {"v": 2}, "a": "2"}}',  # a repeated key is read
        "requirements.txt": "# c\n pandas==1\n\nreq!=1\nx[extra]~=2\n==\n",
    }
    files = spark.createDataFrame([("p", n, c) for n, c in contents.items()], "project string, path string, content string")
    names = lambda df: sorted(r.dependency for r in df.collect())
    assert names(project.python_dependencies(files)) == ["View", "flask", "numpy", "x"]
    plan = project.dependencies(files.withColumn("seq", F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("Exchange")[1:] if "content" in x.split("[plan_id")[0]]
    assert names(project.javascript_dependencies(files)) == ["@scope/pkg", "react"]
    assert names(project.package_json_dependencies(files)) == ["a", "b"]
    assert names(project.requirements_dependencies(files)) == ["pandas", "req!", "x[extra]"]


# text, name, section and list items, found by hand
SECTIONS = [
    ("Strengths:\n- one\n* two\nSecurity\n- key\n", "strength", "- one\n* two", ["one", "two", "key"]),
    ("Strengths:\n- one\n* two\nSecurity\n- key\n", "security", "- key", ["one", "two", "key"]),
    ("Strengths:\n- one\n* two\nSecurity\n- key\n", "function", "", ["one", "two", "key"]),
    ("strength in one line", "strength", "", []),
    ("The STRENGTH\n\n  12. three  \n\nfunctions 3\n. four", "strength", "12. three", ["three", "four"]),
    ("The STRENGTH\n\n  12. three  \n\nfunctions 3\n. four", "function", ". four", ["three", "four"]),
    # a header inside a word ends a section, and starts one
    ("Strengths\n- rapid\n- two", "strength", "- r", ["rapid", "two"]),
    ("Strengths\n- rapid\n- two", "api", "- two", ["rapid", "two"]),
    # its own name does not end it
    ("strength\n- strength again\nsummary\nfine", "strength", "- strength again", ["strength again"]),
    ("summary\n \u00a0\nfine\n\n1.no\n-\n123. no", "summary", "fine\n\n1.no\n-\n123. no", []),
    ("", "api", "", []),
]


def test_sections_and_items(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _, _) in enumerate(SECTIONS)], "i int, t string")
    names = sorted({n for _, n, _, _ in SECTIONS})
    found = {r.i: r for r in answers.sections(rows, "t", names).withColumn("items", answers.list_items("t")).collect()}
    for i, (text, name, section, items) in enumerate(SECTIONS):
        assert (found[i][f"section_{name}"], found[i]["items"]) == (section, items), text


def test_members_of_another_type_keep_the_others(spark):
    shape = T.DataType.fromDDL("struct<a: int, l: array<string>, o: struct<name: string, n: int>, p: struct<x: int>, q: array<struct<name: string, l: array<string>>>, s: string>")
    cases = {
        '{"a": "7", "l": "one", "o": {"name": "k", "n": 2.9}, "s": "x"}': (7, ["one"], ("k", 2), None, None, "x"),
        '{"a": 85.5, "l": [1, "b", null, {"c": 1}], "o": "plain", "p": "no", "s": 3}': (85, ["1", "b", None, '{"c":1}'], ("plain", None), None, None, "3"),
        '{"a": "x", "l": null, "o": [1], "p": {"x": true}, "q": {"name": "one", "l": "t"}, "s": null}': (None, None, None, (None,), [("one", ["t"])], None),
        '{"q": ["f", {"name": "g", "l": ["u", "v"]}, null, [2]], "p": {"x": "5"}, "a": 99999999999}': (None, None, None, (5,), [("f", None), ("g", ["u", "v"]), None, None], None),
        "{}": (None,) * 6,
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", read_json(F.col("t"), shape).alias("v")).collect()
    assert {r.t: tuple(r.v) for r in rows} == cases


def test_open_prompts_have_no_explanation(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "sql string")
    known = prompts.explain_prompts(spark.createDataFrame([("sql", "a")], "content_type string, text string")).select("prompt_hash", F.lit("x").alias("answer"))
    got = {r.sql: r.explanation for r in prompts.attach_explanations(rows, "sql", "sql", known).collect()}
    assert got == {"a": "x", "b": None}


def test_equal_files_are_asked_once(spark):
    files = spark.createDataFrame(
        [("a/x.py", "v = 1\n"), ("b/x.py", "v = 1\n"), ("b/y.py", "v = 1\n"), ("c/x.py", "v = 2\n"), ("d/x.py", None)] + [(f"e{i}/x.py", "v = 1\n") for i in range(50)],
        "path string, content string").repartition(5)
    found = prompts.file_prompts(files).collect()
    assert len(found) == 3 and all(r.content_type == "python" and "file 'x.py'" in r.prompt or "file 'y.py'" in r.prompt for r in found)
    assert all(hashlib.sha256(r.prompt.encode()).hexdigest() == r.prompt_hash for r in found)
    plan = prompts.file_prompts(files)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_export_has_a_record_for_every_analysed_file(spark):
    raw = F.when(F.col("id") % 2 == 0, '{"summary": "s"}').otherwise("Summary\nfine\n")
    asked = spark.range(2500).select(
        F.lit("p").alias("project"), F.col("id").alias("seq"), F.concat(F.lit("f"), "id").alias("file"), raw.alias("raw"),
        F.lit("python").alias("language"))
    structure = project_lineage.project_structures(
        spark.createDataFrame([("p", '{"project_type": "x"}')], "project string, raw string"),
        asked.select("project", "seq", F.col("file").alias("path"), F.lit("a").alias("content")))
    failed = F.when(F.col("seq") < 100, F.lit("timeout"))
    records = project_lineage.lineage_export(structure, answers.structured(asked).withColumn("error", failed))
    files = records.filter("record = 'file'").select("file", F.get_json_object("document", "$.summary").alias("summary")).collect()
    assert len({r.file for r in files}) == len(files) == 2400 and {r.summary for r in files} == {"s", "fine"}
    headers = records.filter("record = 'header'").collect()
    assert len(headers) == 1 and '"total_files_analyzed":2500' in headers[0].document


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.py").write_bytes(b"x = 1\n")
    (tmp_path / "sub" / "b.py").write_bytes("é = 2\n".encode())
    (tmp_path / "bad.py").write_bytes(b"\xff\xff\xff")
    (tmp_path / "no.txt").write_bytes(b"skip")
    (tmp_path / "wide.py").write_bytes("w = 'ü'\r\n".encode("utf-16"))
    rows = {r.path: r for r in sources.scan_folder(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.py", "sub/b.py", "bad.py", "wide.py"}
    assert rows["sub/b.py"].content == "é = 2\n" and not rows["bad.py"].read_ok
    here = os.getcwd()
    os.chdir(tmp_path)
    try:  # relative and dotted spellings of the folder, and one that occurs twice in the path
        (tmp_path / "a" / "a").mkdir(parents=True)
        (tmp_path / "a" / "a" / "c.py").write_bytes(b"y = 1\n")
        local = lambda folder: {r.path for r in sources.scan_folder(spark, folder).collect()}
        assert local(f"file:{tmp_path}/./a/") == {"a/c.py"} == local(f"file://{tmp_path}/sub/../a")
    finally:
        os.chdir(here)
    raw = spark.read.format("binaryFile").load(str(tmp_path / "*.py")).select(F.substring_index("path", "/", -1).alias("path"), "content")
    text = {r.path: r for r in sources.to_utf8(raw).collect()}
    assert (text["wide.py"].content, text["wide.py"].encoding) == ("w = 'ü'\r\n", "utf-16")
    assert text["bad.py"].content is None and text["a.py"].encoding == "utf-8"
    assert (tmp_path / "wide.py").read_bytes()[:2] == b"\xff\xfe"
    assert sources.read_script(spark, str(tmp_path / "a.py")).first().content == "x = 1\n"
