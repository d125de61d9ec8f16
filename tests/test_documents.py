"""Documents written in pieces: valid JSON, whole, in order, a hot one by several tasks."""

import json
import re
from collections import defaultdict

from pyspark.sql import functions as F

from corpuslens.plans import documents, project_queries as pq

SF = "/root/testdata/sf0.001"
KEYS = ["project", "code_lineage", "technical_stack", "dependencies", "data_flow", "components", "legacy_aspects",
        "modernization_opportunities", "file_analyses", "metadata"]
ENTRY = ["file_path", "language", "summary", "functions", "classes", "data_transformations", "external_communications"]


def assembled(spark, folder):
    """Project -> the contents of its files in the order of the manifest."""
    out = defaultdict(str)
    for r in sorted(documents.parts(spark, folder).collect(), key=lambda r: (r.project, r.part)):
        assert r.first_byte == len(out[r.project].encode())
        out[r.project] += spark.read.text(r.path, wholetext=True).first().value
    return out


def test_documents_of_projects_have_the_nested_shape(spark, tmp_path):
    structures, analyses = pq.written_structures(spark, SF), pq._analyses(spark, SF).withColumn(
        "error", F.when(F.col("seq") % 11 == 3, "timeout"))
    pieces = documents.lineage_pieces(structures, analyses)
    documents.write_documents(spark, pieces, str(tmp_path / "d"), str(tmp_path / "s"), lines_per_file=7)
    docs = {p: json.loads(t) for p, t in assembled(spark, str(tmp_path / "d")).items()}
    want = defaultdict(list)
    for r in sorted(analyses.select("project", "seq", "file", "error").collect(), key=lambda r: r.seq):
        want[r.project].append((r.file, r.error))
    flows = {r.project: r.data_flow for r in structures.select("project", "data_flow").collect()}
    assert set(docs) == set(flows)
    for project, doc in docs.items():
        assert list(doc) == KEYS and doc["metadata"]["total_files_analyzed"] == len(want[project])
        assert [e["file_path"] for e in doc["file_analyses"]] == [f for f, error in want[project] if error is None]
        assert all(list(e) == ENTRY and isinstance(e["external_communications"], dict) for e in doc["file_analyses"])
        # elements that are objects stay objects
        for name in ("sources", "transformations", "sinks"):
            given = [json.loads(x) if x.startswith("{") else x for x in (flows[project][name] or [])]
            assert doc["data_flow"][name] == given
        assert re.fullmatch(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", doc["metadata"]["generated_at"])


def pieces_of(spark, sizes):
    head = [(p, documents.HEAD, None, None, '{"n":[') for p in sizes]
    tail = [(p, documents.TAIL, None, None, "]}") for p in sizes]
    body = [(p, documents.ENTRY, i, f"f{i}", ("," if i else "") + json.dumps(f"{i} é\n")) for p, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(head + body + tail, "project string, section int, seq long, file string, text string").repartition(6)


def test_a_hot_document_is_written_by_several_tasks(spark, tmp_path):
    sizes = {"hot": 6000, "a b/c+d%41": 3, "empty": 0, "é": 700, "": 2}
    pieces = pieces_of(spark, sizes)
    # small ranges would be put together
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        documents.write_documents(spark, pieces, str(tmp_path / "d"), str(tmp_path / "s"), lines_per_file=500)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    docs = {p: json.loads(t)["n"] for p, t in assembled(spark, str(tmp_path / "d")).items()}
    assert docs == {p or documents.NO_PROJECT: [f"{i} é\n" for i in range(n)] for p, n in sizes.items()}
    paths = [r.path for r in documents.parts(spark, str(tmp_path / "d")).filter("project = 'hot'").collect()]
    tasks = {re.search(r"/part-(\d+)", p)[1] for p in paths}
    assert len(tasks) >= 4 and len(paths) >= 12
    lines = {(r.project, r.line): r.text for r in documents.lines(spark, str(tmp_path / "d")).collect()}
    assert len(lines) == sum(n + 2 for n in sizes.values()) and json.loads(lines["hot", 6000].lstrip(",")) == "5999 é\n"


def test_values_as_json(spark):
    rows = spark.createDataFrame([(["a\"b", '{"x": 1}', "{not json", " {\"y\":[]}", ""], "q\"\\", None)], "e array<string>, s string, n string")
    got = rows.select(documents.json_elements(F.col("e")).alias("e"), documents.json_object(
        {"s": documents.json_text(F.col("s")), "n": documents.json_text(F.col("n"))}).alias("o")).first()
    assert json.loads(got.e) == ['a"b', {"x": 1}, "{not json", {"y": []}, ""] and json.loads(got.o) == {"s": 'q"\\', "n": None}


def test_written_documents_are_listed_and_read_by_tasks(spark, tmp_path):
    """There is a folder for each project: none of their paths goes through the driver's file index."""
    shape = "project string, section int, seq long, file string, text string"
    names = [f"p{i}" for i in range(30)] + ["a b/c+d%41=e"]
    pieces = spark.createDataFrame([(p, s, i, f"f{i}", f"{p}-{s}-{i}") for p in names for s in (0, 1, 2) for i in range(3)], shape)
    folder = str(tmp_path / "documents")
    documents.write_documents(spark, pieces, folder, str(tmp_path / "stage"), lines_per_file=4)
    lines, parts = documents.lines(spark, folder), documents.parts(spark, folder)
    for rows in (lines, parts):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"\] (text|binaryFile)\b", plan)
    got = {}
    for r in sorted(map(tuple, lines.collect())):
        got.setdefault(r[0], []).append(r[2])
    assert got == {p: [f"{p}-{s}-{i}" for s in (0, 1, 2) for i in range(3)] for p in names}
    sizes = {r.project: r.bytes for r in parts.groupBy("project").agg({"bytes": "sum"}).toDF("project", "bytes").collect()}
    assert sizes == {p: sum(len(t) + 1 for t in ts) for p, ts in got.items()}
