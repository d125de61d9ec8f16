"""The scan by tasks against Spark's own reader, and what cannot be read."""

import os

import pytest
from pyspark.errors import AnalysisException

from corpuslens.sources.files import read_script, scan_folder
from corpuslens.sources.listing import listed, listed_scan, read_listed


def tree(root):
    for path, content in {
        "a.py": b"x = 1\n", "b.txt": b"no", "deep/er/and/deeper/c.py": "é = 'ñ'\n".encode(), "deep/d.py": b"\xff\xfe\x00", "empty.py": b"",
        "sp ace/e f.py": b"1", "deep/.hidden/h.py": b"1", "_tmp/t.py": b"1", ".g.py": b"1", "na%41me/p%20.py": b"2", "big/z.py": b"#" * 300_000,
    }.items():
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "wb") as f:
            f.write(content)
    os.makedirs(f"{root}/nothing/in/here")
    for i in range(40):
        os.makedirs(f"{root}/many/{i}")
        open(f"{root}/many/{i}/m.py", "w").close()


def rows(found):
    return sorted((r.path, r.content, r.encoding, r["size"], r.read_ok) for r in found.collect())


def test_equal_to_the_reader_of_spark(spark, tmp_path):
    root = str(tmp_path / "root")
    tree(root)
    got = rows(listed_scan(spark, root, str(tmp_path / "stage"), tasks=5))
    # Spark's reader passes over files of no bytes
    assert [r for r in got if r[3]] == rows(scan_folder(spark, root)) and len(got) == 47
    assert sum(r[3] == 0 for r in got) == 41 and all(r[4] and r[1] == "" for r in got if r[3] == 0)
    assert [r[0] for r in got if not r[4]] == ["deep/d.py"]
    assert rows(listed_scan(spark, f"{root}/deep", str(tmp_path / "stage"), glob="c*")) == rows(scan_folder(spark, f"{root}/deep", "c*"))
    assert listed_scan(spark, f"{root}/nothing", str(tmp_path / "stage")).count() == 0


def test_what_cannot_be_read_is_a_row(spark, tmp_path):
    root = str(tmp_path / "root")
    tree(root)
    files = listed(spark, root, str(tmp_path / "stage"))
    os.remove(f"{root}/a.py")
    os.remove(f"{root}/many/3/m.py")
    got = {r.path: r for r in read_listed(spark, root, files).collect()}
    assert len(got) == 47 and {p for p, r in got.items() if r.error} == {"a.py", "many/3/m.py"}
    assert not got["a.py"].read_ok and got["a.py"].content is None
    gone = listed_scan(spark, str(tmp_path / "gone"), str(tmp_path / "stage")).collect()
    assert len(gone) == 1 and gone[0].error and not gone[0].read_ok
    given = spark.createDataFrame([("big/z.py", None), ("nowhere.py", 5)], "path string, size long")
    assert sorted((r.path, r.read_ok) for r in read_listed(spark, root, given).collect()) == [("big/z.py", True), ("nowhere.py", False)]


def by_spark(spark, path, **options):
    raw = spark.read.format("binaryFile").options(**options).load(path)
    return sorted((r.path.rsplit("/", 1)[-1], bytes(r.content), r.length) for r in raw.collect())


def no_list_on_the_driver(monkeypatch):
    from pyspark.sql.readwriter import DataFrameReader

    load = DataFrameReader.load
    monkeypatch.setattr(DataFrameReader, "load", lambda self, path=None, **more: pytest.fail(f"listed on the driver: {path}") if "*" in str(path) or os.path.isdir(
        str(path)) and "stage" not in str(path) and "corpuslens" not in str(path) else load(self, path, **more))


@pytest.mark.parametrize("pattern", ["*.py", "many/*/*.py", "deep/*", "*/*.py", "many/[13]/m.py", "de?p/*/and/*/c.py", "*", "sp */*", "_tmp/*", "n*/p%20.py"])
def test_patterns_name_what_spark_reads(spark, tmp_path, monkeypatch, pattern):
    root = str(tmp_path / "root")
    tree(root)
    for i in range(0, 40, 3):
        with open(f"{root}/many/{i}/m.py", "w") as f:
            f.write(f"x = {i}\n")
    want = [r for r in by_spark(spark, f"{root}/{pattern}") if r[2]]
    no_list_on_the_driver(monkeypatch)
    found = sorted((r.path, r.content, r["size"]) for r in read_script(spark, f"{root}/{pattern}").collect())
    assert [(r[0], r[2]) for r in found] == [(r[0], r[2]) for r in want]
    assert {r[1] for r in found} - {None} <= {r[1].decode("utf-8", "replace") for r in want}


def test_scans_list_nothing_on_the_driver(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "root")
    tree(root)
    want = by_spark(spark, root, recursiveFileLookup="true", pathGlobFilter="*.py")
    no_list_on_the_driver(monkeypatch)
    got = scan_folder(spark, root).collect()
    assert sorted((r.path.rsplit("/", 1)[-1], r["size"]) for r in got) == [(r[0], r[2]) for r in want if r[2]] and len(got) == 6


def test_what_is_not_there_or_not_known_is_left_to_spark(spark, tmp_path):
    root = str(tmp_path / "root")
    tree(root)
    for read in (lambda: scan_folder(spark, f"{root}/gone"), lambda: read_script(spark, f"{root}/gone*/*.py"), lambda: read_script(spark, f"{root}/gone.py")):
        with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
            read()
    os.makedirs(f"{root}/parts/all/key=1")
    with open(f"{root}/parts/all/key=1/k.py", "w") as f:
        f.write("k = 1\n")
    assert [r.path for r in read_script(spark, f"{root}/parts/*").collect()] == ["k.py"]
    assert read_script(spark, f"{root}/{{a,big/z}}.py").count() == 2
    assert {r.path for r in scan_folder(spark, root, "{a,z}.py").collect()} == {"a.py", "big/z.py"}
    os.remove(f"{root}/a.py")
    os.symlink(f"{root}/nowhere", f"{root}/a.py")
    assert "a.py" not in {r.path for r in listed_scan(spark, root, str(tmp_path / "stage")).filter("read_ok").collect()}
