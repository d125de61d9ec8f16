"""Text and path expressions against Python's own functions."""

import os

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import text as tx

AWKWARD = ["", "a", "\n", "a\n", "a\n\n", " \t\n x", "a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i\u2028j\u2029k", "a\r\n", "\u3000#x\n\xa0\n",
           "\x1f# y\n#\n  # z", "x\u2028", "\ttab\t", "\u2003\n#a\n b"]
PATHS = ["a.py", "/x/y.tar.gz", ".bashrc", "x/.env", "..a.b", "a.", "a/b.c/d", "noext", "A.TSX", "x/..", "dir.d/.x.y", "a b.py", "...", "/"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(AWKWARD)], "id int, t string")


def test_lines_and_strip(texts):
    rows = texts.select("t", tx.split_lines(F.col("t")).alias("l"), tx.strip(F.col("t")).alias("s"),
                        F.expr(tx.strip_sql("t")).alias("q"), tx.without_indent(F.col("t")).alias("w"),
                        tx.is_blank(F.col("t")).alias("b")).collect()
    for r in rows:
        assert r.s == r.q == r.t.strip() and r.w == r.t.lstrip() and r.b == (not r.t.strip())
        if r.t:
            assert r.l == r.t.splitlines(), ascii(r.t)


def test_line_counts(texts):
    from corpuslens.operators.metrics import line_counts

    for r in line_counts(texts, "id", "t").collect():
        lines = AWKWARD[r.id].splitlines()
        blank = sum(not l.strip() for l in lines)
        comment = sum(l.strip().startswith("#") for l in lines)
        assert (r.lines_total, r.lines_blank, r.lines_comment) == (len(lines), blank, comment), ascii(AWKWARD[r.id])


def test_paths(spark):
    rows = spark.createDataFrame([(p,) for p in PATHS], "p string").select(
        "p", tx.extension(F.col("p")).alias("e"), tx.basename(F.col("p")).alias("b")).collect()
    for r in rows:
        assert r.e == os.path.splitext(r.p)[1] and r.b == os.path.basename(r.p), r.p


def test_fill(spark):
    got = spark.range(1).select(tx.fill("a{x}b{y}{x}", x=F.lit("1{y}"), y=F.lit("2"))).first()[0]
    assert got == "a1{y}b21{y}"
