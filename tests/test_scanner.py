"""Texts scanned line by line against their syntax trees."""

import ast
import random

import pytest

from corpuslens.sources import scanner, syntax
from tests.test_nodes import BOOLEANS, NOT_PLAIN, PLACES, PLAIN, SCRIPTS

LINES = [
    "def f(a, b=[], c='x, y', d=None, e=g.h):", "def f():", "def f(a, b,c):", "def f(a, *b, c=1, **d) -> e:", "async def f(a=[]):", "class A:",
    "class B(A, m=C):", "if a > 1:", "if not a:", "if a is not b:", "if a and b or c:", "if a or b:", "if (a and\n  b):", "elif a:", "elif a and b:", "else:",
    "for i in a:", "for i, j in a.b(c):", "for i in [a or b]:", "while a not in b:", "while a and not b:", "try:", "except:", "except A:", "except A.b as c:",
    "except (A, B):", "finally:", "with a as b:", "with a or b:", "@a.b(c)", "@a or b", "pass", "'doc'", '"doc" # why', '"""doc"""', '"""a\n  b\n"""', "'''c'''",
    "x = 1", "x = a and b", "x.y[0] = a or b or c", "return a and b", "return", "f(a, b or c)", "x = [\n  a,\n  b or c]", "import a.b as c, d", "from . import a",
    "x = 1; y = a or b", "# note", "", "if a: pass", "x = lambda: a or b", "    ", "\tx = 1", "x = (", "def (", "raise A", "x = y = 2", "match a:", "case 1:", "a b",
    "for (i) in a:", "global a", "x: int = a or b", "del a", "x = 'é'", "# é", "assert a, b",
]


def rows(found):
    """Without the numbers of nodes, which only have an order."""
    found = list(found)
    assert [r[1] for r in found] == sorted({r[1] for r in found})
    return [(*r[3:7], len(r[7]), *r[8:]) for r in found]


def scanned_like_its_tree(text: str) -> bool:
    module = scanner.scanned(text)
    if module is None:
        return False
    tree = syntax._parsed(text)
    assert tree is not None, text
    got, parents = list(syntax._scanned_rows("p", module)), {}
    assert rows(got) == rows(syntax._structure_rows("p", tree, syntax._boolean_lines(text))), text
    for r in got:   # parents and enclosing functions are rows before, where they have one
        parents[r[1]] = r[6]
        assert r[2] == -1 or parents.get(r[2], r[3]) == r[3] and all(parents[f] == "FunctionDef" for f in r[7]), text
    return True


def random_text(rng: random.Random) -> str:
    """Lines in mostly right blocks."""
    lines, depth = [], 0
    for _ in range(rng.randint(1, 14)):
        line = rng.choice(LINES)
        if rng.random() < 0.1:
            depth = rng.randint(0, 4)
        lines.append("  " * depth + line)
        if line.endswith(":") and rng.random() < 0.95:
            depth += 1
            lines += ["  " * depth + rng.choice(["pass", "x = 1", "f(a)\n" + "  " * depth + "f(b)", "'doc'"])] * (rng.random() < 0.8)
            depth -= rng.random() < 0.5
        elif depth and rng.random() < 0.3:
            depth -= 1
    return "\n".join(lines) + "\n" * rng.randint(0, 1)


def test_random_blocks_are_those_of_the_tree():
    rng = random.Random(7)
    assert sum(scanned_like_its_tree(random_text(rng)) for _ in range(6000)) > 500


@pytest.mark.parametrize("text", [*BOOLEANS, *SCRIPTS.values(), *(p.format(line) for p in PLACES for line in PLAIN + NOT_PLAIN)])
def test_other_texts_are_those_of_the_tree(text):
    scanned_like_its_tree(text)


SCANNED = """import os, sys as s
from .a import b

class K(A):
    '''Doc.'''
    ok = 1 and 0

    @staticmethod
    def f(self, a, b=[], *, c=None):
        \"\"\"Doc
        of f.\"\"\"
        # note
        for i in a.items():
            if i > 1:
                b = i
            elif i is None:
                return i and a
            else:
                f(i)
        while b:
            b = 0
        try:
            b = g(a)
        except ValueError as e:
            b = 1
            raise
        except:
            pass
        finally:
            b = 2
        return b
"""


def test_plain_scripts_need_no_tree(monkeypatch):
    assert scanned_like_its_tree(SCANNED) and scanned_like_its_tree("") and scanned_like_its_tree("# note\n\n") and scanned_like_its_tree(SCANNED.rstrip())
    want = [b.to_pylist() for b in syntax._structure_batches(iter([("a", SCANNED)]))]
    monkeypatch.setattr(syntax, "_structure", lambda text: pytest.fail("parsed whole"))
    assert [b.to_pylist() for b in syntax._structure_batches(iter([("a", SCANNED)]))] == want and len(want[0]) > 20


@pytest.mark.parametrize("text", [
    "def (\n", "if a:\n", "if a:\nx = 1\n", "x = 1\n  y = 2\n", "try:\n  pass\n", "try:\n  pass\nx = 1\n", "else:\n  pass\n", "if a:\n  pass\nelse:\n  pass\nelse:\n  pass\n",
    "@a\nx = 1\n", "@a\n", "def f(a=1, b):\n  pass\n", "if a:\n    x = 1\n  y = 1\n", "for i in a:\n  pass\nelif b:\n  pass\n", "x = 1\r\ny = 2\n", None, "x = '\x00'\n",
    "try:\n  pass\nfinally:\n  pass\nexcept A:\n  pass\n", "class A:\n  def f(self):\nx = 1\n", "if a:\n  @b\nx = 1\n", "try:\n  pass\nelse:\n  pass\n", "  x = 1\n"])
def test_what_is_no_whole_text_is_not_scanned(text):
    assert scanner.scanned(text) is None


def test_texts_of_many_other_lines_go_to_the_parser_whole(monkeypatch):
    tried, parse = [], scanner._parsed
    monkeypatch.setattr(scanner, "_parsed", lambda text: tried.append(text) or parse(text))
    assert scanner.scanned("x = [a for a in b]\n" * 1000) is None
    assert len(tried) < 30
    assert scanner.scanned("x = a or (b and c)\n") is not None and scanner.scanned("x = (\n" + "  a,\n" * 10_000 + ")\n") is None


def test_columns_that_are_not_read_are_not_made(spark):
    files = spark.createDataFrame([("a.py", SCANNED), ("b.py", "def (\n")], "path string, content string")
    every = syntax.syntax_nodes(files, entities=False)
    some = syntax.syntax_nodes(files, entities=False, kinds=["FunctionDef", "ParseError"], columns=["lineno", "kind", "functions"])
    assert some.columns == ["kind", "functions", "lineno"]
    want = every.filter("kind IN ('FunctionDef', 'ParseError')").select(*some.columns)
    assert sorted(map(str, some.collect())) == sorted(map(str, want.collect())) and some.count() == 2
