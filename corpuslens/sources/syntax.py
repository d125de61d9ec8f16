"""Syntax-node table: one row per kept node of every Python file.

The only Python stage of the engine.  It is map-only (Arrow batches in, Arrow
batches out): partitioning is whatever the input has, nothing is collected, and
the output of a large file leaves in pieces.  Every analysis after it is a
DataFrame job on the node rows.

Columns
    bfs         number of the node, increasing in breadth-first order
    parent      number of the parent; argument lists count as part of the function
    parent_kind kind of that parent
    field, pos  place in the parent
    functions   numbers of the enclosing functions, outermost first
    name        defined, assigned or imported name; called attribute
    owner       text before the called attribute; module of a from-import
    targets     plain names assigned by this value, on the value of an assignment
    args        source text of the positional arguments, on calls an operator reports
    callee      full text of the called expression
    str_value   string literal (of a call: its first argument); docstring of a definition
    src         source text where an operator reports it
"""

from __future__ import annotations

import ast
import gc
import re
import sys
import threading
import warnings
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain, islice

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from corpuslens import fixed_values as fv
from corpuslens.sources.scanner import STATEMENT, scanned

# executors need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("bfs", T.IntegerType()),
    T.StructField("parent", T.IntegerType()),
    T.StructField("parent_kind", T.StringType()),
    T.StructField("field", T.StringType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("functions", T.ArrayType(T.IntegerType())),
    T.StructField("name", T.StringType()),
    T.StructField("owner", T.StringType()),
    T.StructField("targets", T.ArrayType(T.StringType())),
    T.StructField("args", T.ArrayType(T.StringType())),
    T.StructField("callee", T.StringType()),
    T.StructField("str_value", T.StringType()),
    T.StructField("lineno", T.IntegerType()),
    T.StructField("end_lineno", T.IntegerType()),
    T.StructField("src", T.StringType()),
    T.StructField("parse_ok", T.BooleanType()),
])

_ARROW = pa.schema([
    ("path", pa.string()), ("bfs", pa.int32()), ("parent", pa.int32()), ("parent_kind", pa.string()), ("field", pa.string()),
    ("pos", pa.int32()), ("kind", pa.string()), ("functions", pa.list_(pa.int32())),
    ("name", pa.string()), ("owner", pa.string()),
    ("targets", pa.list_(pa.string())), ("args", pa.list_(pa.string())), ("callee", pa.string()),
    ("str_value", pa.string()), ("lineno", pa.int32()), ("end_lineno", pa.int32()),
    ("src", pa.string()), ("parse_ok", pa.bool_()),
])

_DEFINITIONS = (ast.FunctionDef, ast.ClassDef)
_STRUCTURE = frozenset((
    ast.FunctionDef, ast.ClassDef, ast.If, ast.For, ast.While, ast.Try, ast.BoolOp, ast.ExceptHandler, ast.alias,
    ast.Module,  # one row per file, so that files without definitions stay visible
))
# contexts and operators are shared singletons that nothing reports
_SKIPPED_FIELDS = frozenset(("ctx", "op", "ops", "type_ignores", "type_comment", "attr", "asname", "module", "level"))
_fields: dict[type, tuple[str, ...]] = {}   # of each kind, those that can hold nodes
_LEAVES = frozenset((ast.Name, ast.Constant, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal))
_MOTHERS = frozenset((ast.ExceptHandler, ast.arguments))
# statements that hold no other one, and of those that do, the fields where
_SIMPLE = frozenset((
    ast.Assign, ast.Expr, ast.AugAssign, ast.AnnAssign, ast.Return, ast.Delete, ast.Raise, ast.Assert, ast.TypeAlias,
    ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal,
))
_BLOCKS = {
    ast.Module: ("body",), ast.FunctionDef: ("body",), ast.AsyncFunctionDef: ("body",), ast.ClassDef: ("body",),
    ast.If: ("body", "orelse"), ast.For: ("body", "orelse"), ast.AsyncFor: ("body", "orelse"), ast.While: ("body", "orelse"),
    ast.With: ("body",), ast.AsyncWith: ("body",), ast.Try: ("body", "handlers", "orelse", "finalbody"),
    ast.TryStar: ("body", "handlers", "orelse", "finalbody"), ast.ExceptHandler: ("body",),
}
_NUMBER_ENDS = frozenset("0123456789.")
# nodes that hold no kept one but boolean operators
_BOOLEANS_ONLY = _SIMPLE | {ast.arg} | {kind for kind in vars(ast).values() if isinstance(kind, type) and issubclass(kind, ast.expr)}
_HEADED = frozenset(_BLOCKS) - {ast.Module, ast.Try, ast.TryStar}   # with expressions before the body
# lines that are surely one whole simple statement, of which metrics and issue rules read nothing: assignments, calls and
# returns of names, numbers and plain strings.  Runs of them have one indentation
_PLAIN_RUN = re.compile(rf"^(?=([ \t]*+))(?:\1{STATEMENT} *+(?:#[ -~]*+)?+\n)++", re.M | re.A)
_LONG_TEXT = re.compile(r'"""[^"\\]*(?:(?:\\.|"(?!""))[^"\\]*)*"""|\'\'\'[^\'\\]*(?:(?:\\.|\'(?!\'\'))[^\'\\]*)*\'\'\'', re.S)
_GOES_ON = frozenset("([{,\\")   # at the end of a line
_MOST_ELIF = 100   # each nests the next deeper, as nothing else can without indentation
_BODIES = _BLOCKS | {ast.Match: ("cases",), ast.match_case: ("body",)}
_FLUSH_ROWS, _FLUSH_CHARS = 20_000, 1 << 26
_DEEP_STACK, _DEEP_CALLS = 512 << 20, 1_000_000


def syntax_nodes(files: DataFrame, entities: bool = True, kinds: Iterable[str] | None = None, columns: Iterable[str] | None = None) -> DataFrame:
    """files(path, content) -> node rows; a file that does not parse gives one row.

    With `entities=False` only what metrics and issue rules read is emitted and no source text is rendered;
    of these rows `kinds` names those that are read, if not all are, and only `columns` are made.
    """
    wanted_call = (
        tuple(fv.SQL_CALL_METHODS), tuple(fv.DATAFRAME_METHODS), tuple(fv.RULE_CALL_WORDS)
    )
    names = SCHEMA.names if columns is None or entities else [n for n in SCHEMA.names if n in set(columns)]
    return files.select("path", "content").mapInArrow(
        _emitter(entities, wanted_call, None if kinds is None else frozenset(kinds), names), T.StructType([SCHEMA[n] for n in names]))


def write_nodes(
    spark: SparkSession, files: DataFrame, table: str, buckets: int | None = None, entities: bool = True, path: str | None = None,
) -> DataFrame:
    """Parse files(path, content) once into `table`, bucketed by path, and return it.

    The files are dealt out by path first, so that as many tasks parse as there
    are buckets (by default the number of shuffle partitions), whatever the
    compressed size of the input.  Analyses of the table that group or window by
    path need no exchange.  `path` places the table's files.
    """
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = syntax_nodes(files.select("path", "content").repartition(buckets, "path"), entities)
    writer = nodes.write.mode("overwrite").format("parquet").bucketBy(buckets, "path")
    (writer if path is None else writer.option("path", path)).saveAsTable(table)
    return spark.table(table)


def _emitter(entities: bool, call_words: tuple, kinds: frozenset[str] | None, columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        warnings.simplefilter("ignore")
        # trees hold no cycles: reference counts free them, and scans for cycles cost a third of the time
        gc.disable()
        try:
            files = (file for batch in batches for file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            yield from _entity_batches(files, *call_words) if entities else _structure_batches(files, kinds, columns)
        finally:
            gc.enable()

    return emit


def _entity_batches(files: Iterator[tuple], sql_methods, frame_methods, rule_words) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    chars = 0
    for path, content in files:
        for row in file_rows(path, content, sql_methods, frame_methods, rule_words):
            rows.append(row)
            chars += _row_chars(row)
            if len(rows) >= _FLUSH_ROWS or chars >= _FLUSH_CHARS:
                yield _to_batch(rows)
                rows, chars = [], 0
    if rows:
        yield _to_batch(rows)


def _structure_batches(files: Iterator[tuple], kinds: frozenset[str] | None = None, columns: list[str] = SCHEMA.names) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    chars = 0
    for path, content in files:
        module = scanned(content)
        tree = _structure(content) if module is None else None
        if module is not None:
            found = _scanned_rows(path, module, kinds)
        elif tree is None:
            found = iter([(path, *_BROKEN)] if kinds is None or "ParseError" in kinds else [])
        else:
            found = _structure_rows(path, tree, _boolean_lines(content), kinds)
        while some := list(islice(found, _FLUSH_ROWS - len(rows))):
            rows += some
            # the docstrings of a text are no longer than it
            chars += len(some) * len(path or "") + sum(len(row[10]) for row in some if row[10] is not None)
            if len(rows) >= _FLUSH_ROWS or chars >= _FLUSH_CHARS:
                yield _structure_batch(rows, columns)
                rows, chars = [], 0
    if rows:
        yield _structure_batch(rows, columns)


def _to_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


# what a structure row holds; the other columns are null
_STRUCTURE_COLUMNS = (
    "path", "bfs", "parent", "parent_kind", "field", "pos", "kind", "functions", "name", "owner", "str_value", "lineno", "end_lineno", "parse_ok")
_BROKEN = (0, -1, None, "", -1, "ParseError", (), None, None, None, 1, 1, False)   # of a file that does not parse, after its path


def _structure_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    found, shape = dict(zip(_STRUCTURE_COLUMNS, zip(*rows))), pa.schema([_ARROW.field(n) for n in names])
    return pa.RecordBatch.from_arrays(
        [_numbers(found[f.name]) if f.name == "functions" else pa.array(found[f.name], type=f.type) if f.name in found else pa.nulls(len(rows), f.type)
         for f in shape], schema=shape)


def _numbers(lists: tuple[tuple[int, ...], ...]) -> pa.ListArray:
    offsets = list(accumulate(map(len, lists), initial=0))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(list(chain.from_iterable(lists)), pa.int32()))


def _row_chars(row: tuple) -> int:
    """Characters of the texts that a row holds."""
    path, args, callee, text, src = row[0], row[11], row[12], row[13], row[16]
    return len(path or "") + len(callee or "") + len(text or "") + len(src or "") + sum(map(len, args or ()))


def _parsed(content: str | None) -> ast.Module | None:
    """The tree of a text, None for what Python itself cannot parse; a lack of memory fails the task."""
    try:
        return ast.parse(content)
    except (SyntaxError, ValueError, TypeError, RecursionError):
        return None
    except MemoryError as error:
        if "too complex" not in str(error):  # the parser's own limit says so; anything else is the worker's memory
            raise
        return None


def _structure(content: str | None) -> ast.Module | None:
    """The tree of a text, in which plain statements outside of handlers are `pass`.

    A plain statement needs no parser, if it begins where a statement may begin.  `pass` stands nowhere else: if the
    text parses with it in the place of a run's first line, and it comes back as a statement of that line, then that line
    was one, and so is every line of the run, as each follows a whole one.  Else Python parses the whole text.
    """
    if content and "\r" not in content and content.count("elif") <= _MOST_ELIF:
        # whether a run stands in a text or bracket is guessed: a wrong guess is noticed below
        texts = [text.span() for text in _LONG_TEXT.finditer(content)]
        pieces, runs, line, at, text = [], {}, 1, 0, 0
        for run in _PLAIN_RUN.finditer(content):
            start, end = run.span()
            while text < len(texts) and texts[text][1] <= start:
                text += 1
            if (text < len(texts) and texts[text][0] < start) or content[max(start - 2, 0)] in _GOES_ON:
                continue
            line += content.count("\n", at, start)
            lines, mark = content.count("\n", start, end), f"{run[1]}pass\n"
            runs[line] = lines, run
            # the last line stays too, as blocks end there
            pieces += content[at:start], mark if lines == 1 else mark + "\n" * (lines - 2) + mark
            line, at = line + lines, end
        if runs:
            tree = _parsed("".join(pieces) + content[at:])
            if tree is not None and _restored(tree, runs):
                return tree
    return _parsed(content)


def _restored(tree: ast.Module, runs: dict[int, tuple[int, re.Match]]) -> bool:
    """Whether a `pass` begins on the first line of each run; blocks get as many statements as they had.

    What a handler holds is reported, so there the statements themselves are parsed.
    """
    found, blocks = 0, [tree]
    for block in blocks:   # grows while it is read
        kind = type(block)
        for name in _BODIES[kind]:
            body, held = getattr(block, name), []
            for i, node in enumerate(body):
                if type(node) is ast.Pass:
                    if node.lineno in runs:
                        held.append(i)
                elif type(node) in _BODIES:
                    blocks.append(node)
            found += len(held)
            for i in reversed(held):
                first = body[i].lineno
                lines, run = runs[first]
                if kind is ast.ExceptHandler:
                    own = ast.parse(run[0].replace("\n" + run[1], "\n")[len(run[1]):])
                    body[i:i + min(lines, 2)] = ast.increment_lineno(own, first - 1).body
                elif lines > 2:
                    body[i:i] = [body[i]] * (lines - 2)
    return found == len(runs)


def file_rows(path, content, sql_methods, frame_methods, rule_words) -> Iterator[tuple]:
    """Rows of a file; a text that cannot be rendered is null."""
    tree = _parsed(content)
    if tree is None:
        yield path, 0, -1, None, "", -1, "ParseError", [], None, None, None, None, None, None, 1, 1, None, False
    else:
        yield from _tree_rows(path, tree, sql_methods, frame_methods, rule_words)


# operators that group from the left, with how strongly they bind
_BINARY = {
    ast.BitOr: ("|", 1), ast.BitXor: ("^", 2), ast.BitAnd: ("&", 3), ast.LShift: ("<<", 4), ast.RShift: (">>", 4),
    ast.Add: ("+", 5), ast.Sub: ("-", 5), ast.Mult: ("*", 6), ast.MatMult: ("@", 6), ast.Div: ("/", 6), ast.Mod: ("%", 6),
    ast.FloorDiv: ("//", 6),
}
_COMPARED = {
    ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Is: "is", ast.IsNot: "is not",
    ast.In: "in", ast.NotIn: "not in",
}
_TIGHT = frozenset((ast.Name, ast.Attribute, ast.Call, ast.Subscript))   # never in brackets


def _operand(node: ast.AST) -> str | None:
    return _plain(node) if type(node) in _TIGHT or type(node) is ast.Constant else None


def _plain(node: ast.AST) -> str | None:
    """What `ast.unparse` writes, for the commonest nodes, without its visitor; None for all others.

    A sum of any length is read along its left side, so it needs no stack.
    """
    kind = type(node)
    if kind is ast.Name:
        return node.id
    if kind is ast.Constant:
        plain = node.kind is None and (node.value is None or type(node.value) in (str, int, bool))
        return repr(node.value) if plain else None
    if kind is ast.Attribute:
        base = node.value
        text = _plain(base) if type(base) in _TIGHT or (type(base) is ast.Constant and type(base.value) is str) else None
        return None if text is None else f"{text}.{node.attr}"
    if kind is ast.Call:
        if type(node.func) not in _TIGHT:
            return None
        parts = [_plain(a) for a in node.args]
        for word in node.keywords:
            text = _plain(word.value)
            parts.append(text if text is None else f"{word.arg}={text}" if word.arg else f"**{text}")
        func = _plain(node.func)
        return None if func is None or None in parts else f"{func}({', '.join(parts)})"
    if kind is ast.Subscript:
        if type(node.value) not in _TIGHT:
            return None
        base, index = _plain(node.value), _plain(node.slice)
        return None if base is None or index is None else f"{base}[{index}]"
    if kind is ast.Compare:
        parts = [_operand(node.left)]
        for op, right in zip(node.ops, node.comparators):
            parts += _COMPARED[type(op)], _operand(right)
        return None if None in parts else " ".join(parts)
    if kind is ast.BinOp:
        parts, loosest = [], 0
        while type(node) is ast.BinOp:
            sign, binds = _BINARY.get(type(node.op), (None, 0))
            right = _operand(node.right)
            if sign is None or binds < loosest or right is None:
                return None
            parts += right, sign
            node, loosest = node.left, binds
        parts.append(_operand(node))
        return None if parts[-1] is None else " ".join(reversed(parts))
    if kind is ast.Expr:
        return _plain(node.value)
    if kind is ast.Assign and all(type(t) is ast.Name for t in node.targets) and not node.type_comment:
        value = _plain(node.value)
        return None if value is None else " = ".join([*(t.id for t in node.targets), value])
    return None


def _source(node: ast.AST) -> str | None:
    """Source text of a node; a deep expression is rendered on a stack of its own size."""
    try:
        text = _plain(node)
        return ast.unparse(node) if text is None else text
    except RecursionError:
        return _deep_source(node)


def _deep_source(node: ast.AST) -> str | None:
    found: list[str] = []

    def render() -> None:
        try:
            found.append(ast.unparse(node))
        except RecursionError:  # deeper than any limit: the row stays, without its text
            pass

    calls, stack = sys.getrecursionlimit(), threading.stack_size(_DEEP_STACK)
    sys.setrecursionlimit(_DEEP_CALLS)
    try:
        thread = threading.Thread(target=render)
        thread.start()
        thread.join()
    finally:
        sys.setrecursionlimit(calls)
        threading.stack_size(stack)
    return found[0] if found else None


def _child_fields(kind: type) -> tuple[str, ...]:
    _fields[kind] = tuple(f for f in kind._fields if f not in _SKIPPED_FIELDS)
    return _fields[kind]


def _tree_rows(path, tree, sql_methods, frame_methods, rule_words) -> Iterator[tuple]:
    """Walk breadth-first and yield the rows of kept nodes.

    Leaves are visited only below parents whose direct children can be kept.
    """
    kept, mothers = _STRUCTURE | {ast.Call}, _MOTHERS | {ast.If, ast.Assign}
    leaves, tree_node = _LEAVES, ast.AST
    # number, node, entry of the parent, field, pos, enclosing functions, whether the parent is a mother
    queue = [(0, tree, None, "", -1, (), False)]
    append, number = queue.append, 0
    for entry in queue:   # grows while it is read
        at, node, mother, field, pos, inside, below = entry
        kind = type(node)
        if below or kind in kept:
            in_arguments = mother is not None and type(mother[1]) is ast.arguments
            if in_arguments:
                mother = mother[2]
            parent = mother[1] if mother else None
            row = _node_row(node, parent, field, in_arguments, sql_methods, frame_methods, rule_words)
            if row is not None:
                yield (path, at, mother[0] if mother else -1, type(parent).__name__ if mother else None, field, pos, kind.__name__,
                       inside, *row[:6], getattr(node, "lineno", None), getattr(node, "end_lineno", None), row[6], True)
        if kind in leaves:
            continue
        if kind is ast.FunctionDef:
            inside = inside + (at,)
        leaves_too = kind in mothers
        for name in _fields.get(kind) or _child_fields(kind):
            value = getattr(node, name, None)
            if not value:
                continue
            if type(value) is list:
                i = 0
                for item in value:
                    if (leaves_too or type(item) not in leaves) and isinstance(item, tree_node):
                        number += 1
                        append((number, item, entry, name, i, inside, leaves_too))
                    i += 1
            elif (leaves_too or type(value) not in leaves) and isinstance(value, tree_node):
                number += 1
                append((number, value, entry, name, 0, inside, leaves_too))


def _node_row(node, parent, field, in_arguments, sql_methods, frame_methods, rule_words) -> tuple | None:
    """(name, owner, targets, args, callee, str_value, src) of a node, None when it is not kept."""
    name = owner = targets = args = callee = text = src = None
    keep = type(node) in _STRUCTURE
    if in_arguments:
        keep = isinstance(parent, ast.FunctionDef) and field in ("args", "defaults")
    elif field == "body" and isinstance(parent, ast.ExceptHandler):
        keep = True
    if isinstance(node, _DEFINITIONS):
        name = node.name
        first = node.body[0] if node.body else None
        text = _literal(first.value) if isinstance(first, ast.Expr) else None
    elif isinstance(node, ast.alias):
        name = node.name
        owner = (parent.module or "") if isinstance(parent, ast.ImportFrom) else None
    elif isinstance(node, ast.arg):
        name = node.arg

    assigned = field == "value" and isinstance(parent, ast.Assign)
    if assigned:
        keep, src, text = True, _source(node), _literal(node)
        targets = [t.id for t in parent.targets if isinstance(t, ast.Name)]
    if isinstance(node, ast.If):
        src = _source(node.test)
    elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
        name = node.func.attr
        ruled = any(w in name.lower() for w in rule_words)
        queried = name in sql_methods and field == "value" and isinstance(parent, ast.Expr)
        reads = assigned and name.startswith("read_")
        if ruled:
            callee, src = _source(node.func), src or _source(node)
        if reads or (assigned and name in frame_methods):
            owner = _source(node.func.value)
        if ruled or queried or reads:
            keep, args = True, [_source(a) for a in node.args]
            text = _literal(node.args[0]) if node.args else None
    if field == "body" and isinstance(parent, ast.If) and not isinstance(node, ast.If):
        keep, src = True, _source(node)
    return (name, owner, targets, args, callee, text, src) if keep else None


def _boolean_lines(content: str) -> list[int] | None:
    """Numbers of the lines where `and` or `or` may stand; None if the text is such that they may on all.

    A letter before them makes them part of a name, but for the `j` of a number: `1jor x` is allowed.
    """
    if "\r" in content or "0x" in content or "0X" in content:
        return None
    places = []
    for word in ("and", "or"):
        at = content.find(word)
        while at >= 0:
            end = at + len(word)
            before, after = content[max(at - 1, 0):at], content[end:end + 1]
            apart = not (before.isascii() and before.isalpha() or before == "_") or (before in "jJ" and content[max(at - 2, 0):at - 1] in _NUMBER_ENDS)
            if apart and not (after.isalnum() or after == "_"):
                places.append(at)
            at = content.find(word, end)
    places.sort()
    lines, line, at = [], 1, 0
    for place in places:
        line, at = line + content.count("\n", at, place), place
        lines.append(line)
    return lines


def _structure_rows(path, tree: ast.Module, boolean: list[int] | None, kinds: frozenset[str] | None = None) -> Iterator[tuple]:
    """Walk breadth-first and yield the rows that metrics and issue rules read.

    Of expressions only boolean operators are kept, so one that covers no line of `boolean`,
    the sorted lines that may hold some (None: all may), is not visited.  With `kinds` only their rows are made.
    """
    def may_hold(first: int, last: int) -> bool:
        if not boolean:
            return boolean is None
        at = bisect_left(boolean, first)
        return at < len(boolean) and boolean[at] <= last

    none = boolean is not None and not boolean   # spares asking for each node
    kept, leaves, simple, headed, mothers, expressions, tree_node = _STRUCTURE, _LEAVES, _SIMPLE, _HEADED, _MOTHERS, _BOOLEANS_ONLY, ast.AST
    function, klass, module, argument, arguments, handler = ast.FunctionDef, ast.ClassDef, ast.Module, ast.arg, ast.arguments, ast.ExceptHandler
    # number, node, entry of the parent, field, pos, enclosing functions
    queue = [(0, tree, None, "", -1, ())]
    append, number = queue.append, 0
    for entry in queue:   # grows while it is read
        at, node, mother, field, pos, inside = entry
        kind, parent = type(node), mother[1] if mother else None
        parent_kind = type(parent)
        if parent_kind is arguments:
            mother = mother[2]
            parent = mother[1]
            parent_kind = type(parent)
            keep = parent_kind is function and field in ("args", "defaults")
        else:
            keep = kind in kept or (parent_kind is handler and field == "body")
        if keep and (kinds is None or kind.__name__ in kinds):
            name = owner = text = None
            if kind is function or kind is klass:
                name, first = node.name, node.body[0]
                text = _literal(first.value) if type(first) is ast.Expr else None
            elif kind is argument:
                name = node.arg
            elif kind is ast.alias:
                name, owner = node.name, (parent.module or "") if parent_kind is ast.ImportFrom else None
            if kind is module:
                yield path, at, -1, None, field, pos, "Module", inside, None, None, None, None, None, True
            else:
                yield (path, at, mother[0], parent_kind.__name__, field, pos, kind.__name__,
                       inside, name, owner, text, node.lineno, node.end_lineno, True)
        if kind in leaves or (kind in expressions and (none or not may_hold(node.lineno, node.end_lineno))):
            continue
        if kind is function:
            inside = inside + (at,)
        blocks, fields = _BLOCKS.get(kind), ()
        if blocks is None:
            fields = _fields.get(kind) or _child_fields(kind)
            if kind is arguments and type(parent) is function and (none or not may_hold(_first_line(parent), parent.body[0].lineno)):
                fields = ("args", "defaults")
        elif not none and kind in headed and may_hold(_first_line(node), node.body[0].lineno):
            fields, blocks = _fields.get(kind) or _child_fields(kind), None
        elif kind is function:
            fields = ("args",)
        leaves_too = kind in mothers
        for name in fields:
            value = getattr(node, name, None)
            if type(value) is list:
                i = 0
                for item in value:
                    if (leaves_too or type(item) not in leaves) and isinstance(item, tree_node):
                        number += 1
                        append((number, item, entry, name, i, inside))
                    i += 1
            elif (leaves_too or type(value) not in leaves) and isinstance(value, tree_node):
                number += 1
                append((number, value, entry, name, 0, inside))
        for name in blocks or ():
            value = getattr(node, name)
            if not value:
                continue
            some, i = not none and may_hold(value[0].lineno, value[-1].end_lineno), 0
            for item in value:
                if type(item) not in simple or leaves_too or (some and may_hold(item.lineno, item.end_lineno)):
                    number += 1
                    append((number, item, entry, name, i, inside))
                i += 1


def _scanned_rows(path, module: list, kinds: frozenset[str] | None = None) -> Iterator[tuple]:
    """The rows of `_structure_rows` from the records of a scanned text, in the same order."""
    kept, leaves, tree_node, some = _STRUCTURE, _LEAVES, ast.AST, kinds is not None
    # number, record, its arguments, or piece of a tree; number and kind of the parent, enclosing functions
    queue = [(0, module, -1, None, ())]
    append, number = queue.append, 0
    for at, entry, mother, mother_kind, inside in queue:   # grows while it is read
        if type(entry) is list:
            kind, field, pos, name, text, first, last, below, arguments, keep, *_ = entry
            if keep and (not some or kind in kinds):
                yield path, at, mother, mother_kind, field, pos, kind, inside, name, None, text, first, last, True
            if kind == "FunctionDef":
                inside = inside + (at,)
                if arguments:
                    number += 1
                    append((number, arguments, at, kind, inside))
            for child in below:
                number += 1
                if not some or type(child) is tuple or child[7] or child[8] or child[0] in kinds:
                    append((number, child, at, kind, inside))
        elif type(entry[0]) is list:
            for child in entry:
                number += 1
                if not some or child[0] in kinds:
                    append((number, child, mother, mother_kind, inside))
        else:
            node, field, pos, parent = entry
            kind = type(node)
            if (kind in kept or (mother_kind == "ExceptHandler" and field == "body")) and (not some or kind.__name__ in kinds):
                name = owner = None
                if kind is ast.alias:
                    name, owner = node.name, (parent.module or "") if type(parent) is ast.ImportFrom else None
                yield path, at, mother, mother_kind, field, pos, kind.__name__, inside, name, owner, None, node.lineno, node.end_lineno, True
            if kind in leaves:
                continue
            for name in _fields.get(kind) or _child_fields(kind):
                value = getattr(node, name, None)
                if type(value) is list:
                    i = 0
                    for item in value:
                        if type(item) not in leaves and isinstance(item, tree_node):
                            number += 1
                            append((number, (item, name, i, node), at, kind.__name__, inside))
                        i += 1
                elif type(value) not in leaves and isinstance(value, tree_node):
                    number += 1
                    append((number, (value, name, 0, node), at, kind.__name__, inside))


def _first_line(node: ast.stmt) -> int:
    """Line where a block begins, its decorators included."""
    decorators = getattr(node, "decorator_list", None)
    return decorators[0].lineno if decorators else node.lineno


def _literal(node: ast.AST) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None
