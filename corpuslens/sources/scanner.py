"""Blocks of a Python text found line by line, without a syntax tree.

Metrics and issue rules read blocks, arguments, docstrings, imports and boolean operators.
`scanned` takes these from the lines where patterns know a whole line: simple statements, and
heads of blocks.  Patterns say less than Python allows, never more.  Another line is given to
Python's parser alone, with the lines after it while brackets are open; what comes back must be
whole statements, or one head.  A text where that does not do, or would be frequent, is not
scanned: None, and the caller parses it whole.

Records are [kind, field, pos, name, text, first line, last line, children, arguments, kept ..]; a
child is a record or a piece of a syntax tree as (node, field, pos, parent), which may hold a
boolean operator or an import.
"""

from __future__ import annotations

import ast
import keyword
import re
import sys

from pyspark import cloudpickle

# executors need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- what one line may hold: names, numbers, plain strings, one level of brackets, few operators
# (asked by their first characters first, as most are no keywords)
WORD = rf"(?=[A-Za-z_])(?!(?:{'|'.join(keyword.kwlist)}|__debug__)\b)\w++"
_LITERAL = (
    r"(?:(?:0|[1-9]\d{0,17}+)(?:\.\d{1,17}+)?+(?![\w.])"
    r"|'[ -&(-\[\]-~]*+'(?!')|\"[ !#-\[\]-~]*+\"(?!\")|(?:None|True|False)\b)")
ATOM = rf"(?:{WORD}(?:\.{WORD}){{0,8}}+|{_LITERAL})"
ARGUMENTS = rf"\((?:{ATOM}(?![=\w])(?:, ?(?!\w++=){ATOM})*+(?:, ?{WORD}={ATOM})*+|{WORD}={ATOM}(?:, ?{WORD}={ATOM})*+)?\)"
TRAILERS = rf"(?:\.{WORD}|{ARGUMENTS}|\[{ATOM}\]){{0,8}}+"
VALUE = rf"(?:{WORD}(?:(?=[.(\[]){TRAILERS})?+|{_LITERAL})"
VALUES = rf"{VALUE}(?: ?(?:[-+*/%]|//|[<>]=?|[=!]=) ?{VALUE}){{0,8}}+"
TARGET = rf"{WORD}(?:\.{WORD}){{0,8}}+(?:\[{ATOM}\])?+"
STATEMENT = rf"(?:{TARGET}(?: ?(?:[-+*/%]|//)?=(?!=) ?{VALUES}|(?=\(){TRAILERS}(?<=\)))|return {VALUES})"

_NOTE = r"(?:#[ -~\t\xa1-\ud7ff]*+)?+"
_END = rf"(?:\n| *+{_NOTE}\n)"
_PLAIN = rf"(?:{WORD} = (?:{WORD}|{_LITERAL})\n|{STATEMENT}{_END})"   # the commonest ones first
_TEST = rf"(?:not )?+{VALUES}(?: (?:not in|in|is not|is) {VALUE})?+"
_CHAIN = rf"{_TEST}(?:(?: and {_TEST})++|(?: or {_TEST})++)"   # one boolean operator
_EMPTY = r"\[\]|\{\}|\(\)"
_NAMED, _DEFAULT = rf"{WORD}(?=[,)])", rf"{WORD}=(?:{ATOM}|{_EMPTY})(?=[,)])"
_PARAMETERS = rf"(?:{_NAMED}(?:, ?{_NAMED})*+(?:, ?{_DEFAULT})*+|{_DEFAULT}(?:, ?{_DEFAULT})*+)?+"
# a block's whole body, where it is plain and a line of the block around comes next
_BODY = rf"(?:(?P<inner>(?P=indent) ++){_PLAIN}(?:(?P=inner){_PLAIN})*+(?=(?P=indent)[^\s#])(?P<closed>))?+"
_DOC = r'"""(?P<doc>(?:[ !#-\[\]-~\n\t\xa1-\ud7ff]|"(?!""))*+)"""'
_TEXT = r"""(?:'(?P<one>[ -&(-\[\]-~]*+)'(?!')|"(?P<two>[ !#-\[\]-~]*+)"(?!"))"""
# an empty group at its end tells the kind of a line
_LINE = re.compile(
    rf"(?:[ \t]*+{_NOTE}\n)*+(?P<indent> *+)(?:{_PLAIN}(?:(?P=indent){_PLAIN})*+(?P<run>)"
    rf"|(?:(?:if|while) {_TEST}|for {WORD}(?:, ?{WORD}){{0,8}}+ in {VALUES}):{_END}{_BODY}(?P<block>)|elif {_TEST}:{_END}(?P<elif>)"
    rf"|pass{_END}(?P<pass>)|try:{_END}(?P<try>)|else:{_END}(?P<else>)|finally:{_END}(?P<finally>)"
    rf"|except(?P<taken> {VALUE}(?: as {WORD})?+)?+:{_END}(?P<except>)|def (?P<function>{WORD})\((?P<parameters>{_PARAMETERS})\):{_END}(?P<def>)"
    rf"|class (?P<klass>{WORD})(?:{ARGUMENTS})?+:{_END}(?P<class>)|(?:{_DOC}|{_TEXT}){_END}(?P<text>)|@{WORD}{TRAILERS}{_END}(?P<decorator>)"
    rf"|(?:(?P<returned>return )|{TARGET} ?= ?){_CHAIN}{_END}(?P<boolean>)"
    rf"|(?:if|while) {_CHAIN}:{_END}(?P<boolean_block>))", re.A)
_KIND = _LINE.groupindex
_RUN, _BLOCK, _ELIF, _PASS, _TRY, _ELSE, _FINALLY, _EXCEPT, _DEF, _CLASS, _TEXT_LINE, _DECORATOR, _BOOLEAN, _BOOLEAN_BLOCK, _CLOSED = (
    _KIND[name] for name in ("run", "block", "elif", "pass", "try", "else", "finally", "except", "def", "class", "text", "decorator",
                             "boolean", "boolean_block", "closed"))
_CLAUSES, _DECORATED = frozenset((_ELIF, _ELSE, _EXCEPT, _FINALLY)), frozenset((_DEF, _CLASS, _DECORATOR))
_OPENS = {"i": "If", "w": "While", "f": "For"}   # by the first letter
_BLANK = re.compile(rf"(?:[ \t]*+{_NOTE}\n)*+[ \t]*+{_NOTE}\Z")
_OTHER = re.compile(rf"(?:[ \t]*+{_NOTE}\n)*+( *+)([^\s#][^\n]*+)\n")
_PARAMETER = re.compile(rf"({WORD})(?:=({ATOM}|{_EMPTY}))?+(?:, ?)?+", re.A)
_CONSTANT = re.compile(r"[\d'\"]|(?:None|True|False)\Z")
_MADE = {"[]": "List", "{}": "Dict", "()": "Tuple"}
_MOST_ELIF, _MOST_BLOCKS = 100, 30
_MOST_LINES, _MOST_CHARS = 60, 4000          # of a statement that goes to the parser alone
_FIRST_PARSED, _PARSED_CHARS = 16, 100       # so many such statements at first, and one more for so many characters
_SIMPLE = frozenset((
    ast.Assign, ast.Expr, ast.AugAssign, ast.AnnAssign, ast.Return, ast.Delete, ast.Raise, ast.Assert, ast.Pass, ast.Break, ast.Continue,
    ast.Global, ast.Nonlocal, ast.Import, ast.ImportFrom))
_HEADS = {
    ast.If: ("test",), ast.While: ("test",), ast.For: ("target", "iter"), ast.FunctionDef: None, ast.ClassDef: None, ast.With: None,
    ast.AsyncFunctionDef: None}
_DOCUMENTED = frozenset(("FunctionDef", "ClassDef"))
_DECORABLE = _DOCUMENTED | {"AsyncFunctionDef"}
_KEPT = frozenset(("FunctionDef", "ClassDef", "If", "For", "While", "Try", "ExceptHandler"))
_CONTINUED = frozenset(("If", "For", "While", "Try"))


class _NotScanned(Exception):
    pass


def scanned(content: str | None) -> list | None:
    """The module's record, None if the text is not scanned; one that Python cannot parse never is."""
    if content is None or "\r" in content or content.count("elif") > _MOST_ELIF:
        return None
    if content and content[-1] != "\n":
        content += "\n"
    try:
        return _module(content)
    except _NotScanned:
        return None


def _record(kind: str, field: str, pos: int, line: int, name: str | None = None, outer: list | None = None) -> list:
    """Of a block; `outer` is the statement it is a clause of, the last place counts handlers."""
    return [kind, field, pos, name, None, line, line, [], (), True, outer, 0]


def _leaf(kind: str, field: str, pos: int, line: int, name: str | None = None, end: int | None = None) -> list:
    return [kind, field, pos, name, None, line, end or line, (), (), True]


def _module(content: str) -> list:
    module = ["Module", "", -1, None, None, None, None, [], (), True, None, 0]
    match, count = _LINE.match, content.count
    size, parsed, end = len(content), 0, 0
    at, line = 0, 1   # a place and the number of its line
    # the open block: its indentation (None: the next line's) and the head's, record, field, children of the record, whether it is
    # a handler's, statements so far; the last one if it may go on (else, except ..), and how far that has come
    indent, floor, owner, field, children, in_handler, pos, last, state = 0, -1, module, "body", module[7], False, 0, None, 0
    around: list[tuple] = []   # the same of the blocks around
    decorated = False
    while at < size:
        found = match(content, at)
        if found is not None:
            kind = found.lastindex
            start, first = found.span(1)
            stop = found.end()
        else:
            if _BLANK.match(content, at):
                break
            parsed += 1
            other = _OTHER.match(content, at)
            if other is None or parsed > _FIRST_PARSED + at // _PARSED_CHARS:
                raise _NotScanned
            kind = 0
            start, first = other.span(1)
            stop = other.end()
        if start != at:
            line += count("\n", at, start)
        at, width = stop, first - start
        if width != indent:
            if indent is None:
                if width <= floor:
                    raise _NotScanned
                indent = width
            else:
                while width < indent:
                    if not around or decorated or (last is not None and last[0] == "Try" and not state):
                        raise _NotScanned
                    _close(owner, end)
                    indent, floor, owner, field, children, in_handler, pos, last, state = around.pop()
                if width != indent:
                    raise _NotScanned
        if decorated and kind and kind not in _DECORATED:
            raise _NotScanned

        if kind in _CLAUSES:
            opened, inner, state = _clause(kind, found, last, state, line)
            if kind == _ELIF:
                last = opened
            around.append((indent, floor, owner, field, children, in_handler, pos, last, state))
            owner, field, in_handler = opened, inner, kind == _EXCEPT
        else:
            if last is not None:
                if last[0] == "Try" and not state:
                    raise _NotScanned
                last = None
            if kind == _RUN:
                if in_handler:
                    body = _parsed(content[first:stop].replace("\n" + found[1], "\n"))
                    children += [_leaf(type(node).__name__, field, pos + i, line + i) for i, node in enumerate(body)]
                lines = count("\n", first, stop)
                pos += lines
                line += lines
                end = line - 1
                continue
            if kind == _BLOCK:
                opened = [_OPENS[content[first]], field, pos, None, None, line, line, [], (), True, None, 0]
                if found.end(_CLOSED) > 0:
                    line += count("\n", first, stop)
                    end = opened[6] = line - 1
                    children.append(opened)
                    pos += 1
                    last, state = opened, 0
                    continue
            elif kind == _DEF:
                opened = _record("FunctionDef", field, pos, line, found["function"])
                opened[8] = _parameters(found["parameters"], line)
            elif kind == _TRY:
                opened = _record("Try", field, pos, line)
            elif kind == _CLASS:
                opened = _record("ClassDef", field, pos, line, found["klass"])
            elif kind == _BOOLEAN_BLOCK:
                opened = _record(_OPENS[content[first]], field, pos, line)
                opened[7].append(_leaf("BoolOp", "test", 0, line))
            elif kind == _BOOLEAN:
                statement = _record("Assign" if found["returned"] is None else "Return", field, pos, line)
                statement[7], statement[9] = (_leaf("BoolOp", "value", 0, line),), in_handler
                children.append(statement)
                pos += 1
                end = line
                line += 1
                continue
            elif kind == _DECORATOR:
                decorated = True
                line += 1
                continue
            elif kind:   # `pass`, or a text
                end, what = line, "Pass"
                if kind == _TEXT_LINE:
                    what, (doc, one, two) = "Expr", found.group("doc", "one", "two")
                    text = doc if doc is not None else one if one is not None else two
                    end += text.count("\n")
                    if not pos and field == "body" and owner[0] in _DOCUMENTED:
                        owner[4] = text
                if in_handler:
                    children.append(_leaf(what, field, pos, line, end=end))
                pos += 1
                line = end + 1
                continue
            elif other[2].endswith(":"):
                opened = _head(other[2], field, pos, line)
                if decorated and opened[0] not in _DECORABLE:
                    raise _NotScanned
            else:
                body, at = _statements(content, first)
                whole = content[first:at]
                holds = "and" in whole or "or" in whole   # as every import has
                if decorated or (holds and "lambda" in whole):
                    raise _NotScanned
                if not pos and field == "body" and owner[0] in _DOCUMENTED:
                    owner[4] = _literal(body[0])
                ast.increment_lineno(ast.Module(body, []), line - 1)
                for node in body:
                    if holds or in_handler:
                        children.append((node, field, pos, None))
                    pos += 1
                end = body[-1].end_lineno
                line += whole.count("\n")
                continue
            decorated = False
            opened[9] = in_handler or opened[0] in _KEPT
            children.append(opened)
            pos += 1
            around.append((indent, floor, owner, field, children, in_handler, pos, opened if opened[0] in _CONTINUED else None, 0))
            owner, field, in_handler = opened, "body", False
        if len(around) > _MOST_BLOCKS:
            raise _NotScanned
        indent, floor, children, pos, last, state = None, indent, owner[7], 0, None, 0
        end = line
        line += 1
    if indent is None or decorated:
        raise _NotScanned
    while True:
        if last is not None and last[0] == "Try" and not state:
            raise _NotScanned
        if not around:
            return module
        _close(owner, end)
        indent, floor, owner, field, children, in_handler, pos, last, state = around.pop()


def _close(record: list, end: int) -> None:
    """A block ends, and the statements that it is a clause of go on so far."""
    while record is not None:
        record[6] = end
        record = record[10]


def _clause(kind: int, found: re.Match, last: list | None, state: int, line: int) -> tuple[list, str, int]:
    """The record and field of the block that a clause opens, and how far the last statement has come with it.

    States: 0 its body, 1 handlers, 2 one that takes all, 3 else, 4 finally.
    """
    what = last[0] if last is not None else None
    if kind == _ELIF and what == "If" and not state:
        opened = _record("If", "orelse", 0, line, outer=last)
        last[7].append(opened)
        return opened, "body", 0
    if kind == _ELSE and (state in (1, 2) if what == "Try" else what is not None and not state):
        return last, "orelse", 3
    if kind == _FINALLY and what == "Try" and state < 4:
        return last, "finalbody", 4
    if kind == _EXCEPT and what == "Try" and state < 2:
        opened = _record("ExceptHandler", "handlers", last[11], line, outer=last)
        last[11] += 1
        last[7].append(opened)
        return opened, "body", 1 if found["taken"] else 2
    raise _NotScanned


def _parameters(text: str, line: int) -> tuple:
    """Records of the arguments of a function, then of their defaults."""
    if not text:
        return ()
    if "=" not in text:
        return tuple([["arg", "args", i, name.strip(), None, line, line, (), (), True] for i, name in enumerate(text.split(","))])
    names, defaults = [], []
    for found in _PARAMETER.finditer(text):
        name, value = found.groups()
        names.append(["arg", "args", len(names), name, None, line, line, (), (), True])
        if value is not None:
            kind = _MADE.get(value) or ("Constant" if _CONSTANT.match(value) else "Attribute" if "." in value else "Name")
            defaults.append(_leaf(kind, "defaults", len(defaults), line))
    return *names, *defaults


def _parsed(text: str) -> list[ast.stmt]:
    try:
        return ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        raise _NotScanned from None


def _head(text: str, field: str, pos: int, line: int) -> list:
    """The record of the block that a line opens."""
    if len(text) > _MOST_CHARS:
        raise _NotScanned
    body = _parsed(text + " pass")
    node, kind = body[0], type(body[0])
    if len(body) > 1 or kind not in _HEADS or len(node.body) > 1 or type(node.body[0]) is not ast.Pass or getattr(node, "orelse", None):
        raise _NotScanned
    opened = _record(kind.__name__, field, pos, line, node.name if kind in (ast.FunctionDef, ast.ClassDef) else None)
    if kind is ast.FunctionDef:
        opened[8] = (
            *(_leaf("arg", "args", i, line, a.arg) for i, a in enumerate(node.args.args)),
            *(_leaf(type(d).__name__, "defaults", i, line) for i, d in enumerate(node.args.defaults)))
    if "and" in text or "or" in text:
        if "lambda" in text or (_HEADS[kind] is None and any(type(n) is ast.BoolOp for n in ast.walk(node))):
            raise _NotScanned
        ast.increment_lineno(node, line - 1)
        opened[7] += [(getattr(node, name), name, 0, None) for name in _HEADS[kind] or ()]
    return opened


def _statements(content: str, first: int) -> tuple[list[ast.stmt], int]:
    """The simple statements that begin there, as many as stand on their lines, and where these end."""
    stop, depth, begin = first, 0, first
    for _ in range(_MOST_LINES):
        stop = content.find("\n", stop) + 1
        if not stop or stop - first > _MOST_CHARS:
            break
        some = content[begin:stop]
        # a guess of when to ask the parser; brackets in texts may mislead it, which is noticed
        depth += some.count("(") + some.count("[") + some.count("{") - some.count(")") - some.count("]") - some.count("}")
        begin = stop
        if depth <= 0:
            body = _parsed(content[first:stop])
            if not body or any(type(node) not in _SIMPLE for node in body):
                break
            return body, stop
    raise _NotScanned


def _literal(node: ast.stmt) -> str | None:
    value = node.value if type(node) is ast.Expr else None
    return value.value if type(value) is ast.Constant and type(value.value) is str else None
