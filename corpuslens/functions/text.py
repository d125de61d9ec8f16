"""Column expressions over text and paths.

They reproduce Python's string rules with built-in Spark functions, so they stay
inside the JVM and need no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the characters Python's str.strip() removes, and its line breaks
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
RARE_LINE_BREAKS = ["\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
_LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"


def strip(text: Column) -> Column:
    """`str.strip()`, by character list: far cheaper than a Unicode regular expression."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def strip_sql(text: str) -> str:
    """`strip` as SQL text, for use inside larger SQL expressions."""
    characters = "".join(rf"\u{ord(c):04x}" for c in WHITE_SPACE)
    return rf"btrim({text}, '{characters}')"


def is_blank(text: Column) -> Column:
    """True when nothing but white space is left."""
    return strip(text) == ""


def without_indent(line: Column) -> Column:
    """`str.lstrip()`; only a line whose blanks are followed by another kind of
    white space pays for the full character list."""
    spaces_off = F.ltrim(line)
    other = [c for c in WHITE_SPACE if c != " "]
    return F.when(F.left(spaces_off, F.lit(1)).isin(other), F.ltrim(line, F.lit(WHITE_SPACE))).otherwise(spaces_off)


def split_lines(text: Column) -> Column:
    """`str.splitlines()`: every Python line break, no empty last piece.

    Texts without rare breaks, nearly all of them, take the plain split.
    """
    last_break_off = F.when(F.endswith(text, F.lit("\n")), F.left(text, F.length(text) - 1)).otherwise(text)
    rare = F.split(F.regexp_replace(text, rf"(?:{_LINE_BREAK})\z", ""), _LINE_BREAK)
    return F.when(contains_any(text, RARE_LINE_BREAKS), rare).otherwise(F.split(last_break_off, "\n"))


def basename(path: Column) -> Column:
    """`os.path.basename` on a `/` path."""
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """`os.path.splitext(path)[1]`; leading dots of a name start no extension."""
    return F.regexp_extract(path, r"(?s)^(?:.*/)?\.*[^/.][^/]*?(\.[^./]*)$", 1)


def contains_any(text: Column, words: list[str]) -> Column:
    """True when the text holds one of the words as a substring."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def first_hit(text: Column, rules: list[tuple[str, list[str]]], default: str | None = None) -> Column:
    """Value of the first rule one of whose words occurs in the text."""
    out = None
    for value, words in rules:
        hit = contains_any(text, words)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.lit(default)) if default is not None else out


def readable_json(text: Column) -> Column:
    """True for what usual JSON readers take: also objects with a repeated key (the last one counts) or with NaN."""
    read = F.from_json(text, "_none string, _corrupt_record string",
                       {"columnNameOfCorruptRecord": "_corrupt_record", "allowSingleQuotes": "false"})
    return F.try_parse_json(text).isNotNull() | F.coalesce(read.isNotNull() & read["_corrupt_record"].isNull(), F.lit(False))


def sorted_join(array: Column, sep: str = "|") -> Column:
    """One string for an array whose order carries no meaning."""
    return F.array_join(F.array_sort(array), sep)


def shorten(text: Column, longest: int, keep: int, tail: str) -> Column:
    """Text longer than `longest` is cut to `keep` characters plus `tail`."""
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, keep), F.lit(tail))).otherwise(text)


def fill(template: str, **columns: Column) -> Column:
    """Replace `{name}` marks of a fixed text by columns, by concatenation only."""
    parts: list[Column] = []
    rest = template
    while rest:
        marks = [(rest.find("{" + n + "}"), n) for n in columns if "{" + n + "}" in rest]
        if not marks:
            parts.append(F.lit(rest))
            break
        at, name = min(marks)
        parts += [F.lit(rest[:at]), columns[name]]
        rest = rest[at + len(name) + 2:]
    return F.concat(*parts)
