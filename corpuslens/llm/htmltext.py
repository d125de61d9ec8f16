"""Visible text of a web page, laid out as it would be read.

A tree builder follows the tokens of a page with the rules that browsers share:
void elements, elements whose end is implied by what follows, raw-text elements,
end tags that close what is open inside them, and tags that are ignored.  The
renderer walks the tree once and keeps all text that is not hidden: by element, by
the `hidden` attribute, by an inline style, by rules of the page's own style sheets
whose selectors are an element, a class, an id or those together, by a dialog or
details that is not open.  What is invisible may have visible parts.  Rules with other
selectors, of media or of other files are not read.  A tag that never ends shows
nothing, as in browsers, and is looked at once.  Blocks stand on their own
lines, paragraphs and headings with a blank line around them, list items with a
bullet or their number and an indent for each level, tables as rows of cells in
columns of equal width (a cell over several rows stands in the first of them, wide
letters count two),
preformatted text as it is, and other white space as one space.  Formulas are
written in one line, with / ^ _ for fractions and scripts; each text of a drawing
is set off by spaces.  Form texts are shown on demand, as `extract` does: the text
of a textarea, the options a select shows before it is opened, and labels of buttons.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Generator, Iterator
from html import unescape
from unicodedata import east_asian_width

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# executors need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- fixed values: element names -------------------------------------------------------------
_set = lambda names: frozenset(names.split())
VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style noframes iframe noembed xmp")          # their text is no markup
ESCAPABLE_RAW = _set("title textarea")                            # but for character references
HIDDEN = _set("head title script style noframes iframe noembed noscript template object audio video canvas datalist rp meter progress")
FORM_TEXTS = _set("textarea select option optgroup")              # shown on demand
HIDDEN_IN_SVG = _set("defs desc metadata symbol clippath mask marker pattern lineargradient radialgradient filter")
HIDDEN_IN_MATH = _set("annotation annotation-xml")
SET_OFF = _set("text mtd mtr mtable textarea select option optgroup")  # by spaces
BETWEEN = {"mfrac": "/", "msup": "^", "mover": "^", "msub": "_", "munder": "_", "msubsup": "_^", "munderover": "_^"}
BLOCK = _set("""address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption""")
SPACED = _set("p h1 h2 h3 h4 h5 h6 blockquote pre table figure ul ol menu dl fieldset")   # a blank line before and after
CLOSES_PARAGRAPH = _set("""address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form
 h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li""")
# an element of the first kind is ended by the start of one of the second, up to a boundary
IMPLIED_END = {
    "li": (_set("li"), _set("ul ol menu")), "dt": (_set("dt dd"), _set("dl")), "dd": (_set("dt dd"), _set("dl")),
    "option": (_set("option optgroup"), _set("select datalist")), "optgroup": (_set("optgroup"), _set("select")),
    "rt": (_set("rt rp"), _set("ruby")), "rp": (_set("rt rp"), _set("ruby")),
    "td": (_set("td th tr tbody thead tfoot"), _set("table")), "th": (_set("td th tr tbody thead tfoot"), _set("table")),
    "tr": (_set("tr tbody thead tfoot"), _set("table")), "caption": (_set("tr td th tbody thead tfoot colgroup"), _set("table")),
    "tbody": (_set("tbody thead tfoot"), _set("table")), "thead": (_set("tbody thead tfoot"), _set("table")),
    "tfoot": (_set("tbody thead tfoot"), _set("table")), "colgroup": (_set("tr tbody thead tfoot"), _set("table")),
    "head": (_set("body"), _set("html")),
}
HEAD_ONLY = _set("base basefont bgsound link meta noscript script style template title head html")
SCOPE = _set("table td th caption template html object")
TABLE_PARTS = _set("tr td th tbody thead tfoot caption")

BUTTON_LABELS = {"submit": "Submit", "reset": "Reset", "button": ""}   # where no value is given

# an attribute: a quote opens a value directly after "=" only, elsewhere it is a character
_ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?+"""
_token = re.compile(rf"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE})*+)>|(<)/?[A-Za-z]", re.S)
_attribute = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?+""")
_space = re.compile(r"[ \t\n\r\f]+")
_style = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(?:!\s*important\s*)?(?=;|$)", re.I)
_selector = re.compile(r"([a-z][a-z0-9]*)?((?:[.#][\w-]+)*)", re.I)
_attributes_of_note = _set("hidden style start value colspan rowspan type selected multiple size label class id open")


class Node:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: dict[str, str] | None = None):
        self.name, self.attributes, self.children = name, attributes or {}, []


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _attribute.findall(text):
        name = name.lower()
        if name in _attributes_of_note:
            found.setdefault(name, unescape(a or b or c))
    return found


def build_tree(html: str) -> Node:
    """The root; text nodes are strings with their character references resolved."""
    root = Node("#root")
    open_: list[Node] = [root]
    count: Counter = Counter()  # of open elements by name, so that a search for none is not made
    at, n = 0, len(html)

    def close_to(depth: int) -> None:
        for node in open_[depth:]:
            count[node.name] -= 1
        del open_[depth:]

    def innermost(names: frozenset, boundary: frozenset) -> int | None:
        if not any(count[x] for x in names):
            return None
        for depth in range(len(open_) - 1, 0, -1):
            if open_[depth].name in names:
                return depth
            if open_[depth].name in boundary:
                return None
        return None

    def text(value: str) -> None:
        if not value:
            return
        if open_[-1].name == "head" and value.strip(" \t\n\r\f"):
            close_to(len(open_) - 1)
        open_[-1].children.append(unescape(value) if "&" in value else value)

    while at < n:
        m = _token.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at:m.start()])
        at = m.end()
        if m[4]:
            break  # the tag never ends
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "p" and innermost(_set_p, SCOPE) is None:
                open_[-1].children.append(Node("p"))
            elif name == "br":
                open_[-1].children.append(Node("br"))
            elif name in ("body", "html"):
                continue
            else:
                names = _headings if name in _headings else frozenset([name])
                # an inline end tag does not reach out of its cell; a table part's end does, up to its table
                boundary = _table if name in TABLE_PARTS else frozenset() if name in ("table", "template") else SCOPE
                depth = innermost(names, boundary)
                if depth is not None:
                    close_to(depth)
            continue
        if open_[-1].name == "head" and name not in HEAD_ONLY:
            close_to(len(open_) - 1)
        if name in CLOSES_PARAGRAPH:
            depth = innermost(_set_p, SCOPE)
            if depth is not None:
                close_to(depth)
        if name in _headings and open_[-1].name in _headings:
            close_to(len(open_) - 1)
        for ended, (by, boundary) in _ends_of.get(name, ()):
            depth = innermost(ended, boundary)
            if depth is not None:
                close_to(depth)
        node = Node(name, _attributes(m[3]) if m[3] and m[3].strip(" /") else None)
        open_[-1].children.append(node)
        if name in VOID or m[3].endswith("/") and (count["svg"] or count["math"]):
            continue
        if name in RAW or name in ESCAPABLE_RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>?", re.I).search(html, at)
            value = html[at:end.start()] if end else html[at:]
            if value:
                node.children.append(unescape(value) if name in ESCAPABLE_RAW else value)
            at = end.end() if end else n
            continue
        if name == "plaintext":
            text_node = html[at:]
            if text_node:
                node.children.append(text_node)
            break
        open_.append(node)
        count[name] += 1
    return root


_set_p, _table = _set("p"), _set("table")
_headings = _set("h1 h2 h3 h4 h5 h6")
_ends_of: dict = {}
for _name, (_by, _boundary) in IMPLIED_END.items():
    for _next in _by:
        _ends_of.setdefault(_next, []).append((frozenset([_name]), (_by, _boundary)))
# a row group ends cells and rows alike: the outermost of them goes first
for _next, _rules in _ends_of.items():
    _rules.sort(key=lambda r: ["td", "th", "tr", "caption", "colgroup", "tbody", "thead", "tfoot"].index(min(r[0])) if min(r[0]) in TABLE_PARTS | {"colgroup"} else -1)


class Page:
    """Lines under construction: pending space, pending blank lines, and the indent of lists and quotes."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False
        self.space = False
        self.indent = ""
        self.marker: str | None = None

    def words(self, value: str) -> None:
        inner = _space.sub(" ", value)
        if inner == " ":
            self.space = True
            return
        if inner[0] == " ":
            self.space = True
            inner = inner[1:]
        trailing = inner[-1:] == " "
        self._put((" " if self.space and self.line else "") + (inner[:-1] if trailing else inner))
        self.space = trailing

    def _put(self, value: str) -> None:
        if not self.line:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            lead = self.indent
            if self.marker is not None:
                lead = lead[:max(0, len(lead) - len(self.marker))] + self.marker
                self.marker = None
            self.line.append(lead)
        self.line.append(value)

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def line_break(self) -> None:
        if self.line:
            self.end_line()
        elif self.lines and not self.blank:
            self.lines.append("")

    def raw(self, value: str) -> None:
        for i, part in enumerate(value.replace("\r\n", "\n").split("\n")):
            if i:
                if not self.line:
                    self._put("")
                self.end_line()
            if part:
                self._put(part.replace("\t", "    "))

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.blank = self.blank or spaced

    def text(self) -> str:
        self.end_line()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        return "\n".join(lines)


class Looks:
    """What a page's own style sheets say about elements: `display` and `visibility` by simple selectors."""

    def __init__(self, root: Node):
        self.rules: dict[str, list[tuple[frozenset, dict[str, str]]]] = {}  # by an element, .class or #id that must be there
        todo: list = [root]
        sheets = []
        while todo:
            x = todo.pop()
            if isinstance(x, Node):
                if x.name == "style":
                    sheets += [c for c in x.children if isinstance(c, str)]
                todo.extend(reversed(x.children))
        for sheet in sheets:
            for selectors, declarations in _rules(sheet):
                said = _declared(declarations)
                for selector in selectors.split(",") if said else ():
                    m = _selector.fullmatch(selector.strip())
                    if m and m[0]:
                        parts = frozenset(([m[1].lower()] if m[1] else []) + re.findall(r"[.#][\w-]+", m[2]))
                        self.rules.setdefault(min(parts), []).append((parts, said))

    def of(self, node: Node) -> dict[str, str]:
        """display and visibility of an element, where something says so; later rules and inline styles win."""
        a = node.attributes
        found: dict[str, str] = {}
        if self.rules:
            own = {node.name} | {"." + c for c in a.get("class", "").split()} | ({"#" + a["id"]} if "id" in a else set())
            for part in sorted(own & self.rules.keys()):
                for parts, said in self.rules[part]:
                    if parts <= own:
                        found |= said
        if "hidden" in a:
            found.setdefault("display", "none")
        return found | _declared(a["style"]) if "style" in a else found


    def unseen(self, before: bool, *nodes: Node | str) -> bool:
        """Whether what stands in the last of nested nodes is invisible; `before` holds around them."""
        for node in nodes:
            if isinstance(node, Node) and (node.attributes or self.rules):
                before = {"hidden": True, "collapse": True, "visible": False}.get(self.of(node).get("visibility"), before)
        return before


def _rules(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of a style sheet; those inside @media and the like do not always hold and are left out."""
    sheet = re.sub(r"/\*.*?(?:\*/|\Z)", " ", sheet, flags=re.S)
    start = body = depth = 0
    selectors = ""
    for m in re.finditer("[{};]", sheet):
        if m[0] == "{":
            depth += 1
            if depth == 1:
                selectors, body = sheet[start:m.start()], m.end()
        elif m[0] == "}":
            depth = max(depth - 1, 0)
            if depth == 0:
                if selectors.strip() and not selectors.lstrip().startswith("@"):
                    yield selectors, sheet[body:m.start()]
                start, selectors = m.end(), ""
        elif depth == 0:
            start = m.end()


def _declared(style: str) -> dict[str, str]:
    return {name.lower(): value.lower() for name, value in _style.findall(style)}


def _removed(node: Node, forms: bool, looks: Looks) -> bool:
    """True for elements that take no place at all."""
    if node.name in HIDDEN or not forms and node.name in FORM_TEXTS or node.name == "dialog" and "open" not in node.attributes:
        return True
    return looks.of(node).get("display") == "none" if node.attributes or looks.rules else False


def _shown_options(select: Node) -> list[Node | str]:
    """All children of a list box; the chosen option, or else the first, of a menu."""
    if "multiple" in select.attributes or _integer(select.attributes.get("size"), 1) > 1:
        return select.children
    options, todo = [], list(reversed(select.children))
    while todo:
        x = todo.pop()
        if isinstance(x, Node):
            if x.name == "option":
                options.append(x)
            else:
                todo.extend(reversed(x.children))
    return [x for x in options if "selected" in x.attributes][-1:] or options[:1]


def _formula(node: Node) -> list[Node | str]:
    """Children of a fraction or script with the signs between them; what has several parts is in parentheses."""
    signs = BETWEEN[node.name]
    out: list[Node | str] = []
    for i, x in enumerate(x for x in node.children if isinstance(x, Node)):
        if i:
            out.append(signs[min(i, len(signs)) - 1])
        several = x.name in ("mrow", "mfrac") and len([c for c in x.children if isinstance(c, Node)]) > 1
        out += ["(", x, ")"] if several else [x]
    return out


def render(root: Node, forms: bool = False) -> str:
    """Visible text of a tree; tables in tables are rendered on a stack of their own."""
    looks = Looks(root)
    stack = [_rendered(root, forms, looks, False)]
    answer: str | None = None
    while stack:
        try:
            stack.append(_rendered(*stack[-1].send(answer)))
            answer = None
        except StopIteration as end:
            stack.pop()
            answer = end.value
    return answer


def _rendered(root: Node, forms: bool, looks: Looks, unseen: bool) -> Generator:
    """Text of a tree, without recursion: what it yields are the arguments of inner trees, whose texts are sent back."""
    page = Page()
    # entries: (what, argument); nodes are entered, and their ends restore what they changed
    todo: list[tuple] = [("node", root)]
    pre = 0
    drawings = formulas = 0
    lists: list[list] = []
    while todo:
        what, x = todo.pop()
        if what == "text":
            if not unseen:
                page.raw(x) if pre else page.words(x)
            continue
        if what == "end":
            name, indent, was_pre, unseen = x
            if name in BLOCK:
                page.block(name in SPACED and not (name in ("ul", "ol", "menu") and len(lists) > 1))
            page.indent, pre = indent, was_pre
            drawings -= name == "svg"
            formulas -= name == "math"
            if name in SET_OFF:
                page.space = True
            if name in ("ul", "ol", "menu"):
                lists.pop()
            if name == "q" and not x[3]:
                page.words("”")
            if name == "li":
                page.marker = None
            continue
        node, name = x, x.name
        if _removed(node, forms, looks) or drawings and name in HIDDEN_IN_SVG or formulas and name in HIDDEN_IN_MATH:
            continue
        if name == "br":
            page.line_break()
            continue
        if name == "hr":
            page.block(True)
            if not unseen:
                page.words("---")
            page.block(True)
            continue
        was_unseen, unseen = unseen, looks.unseen(unseen, node)
        if name == "input":
            label = BUTTON_LABELS.get(node.attributes.get("type", "").strip().lower())
            if forms and label is not None and not unseen:
                page.space = True
                page.words((node.attributes.get("value") or label) + " ")
            unseen = was_unseen
            continue
        if name == "table":
            page.block(True)
            for line in (yield from table_lines(node, forms, looks, unseen)):
                page._put(line)
                page.end_line()
            page.block(True)
            unseen = was_unseen
            continue
        if name in BLOCK:
            page.block(name in SPACED and not (name in ("ul", "ol", "menu") and lists))
        todo.append(("end", (name, page.indent, pre, was_unseen)))
        drawings += name == "svg"
        formulas += name == "math"
        if name in SET_OFF:
            page.space = True
        if name in ("ul", "ol", "menu"):
            lists.append([name, _integer(node.attributes.get("start"), 1)])
        elif name == "li":
            if lists and lists[-1][0] == "ol":
                number = _integer(node.attributes.get("value"), lists[-1][1])
                lists[-1][1] = number + 1
                marker = f"{number}. "
            else:
                marker = "* "
            page.indent += " " * len(marker)
            page.marker = None if unseen else marker
        elif name == "blockquote":
            page.indent += "> "
        elif name == "dd":
            page.indent += "    "
        elif name in ("pre", "textarea"):
            pre += 1
        elif name == "q" and not unseen:
            page.words("“")
        children = node.children
        if name == "details" and "open" not in node.attributes:
            children = [x for x in children if isinstance(x, Node) and x.name == "summary"][:1]
        if name == "select":
            children = _shown_options(node)
        elif name == "optgroup" and "label" in node.attributes:
            children = [node.attributes["label"] + " ", *children]
        elif name == "option" and node.attributes.get("label"):
            children = [node.attributes["label"]]
        elif name in BETWEEN and formulas:
            children = _formula(node)
        if name in ("pre", "textarea") and children and isinstance(children[0], str) and children[0].startswith("\n"):
            children = [children[0][1:], *children[1:]]
        for child in reversed(children):
            if isinstance(child, str):
                if child:
                    todo.append(("text", child))
            else:
                todo.append(("node", child))
    return page.text()


def _integer(value: str | None, default: int) -> int:
    return int(value) if value and re.fullmatch(r"\s*-?\d{1,9}\s*", value) else default


def _width(line: str) -> int:
    """Columns of a line; wide letters take two."""
    return len(line) if line.isascii() else sum(2 if east_asian_width(c) in "WF" else 1 for c in line)


def table_lines(table: Node, forms: bool, looks: Looks, unseen: bool) -> Generator:
    """Caption, then rows; cells are aligned in columns, several lines of a cell stay together."""
    captions, rows = [], []
    # with the row group that each part stands in
    todo: list[tuple] = [(x, table) for x in reversed(table.children)]
    loose: list = []
    while todo:
        x, group = todo.pop()
        if isinstance(x, str) or x.name not in TABLE_PARTS:
            # what stands in a table outside its cells is shown before it
            if isinstance(x, Node) and x.name in ("colgroup", "col"):
                continue
            loose.append(x)
        elif _removed(x, forms, looks):
            continue
        elif x.name == "caption":
            captions.append(x)
        elif x.name == "tr":
            rows.append((x, group))
        elif x.name in ("td", "th"):
            if not rows or rows[-1][0].name != "#cells":
                rows.append((Node("#cells"), group))
            rows[-1][0].children.append(x)
        else:
            todo.extend((c, x) for c in reversed(x.children))
    lines: list[str] = []
    for nodes in ([loose] if loose else []) + [c.children for c in captions]:
        holder = Node("#part")
        holder.children = nodes
        shown = yield holder, forms, looks, unseen
        if shown:
            lines += shown.split("\n")
    grid: list[list[list[str]]] = []
    below: dict[int, int] = {}  # rows that cells of earlier rows still reach into, by column
    last = None
    for row, group in rows:
        if group is not last:
            below, last = {}, group
        cells: list[list[str]] = []
        spans: dict[int, int] = {}
        for cell in row.children:
            if isinstance(cell, str) and not cell.strip():
                continue
            if isinstance(cell, Node) and _removed(cell, forms, looks):
                continue
            while below.get(len(cells), 0):
                cells.append([""])
            holder = Node("#part")
            holder.children = cell.children if isinstance(cell, Node) and cell.name in ("td", "th") else [cell]
            start = len(cells)
            cells.append((yield holder, forms, looks, looks.unseen(unseen, group, row, cell)).split("\n"))
            span = _integer(cell.attributes.get("colspan"), 1) if isinstance(cell, Node) else 1
            cells += [[""]] * (min(max(span, 1), 1000) - 1)
            down = _integer(cell.attributes.get("rowspan"), 1) if isinstance(cell, Node) else 1
            # 0 reaches to the end of the row group
            down = min(down, 65534) if down > 0 else 65534 if down == 0 else 1
            if down > 1:
                spans.update((k, down) for k in range(start, len(cells)))
        below = {k: n - 1 for k, n in {**below, **spans}.items() if n > 1}
        if any(any(c) for c in cells):
            grid.append(cells)
    widths = [max((_width(line) for row in grid if k < len(row) for line in row[k]), default=0) for k in range(max(map(len, grid), default=0))]
    for row in grid:
        for i in range(max(map(len, row))):
            shown = [cell[i] if i < len(cell) else "" for cell in row]
            parts = [x + " " * (widths[k] - _width(x)) for k, x in enumerate(shown)]
            lines.append(" | ".join(parts).rstrip(" ") if len(parts) > 1 else parts[0].rstrip(" "))
    return lines


def visible_text(html: str | None, forms: bool = False) -> str:
    return render(build_tree(html), forms=forms) if html else ""


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns `keep` and text, the visible text with form texts, of every page.

    Defined cases: null and empty pages give ""; markup that never ends is read
    to the end; repeated rows each give a row; an empty table gives none; columns
    that are not kept are not read.
    """
    kept = pages.select(*keep).schema
    shape = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                shown = pa.array([visible_text(h.as_py(), forms=True) for h in part.column(len(keep))], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], shown], [*keep, "text"])

    return pages.select(*keep, html).mapInArrow(run, shape)
