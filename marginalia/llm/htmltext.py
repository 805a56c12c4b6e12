"""Layout-aware rendering of HTML: all visible text, laid out by blocks, lists and table columns.

A tree is built with implied start and end tags; elements that a browser doesn't show are left out;
the rest is written as blocks apart, list items with marks and indents, preformatted text as it is,
and table cells padded to their columns.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_UNSEEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas svg math datalist title base link meta param".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul caption tbody thead tfoot tr td th option optgroup select".split()
)
#: Blocks with an empty line around them.
_APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol menu dir dl pre table figure fieldset article".split())
_ENDS_P = _BLOCK - frozenset("body html tbody thead tfoot tr td th caption option optgroup select legend".split())
#: A start tag ends an open element of these, looking no further than the scope on the right.
_IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th", "caption"}, {"tr", "table"}), "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
_GONE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
_RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*)?([.#][\w-]+)?")
#: A browser's largest spans of a cell.
_COLUMNS, _ROWS = 1000, 65534
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(next((g for g in m.groups()[1:] if g is not None), "")))
    return out


class _Tags:
    """Finds the tags of a source from left to right in time proportional to its length, whatever it holds."""

    def __init__(self, source: str):
        self.source = source
        self.last = {c: source.rfind(c) for c in ">\"'"}
        self.run, self.failed = (0, -1), set()

    def end(self, at: int) -> int:
        """Where the tag whose name ends at `at` has its `>`, quoted ones not counted; -1 if nowhere."""
        passed = []
        while True:
            if not self.run[0] <= at <= self.run[1]:
                self.run = (at, _PLAIN.match(self.source, at).end())
            at = self.run[1]
            if at < len(self.source) and self.source[at] == ">":
                return at
            if at >= self.last[">"] or at in self.failed or at >= self.last[self.source[at]]:
                self.failed.update(passed)
                return -1
            passed.append(at)
            at = self.source.find(self.source[at], at + 1) + 1

    def next(self, at: int):
        """(begin, end, closing, name, attributes) of the next tag; name is None for comments and declarations."""
        source = self.source
        while (at := source.find("<", at)) >= 0:
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                return at, len(source) if end < 0 else end + 3, "", None, ""
            if source[at + 1 : at + 2] in ("!", "?"):
                if at < self.last[">"]:
                    return at, source.find(">", at) + 1, "", None, ""
            elif m := _NAME.match(source, at + 1):
                end = self.end(m.end())
                if end >= 0:
                    return at, end + 1, m[1], m[2].lower(), source[m.end() : end]
            at += 1
        return None


class _Open:
    """The open elements, with the places of each tag, so that none is looked for one by one."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in _BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def top(self, tags) -> int:
        """The place of the last open element of these tags; 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def cut(self, place: int) -> None:
        while len(self.nodes) > place:
            tag = self.nodes.pop().tag
            self.places[tag].pop()
            if tag in _BLOCK:
                self.blocks.pop()

    def close(self, tags, scope) -> None:
        """Ends the open elements of these tags within the scope; an outer one may be open too, as a cell in a row."""
        while (place := self.top(tags)) > self.top(scope):
            self.cut(place)


def tree(source: str) -> Node:
    """The tree of a page. Unclosed and misnested tags are closed as a browser would in the common cases.

    A tag that never ends is text. Elements may be nested to any depth.
    """
    root = Node("html", {})
    stack, at, tags = _Open(root), 0, _Tags(source)
    nodes = stack.nodes

    def text(s: str) -> None:
        if s:
            if nodes[-1].tag == "head" and s.strip():
                stack.cut(stack.top(("head",)))
            if nodes[-1].tag in ("table", "tbody", "thead", "tfoot", "tr") and not s.strip():
                return
            nodes[-1].children.append(html.unescape(s))

    while True:
        m = tags.next(at)
        text(source[at : m[0]] if m else source[at:])
        if not m:
            return root
        _, at, closing, tag, inside = m
        if tag is None:
            continue
        if closing:
            place = stack.top((tag,))
            if tag == "br":
                nodes[-1].children.append(Node("br", {}))
            elif tag == "p" and not place:
                nodes[-1].children.append(Node("p", {}))
            elif place:
                beyond = tag not in ("table", "html", "body") and tag not in _IMPLIED_END and stack.top(("table",)) > place
                within = tag not in _BLOCK and tag not in _RAW and tag != "head" and stack.blocks and stack.blocks[-1] > place
                if not beyond and not within:
                    stack.cut(place)
            continue
        attributes = _attributes(inside) if inside.strip("/ \n") else {}
        if tag == "html" or (tag == "body" and stack.top(("body",))):
            (root if tag == "html" else nodes[stack.places["body"][0]]).attributes.update(attributes)
            continue
        if nodes[-1].tag == "head" and tag not in ("title", "style", "script", "meta", "link", "base", "noscript", "template"):
            stack.cut(len(nodes) - 1)
        if tag in _ENDS_P:
            stack.close(("p",), ("table", "td", "th", "button", "caption"))
        if tag in _IMPLIED_END:
            stack.close(*_IMPLIED_END[tag])
        if tag in ("td", "th") and nodes[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr", {})
            nodes[-1].children.append(row)
            stack.push(row)
        node = Node(tag, attributes)
        nodes[-1].children.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            inner = source[at : end.start()] if end else source[at:]
            node.children.append(html.unescape(inner) if tag in ("textarea", "title") else inner)
            at = end.end() if end else len(source)
        elif tag not in _VOID and not inside.endswith("/"):
            stack.push(node)


class Rules:
    """What a page's style elements hide: rules for one tag, class or id, or a tag with one of these."""

    def __init__(self, root: Node):
        self.styles: dict[tuple[str, str], str] = {}
        left = [root]
        while left:
            node = left.pop()
            if node.tag == "style":
                for m in _RULE.finditer("".join(c for c in node.children if isinstance(c, str))):
                    if _GONE.search(m[2]) or _VISIBILITY.search(m[2]):
                        for one in m[1].split(","):
                            if (s := _SELECTOR.fullmatch(one.strip())) and s[0]:
                                key = ((s[1] or "").lower(), s[2] or "")
                                self.styles[key] = self.styles.get(key, "") + ";" + m[2]
            left += [c for c in node.children if not isinstance(c, str)]

    def style(self, node: Node) -> str:
        own = node.attributes.get("style", "")
        if not self.styles:
            return own
        marks = ["", *("." + c for c in node.attributes.get("class", "").split())] + (["#" + node.attributes["id"]] if node.attributes.get("id") else [])
        found = [self.styles[key] for m in marks for tag in ("", node.tag) if (key := (tag, m)) in self.styles]
        return ";".join([*found, own])


def shown(node: Node, seen: bool, rules: Rules) -> bool | None:
    """Whether an element's own text shows, in one whose own text does if `seen`; None if nothing in it is laid out."""
    a = node.attributes
    if node.tag in _UNSEEN or "hidden" in a or (node.tag == "dialog" and "open" not in a):
        return None
    style = rules.style(node)
    if not style:
        return seen
    if _GONE.search(style):
        return None
    said = _VISIBILITY.findall(style)
    return said[-1].lower() == "visible" if said else seen


def _width(s: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s) if not s.isascii() else len(s)


class Layout:
    """Lines of text; breaks between blocks are kept until text follows."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line, self.gap, self.indent, self.mark = "", 0, 0, ""

    def write(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if not self.line or self.line.endswith(" "):
            s = s.lstrip(" ")
        self.line += s

    def end_line(self) -> None:
        if self.line.strip():
            self._put(self.line.rstrip(" "))
        self.line = ""

    def _put(self, s: str) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        self.lines.append(" " * max(self.indent - len(self.mark), 0) + self.mark + s)
        self.mark = ""

    def apart(self, empty: int) -> None:
        self.end_line()
        self.gap = max(self.gap, empty)

    def verbatim(self, s: str) -> None:
        for x in s.strip("\n").split("\n"):
            self._put(x.rstrip())


def _inner(node: Node, out: Layout, rules: Rules, seen: bool, pre: bool = False):
    """Writes what is in an element; yields the like for elements inside, which `_walk` runs, so that depth has no limit."""
    number = int(node.attributes["start"]) if node.tag == "ol" and re.fullmatch(r"-?\d{1,9}", node.attributes.get("start", "")) else 1
    for child in node.children:
        if isinstance(child, str):
            if not seen:
                continue
            if pre:
                out.line += child
            else:
                out.write(child)
            continue
        here = shown(child, seen, rules)
        if here is None:
            continue
        tag = child.tag
        if tag == "br":
            if pre:
                out.line += "\n"
            else:
                out.end_line()
        elif tag == "wbr" or tag in ("img", "input"):
            pass
        elif tag == "table" and not pre:
            out.apart(1)
            yield _table(child, out, rules, here)
            out.apart(1)
        elif tag in ("pre", "xmp", "textarea"):
            out.apart(1)
            part = Layout()
            yield _inner(child, part, rules, here, True)
            if part.line.strip():
                out.verbatim(part.line)
            out.apart(1)
        elif tag in _BLOCK and not pre:
            item = tag == "li"
            inside_list = node.tag == "li" and tag in ("ul", "ol", "menu", "dir")
            out.apart(1 if tag in _APART and not inside_list and not (node.tag == "li" and not out.lines) else 0)
            step = 2 if item or tag in ("dd", "blockquote") else 0
            if item:
                out.mark = f"{number}. " if node.tag == "ol" else "- "
                step = max(step, len(out.mark))
                number += 1
            out.indent += step
            yield _inner(child, out, rules, here)
            out.apart(0)
            if item:
                out.mark = ""
            out.indent -= step
            out.apart(1 if tag in _APART and not inside_list else 0)
        else:
            yield _inner(child, out, rules, here, pre)


def _walk(work) -> None:
    stack = [work]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


def _span(cell: Node, name: str, most: int) -> int:
    said = cell.attributes.get(name, "").strip()
    return min(int(said), most) if re.fullmatch(r"\d{1,6}", said) else 1


def _table(node: Node, out: Layout, rules: Rules, seen: bool):
    """Rows with cells padded to the width of their column; a cell of several lines takes as many rows, and one that
    spans rows keeps its columns in those that follow."""
    rows: list[list[tuple[list[str], int, int]]] = []
    left = [iter([node])]
    seens = [seen]
    while left:
        part = next(left[-1], None)
        if part is None:
            left.pop(), seens.pop()
            continue
        here = seens[-1]
        if part is node:
            left.append(iter(node.children)), seens.append(here)
        elif isinstance(part, str):
            if here:
                out.write(part)
        elif (inner_seen := shown(part, here, rules)) is None or part.tag in ("col", "colgroup"):
            continue
        elif part.tag == "tr":
            cells = []
            for cell in part.children:
                if isinstance(cell, str):
                    if cell.strip() and inner_seen:
                        out.write(cell)
                elif (cell_seen := shown(cell, inner_seen, rules)) is not None:
                    inner = Layout()
                    yield _inner(cell, inner, rules, cell_seen)
                    inner.end_line()
                    down = _span(cell, "rowspan", _ROWS)
                    cells.append(([x for x in inner.lines if x] or [""], max(_span(cell, "colspan", _COLUMNS), 1), down or _ROWS))
            rows.append(cells)
        elif part.tag in ("tbody", "thead", "tfoot"):
            left.append(iter(part.children)), seens.append(inner_seen)
        else:
            inner = Node("div", {})
            inner.children = [part]
            yield _inner(inner, out, rules, here)
    out.end_line()
    width: dict[int, int] = {}
    placed, taken = [], {}
    for cells in rows:
        # Columns that cells of earlier rows still span are passed.
        at, row = 0, []
        new = {}
        for lines, span, down in cells:
            while taken.get(at):
                at += 1
            row.append((at, lines, span))
            if span == 1:
                width[at] = max(width.get(at, 0), *map(_width, lines))
            if down > 1:
                new.update(dict.fromkeys(range(at, at + span), down))
            at += span
        taken = {c: n - 1 for c, n in {**taken, **new}.items() if n > 1}
        placed.append(row)
    columns = 1 + max((at + span for row in placed for at, _, span in row), default=0)
    begin = [0]
    for c in range(columns):
        begin.append(begin[-1] + width.get(c, 0) + 2 * (c in width))
    for row in placed:
        for k in range(max((len(lines) for _, lines, _ in row), default=0)):
            line, size = [], 0
            for at, lines, _ in row:
                if k < len(lines) and lines[k]:
                    want = max(begin[at], size + 2 * (size > 0))
                    line += [" " * (want - size), lines[k]]
                    size = want + _width(lines[k])
            if size:
                out._put("".join(line).rstrip())


def render(source: str | None) -> str:
    """The visible text of a page; a null or empty page gives an empty text."""
    if not source:
        return ""
    out, root = Layout(), tree(source)
    _walk(_inner(root, out, Rules(root), True))
    out.end_line()
    return "\n".join(out.lines)


SCHEMA = "page_id bigint, url string, text string, n_chars bigint, n_lines bigint"


def _rows(batches):
    for b in batches:
        texts = [render(x) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(t.split("\n")) if t else 0 for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_lines"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_lines.

    A null or empty page has an empty text. Repeated rows repeat; an empty table gives no rows.
    Columns other than page_id, url and html are not read. Pages of any length and depth take time in proportion
    to their length, but for what indents and padding add to the text.
    """
    return pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(_rows, SCHEMA)
