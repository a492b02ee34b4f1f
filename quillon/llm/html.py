"""Visible text of web pages, laid out as a reader would see it.

A tree builder closes what HTML leaves open (p, li, dt, dd, option, table rows and cells, ...) and
takes scripts and styles as raw text. The renderer leaves out what is not shown (head, script,
style, template, noscript, the hidden attribute, display:none, visibility:hidden, hidden inputs),
collapses white space as CSS does, ends blocks with a newline and paragraphs, headings, lists
and tables with an empty line, marks list items with a bullet or their number, keeps pre as it is,
and pads the cells of a table so that its columns line up. Tables of nested depth are cells' text.

Nulls: a null html is empty, an empty page has empty text; null ids and urls are carried. Repeated
rows give repeated results. A page that is cut off or badly nested is rendered as far as it goes;
nothing recurses with its depth. Other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import read

TOKEN = re.compile(r"<!--(?:.*?-->|>|->|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
SPACES = re.compile(r"[ \t\n\r\f]+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes datalist audio video canvas svg math object select".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table caption thead tbody tfoot tr td th ul search".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
#: An opening tag closes these, looking no further up than the stops.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "body": ({"head"}, {"html"}),
}
IMPLIED |= {"tbody": IMPLIED["thead"], "tfoot": IMPLIED["thead"]}
#: A closing tag looks no further up than these.
WALLS = frozenset("table td th caption html template".split())


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def tree(html: str) -> Node:
    """The element tree; text nodes are strings with entities resolved."""
    root = Node("#root", {})
    stack, at, size = [root], 0, len(html)
    lower = None
    while at < size:
        m = TOKEN.search(html, at)
        if not m:
            stack[-1].children.append(unescape(html[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(unescape(html[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            _close(stack, tag)
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in WALLS or stack[i].tag == "button":
                    break
        if tag in IMPLIED:
            closes, stops = IMPLIED[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in stops:
                    break
                if stack[i].tag in closes:
                    del stack[i:]
                    if tag in ("li", "option", "dt", "dd", "td", "th", "body"):
                        break
        node = Node(tag, {k.lower(): unescape(a or b or c) for k, a, b, c in ATTR.findall(m[3])} if m[3].strip(" /\n\t") else {})
        stack[-1].children.append(node)
        if tag in RAW:
            lower = html.lower() if lower is None and html.isascii() else lower
            end = lower.find(f"</{tag}", at) if lower else (e.start() if (e := re.compile(f"</{re.escape(tag)}", re.I).search(html, at)) else -1)
            end = size if end < 0 else end
            node.children.append(unescape(html[at:end]) if tag in ("textarea", "title") else html[at:end])
            stop = html.find(">", end)
            at = size if stop < 0 else stop + 1
        elif tag not in VOID:
            stack.append(node)
    return root


def _close(stack: list[Node], tag: str) -> None:
    if tag == "br":
        stack[-1].children.append(Node("br", {}))
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if stack[i].tag in WALLS and tag not in ("table", "tr", "tbody", "thead", "tfoot", "html", "body", "template"):
            break
    if tag == "p":
        stack[-1].children.append(Node("p", {}))


def shown(node: Node) -> bool:
    if node.tag in HIDDEN or "hidden" in node.attrs:
        return False
    style = node.attrs.get("style")
    return not (style and re.search(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", style, re.I))


class Flow:
    """Collects text: pieces of the current line, finished lines, and the gap owed before the next."""

    def __init__(self):
        self.lines, self.line, self.space, self.gap, self.mark, self.indent = [], [], False, 0, "", 0

    def text(self, s: str) -> None:
        if s[:1] in " \t\n\r\f" and self.line:
            self.space = True
        words = SPACES.sub(" ", s).strip(" ")
        if words:
            self.put(words)
            self.space = s[-1] in " \t\n\r\f"

    def put(self, s: str) -> None:
        if not self.line:
            if self.gap and self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0
            self.line.append(" " * self.indent + self.mark)
            self.mark = " " * len(self.mark)
        elif self.space:
            self.line.append(" ")
        self.space = False
        self.line.append(s)

    def brk(self, gap: int) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False
        self.gap = max(self.gap, gap)

    def verbatim(self, lines: list[str]) -> None:
        self.brk(2)
        if self.lines:
            self.lines += [""] * (self.gap - 1)
        self.lines += [" " * self.indent + x for x in lines]
        self.gap = 2


def _width(s: str) -> int:
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def _grid(rows: list[list[list[str]]]) -> list[str]:
    """Rows of cells (lists of lines) as aligned text."""
    n = max((len(r) for r in rows), default=0)
    width = [max((_width(x) for r in rows if c < len(r) for x in r[c]), default=0) for c in range(n)]
    out = []
    for r in rows:
        for k in range(max((len(c) for c in r), default=0)):
            out.append(" | ".join((x := c[k] if k < len(c) else "") + " " * (width[i] - _width(x)) for i, c in enumerate(r)).rstrip())
    return out


def render(html: str) -> str:
    """Visible text of a page. An explicit stack of (node, state) takes the place of recursion."""
    flow = Flow()
    tables: list[tuple] = []  # the flow around, rows of cells (None: nested), the flow of captions and stray text
    lists: list[int | None] = []
    todo: list[tuple[str, object]] = [("open", tree(html))]
    while todo:
        what, x = todo.pop()
        if what == "call":
            flow = x(flow)
            continue
        if isinstance(x, str):
            if what == "pre":
                for i, part in enumerate(x.replace("\r\n", "\n").split("\n")):
                    if i:
                        flow.line.append("") if flow.line else flow.put("")
                        flow.brk(1)
                    if part:
                        flow.put(part)
            else:
                flow.text(x)
            continue
        if not shown(x):
            continue
        tag = x.tag
        kids = [("pre" if what == "pre" or tag in ("pre", "textarea") else "open", c) for c in reversed(x.children)]
        if tag == "br":
            if not flow.line:
                flow.put("")
            flow.brk(1)
        elif tag == "hr":
            flow.verbatim(["---"])
        elif tag == "img":
            if x.attrs.get("alt"):
                flow.text(x.attrs["alt"])
        elif tag == "input":
            if x.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", "email", "url", "tel", "number") and x.attrs.get("value"):
                flow.text(x.attrs["value"])
        elif tag == "table":
            if tables:  # a nested table is text of the cell around it
                flow.brk(1)
                todo.append(("call", lambda f: f.brk(1) or f))
                todo += kids
                tables.append((flow, None, flow))
                todo.insert(len(todo) - len(kids), ("call", lambda f: tables.pop() and f))
            else:
                flow.brk(2)
                tables.append((flow, [], Flow()))
                todo.append(("call", lambda f: _table_end(tables)))
                todo += kids
                flow = tables[-1][2]
        elif tag == "tr" and tables and tables[-1][1] is not None:
            tables[-1][1].append([])
            todo += kids
        elif tag in ("td", "th") and tables and tables[-1][1] is not None:
            if not tables[-1][1]:
                tables[-1][1].append([])
            flow = Flow()
            span = x.attrs.get("colspan", "")
            todo.append(("call", lambda f, n=min(int(span), 100) if span.isascii() and span.isdigit() else 1: _cell_end(f, tables, n)))
            todo += kids
        elif tag == "li":
            flow.brk(1)
            number = lists[-1] if lists else None
            mark = "- "
            if number is not None:
                value = x.attrs.get("value", "")
                number = int(value) if value.isascii() and value.isdigit() else number
                mark, lists[-1] = f"{number}. ", number + 1
            before = flow.indent, flow.mark
            flow.mark = flow.mark + mark if flow.mark.strip() else mark
            todo.append(("call", lambda f, b=before: _item_end(f, b)))
            todo += kids
        elif tag in ("ul", "ol", "menu", "dir"):
            deep = bool(lists)
            flow.brk(1 if deep else 2)
            first = x.attrs.get("start", "")
            lists.append((int(first) if first.isascii() and first.isdigit() else 1) if tag == "ol" else None)
            flow.indent += 2 * deep
            todo.append(("call", lambda f, d=deep: _list_end(f, lists, d)))
            todo += kids
        elif tag in BLOCK:
            gap = 2 if tag in APART else 1
            extra = 2 if tag in ("dd", "blockquote") else 0
            flow.brk(gap)
            flow.indent += extra
            todo.append(("call", lambda f, g=gap, e=extra: _block_end(f, g, e)))
            todo += kids
        else:
            todo += kids
    flow.brk(0)
    return "\n".join(flow.lines).strip("\n")


def _block_end(flow: Flow, gap: int, extra: int) -> Flow:
    flow.brk(gap)
    flow.indent -= extra
    return flow


def _item_end(flow: Flow, before: tuple[int, str]) -> Flow:
    flow.brk(1)
    flow.indent, flow.mark = before
    return flow


def _list_end(flow: Flow, lists: list, deep: bool) -> Flow:
    flow.brk(1 if deep else 2)
    flow.indent -= 2 * deep
    lists.pop()
    return flow


def _cell_end(flow: Flow, tables: list, span: int) -> Flow:
    flow.brk(0)
    tables[-1][1][-1] += [flow.lines or [""], *[[""]] * (span - 1)]
    return tables[-1][2]


def _table_end(tables: list) -> Flow:
    flow, rows, loose = tables.pop()
    loose.brk(0)
    lines = loose.lines + _grid([r for r in rows if r])
    if lines:
        flow.verbatim(lines)
    return flow


def _extract(batches):
    for batch in batches:
        out = [render(x.as_py() or "") for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) -> page_id, url, text, a row per row."""
    ddl = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url {pages.schema['url'].dataType.simpleString()}, text string"
    return pages.select("page_id", "url", "html").mapInArrow(_extract, ddl)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
