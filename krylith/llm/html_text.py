"""Visible text of HTML pages by layout-aware rendering.

A tree builder reads tags, supplies implied ones (a new block ends an open paragraph, an item ends
the item before it, cells and rows end each other, unclosed elements end with their parent) and
keeps what visibility rules show. The renderer walks the tree without recursion: blocks go on
lines of their own with blank lines between paragraphs, lists have markers and indents,
preformatted text keeps its white space, and the cells of a table are aligned in columns.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")
#: Element groups of the HTML standard (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template iframe noembed noframes object audio video canvas svg math datalist select option textarea colgroup".split())
BLOCK = frozenset("address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul caption tr td th thead tbody tfoot".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure fieldset".split())
#: What a start tag ends if it is open, and where the search for it stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
}
#: An end tag or an implied end looks no further up than these.
WALLS = frozenset("td th table caption button body html".split())


class Node:
    __slots__ = ("tag", "hidden", "start", "children")

    def __init__(self, tag: str, hidden: bool = False, start: int = 1):
        self.tag, self.hidden, self.start, self.children = tag, hidden, start, []


def attributes(text: str) -> dict[str, str]:
    found = {}
    for name, value in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(value[1:].removesuffix(value[0]) if value[:1] in ("'", '"') else value))
    return found


def tree(source: str) -> Node:
    """The element tree of a page; html, head and body tags only mark what is hidden."""
    root = Node("html")
    stack, at = [root], 0
    opened: Counter[str] = Counter()

    def pop() -> None:
        opened[stack.pop().tag] -= 1

    def close(names, walls) -> None:
        if not any(opened[n] for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                while len(stack) > i:
                    pop()
                return
            if stack[i].tag in walls:
                return

    while at < len(source):
        match = TOKEN.search(source, at)
        text = source[at : match.start() if match else len(source)]
        if text:
            if stack[-1].tag == "head" and not text.isspace():
                pop()
            stack[-1].children.append(html.unescape(text) if "&" in text else text)
        if not match:
            break
        at, name = match.end(), (match[2] or "").lower()
        if not name:
            if match[0].startswith("<![CDATA["):
                stack[-1].children.append(match[0][9:].removesuffix("]]>"))
            continue
        if match[1]:
            if name == "p" and not opened["p"]:
                stack[-1].children.append(Node("p"))
            elif name == "br":
                stack[-1].children.append(Node("br"))
            elif name in ("table", "body", "html"):
                close({name}, ())
            elif name in ("tr", "thead", "tbody", "tfoot", "td", "th", "caption"):
                close({name}, {"table"})
            else:
                close({name}, WALLS)
            continue
        known = attributes(match[3]) if match[3].strip(" \t\r\n/") else {}
        if name in ("html", "body"):
            if name == "body":
                close({"head"}, ())
                root.hidden |= "hidden" in known or bool(HIDING.search(known.get("style", "")))
            continue
        if stack[-1].tag == "head" and name not in ("base", "link", "meta", "noscript", "script", "style", "template", "title"):
            pop()
        if name in ENDS:
            close(*ENDS[name])
        if name in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr")
            stack[-1].children.append(row)
            stack.append(row)
            opened["tr"] += 1
        elif name in BLOCK and stack[-1].tag not in ("pre",):
            close({"p"}, WALLS)
        hidden = name in UNSEEN or "hidden" in known or name == "dialog" and "open" not in known or bool(HIDING.search(known.get("style", "")))
        start = known.get("start", "")
        node = Node(name, hidden, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1)
        stack[-1].children.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b", re.I).search(source, at)
            stop = end.start() if end else len(source)
            node.children.append(source[at:stop])
            at = (source.find(">", stop) + 1 or len(source)) if end else stop
        elif name not in VOID:
            stack.append(node)
            opened[name] += 1
    return root


class Flow:
    """Lines of one column of text."""

    def __init__(self):
        self.lines, self.now, self.gap, self.indent, self.marker, self.space = [], [], 0, "", "", False

    def text(self, text: str, pre: bool) -> None:
        if pre:
            for i, part in enumerate(text.split("\n")):
                if i:
                    self.end(True)
                if part:
                    self.now.append(part)
            return
        words = SPACES.sub(" ", text)
        if words.startswith(" "):
            self.space, words = bool(self.now) or self.space, words[1:]
        if words:
            if self.space and self.now:
                self.now.append(" ")
            self.space = words.endswith(" ")
            self.now.append(words.rstrip(" "))

    def end(self, even_empty: bool = False) -> None:
        """Ends the line, if there is one."""
        line, self.now, self.space = "".join(self.now), [], False
        if line or even_empty:
            if self.lines and self.gap:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            self.lines.append((self.indent + self.marker + line) if line else "")
            if line and self.marker:
                self.indent, self.marker = self.indent + " " * len(self.marker), ""

    def block(self, gap: int) -> None:
        self.end()
        self.gap = max(self.gap, gap)


def aligned(rows: list[list[list[str]]]) -> list[str]:
    """The lines of a table whose cells are lists of lines."""
    width = [0] * max((len(r) for r in rows), default=0)
    for row in rows:
        for i, cell in enumerate(row):
            width[i] = max([width[i], *map(len, cell)])
    return [
        "  ".join((cell[k] if k < len(cell) else "").ljust(width[i]) for i, cell in enumerate(row)).rstrip()
        for row in rows
        for k in range(max(map(len, row), default=0))
    ]


def visible_text(source: str | None) -> str:
    """All visible text of a page; empty for null. Never raises: what isn't a tag is text."""
    if not source:
        return ""
    flows, tables, lists = [Flow()], [], []
    pre = 0
    walk: list[tuple[Node | str, bool]] = [(tree(source), True)]
    saved: list[tuple[str, str]] = []
    while walk:
        node, enter = walk.pop()
        flow = flows[-1]
        if isinstance(node, str):
            flow.text(node, pre > 0)
            continue
        tag = node.tag
        if enter:
            if node.hidden:
                continue
            if tag == "br":
                flow.end(True)
                continue
            if tag == "hr":
                flow.block(1)
                continue
            walk.append((node, False))
            walk.extend((c, True) for c in reversed(node.children))
            if tag in BLOCK:
                flow.block(1 if tag in APART and not (tag in ("ul", "ol") and lists) else 0)
            if tag == "pre":
                pre += 1
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                flows.append(Flow())
            elif tag in ("ul", "ol", "menu"):
                lists.append(node.start if tag == "ol" else None)
            elif tag == "li":
                saved.append((flow.indent, flow.marker))
                flow.marker = flow.marker + ("- " if not lists or lists[-1] is None else f"{lists[-1]}. ")
                if lists and lists[-1] is not None:
                    lists[-1] += 1
            elif tag in ("dd", "blockquote"):
                saved.append((flow.indent, flow.marker))
                flow.indent += "  "
            continue
        if tag == "pre":
            pre -= 1
        if tag in ("td", "th") and tables:
            flow.block(0)
            flows.pop()
            tables[-1][-1].append(flow.lines)
            continue
        if tag in BLOCK:
            flow.block(1 if tag in APART and not (tag in ("ul", "ol") and len(lists) > 1) else 0)
        if tag == "table":
            for line in aligned(tables.pop()):
                flow.now.append(line)
                flow.end(True)
            flow.block(1)
        elif tag in ("ul", "ol", "menu"):
            lists.pop()
        elif tag in ("li", "dd", "blockquote"):
            flow.indent, flow.marker = saved.pop()
    flows[0].end()
    return "\n".join(flows[0].lines).strip("\n")


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id and text.

    Null and empty pages give empty text; a page without tags is one run of text. Repeated rows are
    kept; other columns are dropped; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([visible_text(x) for x in batch.column(1).to_pylist()], pa.string())], ["page_id", "text"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, text string")
