"""Layout-aware rendering of HTML as plain text.

A page goes through three steps. `tokens` cuts the markup into tags and texts. `build` makes a tree of
them: html, head and body are implied, and so are table bodies and rows; start tags close what cannot
hold them (an open paragraph, list item, cell, ...); end tags without a start are ignored. `render`
writes what a reader sees: blocks on lines of their own with blank lines around paragraphs, headings and
lists; list marks and indents; preformatted text as it is; tables with aligned columns.

Visibility: scripts, styles, templates, the head, fallbacks of embedded media, elements with `hidden`,
closed dialogs, closed details but for their summary, and elements that an inline style or a simple rule of a style sheet (a tag, class, id, or
a tag with a class) takes out by `display: none` or `visibility: hidden`, unless a rule that weighs more
shows them. Style sheets and blocks of @media count if they always hold on a wide screen (all, or screen
without further conditions). A visible child of an element with `visibility: hidden` is shown.
Values of text inputs and buttons count as text, as a reader sees them; alternative texts of images don't.

An end tag of a formatting element (b, i, a, ...) that is open around a block ends the formatting only: the
block moves out of it and stays open, with what it holds so far in a copy of the element.

Defined cases: a null or empty page gives an empty text; a page without tags is its text; markup that is
cut off in a tag loses that tag only; elements deeper than ``DEEPEST`` become siblings, as browsers do;
cells longer than ``WIDEST`` signs don't widen their column, but stay whole; rows that repeat an id give
a row each; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

DEEPEST = 400
WIDEST = 60

# The element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta title style script template noscript".split())
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes audio video canvas object datalist base link meta param source track col colgroup area rp".split())
BLOCKS = frozenset("address article aside blockquote body center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary table ul xmp caption tr tbody thead tfoot".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 listing menu ol p pre table ul xmp hr dir".split())
CLOSE_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p pre search section summary table ul xmp".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
PRE = frozenset(("pre", "listing", "xmp", "textarea"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# What a start tag closes, and the elements at which the search for it ends.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th", "body"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th", "body"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th", "body"}),
    "option": ({"option"}, {"select", "datalist", "optgroup", "body"}),
    "optgroup": ({"option", "optgroup"}, {"select", "body"}),
    "rt": ({"rt", "rp"}, {"ruby", "body"}),
    "rp": ({"rt", "rp"}, {"ruby", "body"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "body"}),
    "td": ({"td", "th", "caption"}, {"tr", "table", "body"}),
    "th": ({"td", "th", "caption"}, {"tr", "table", "body"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table", "body"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table", "body"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table", "body"}),
}
SCOPES = frozenset(("table", "td", "th", "caption", "html", "body", "template", "object"))

MARKUP = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][^\s/>]*))")
#: "<!-->" and "<!--->" are whole comments.
SHORT_COMMENT = re.compile(r"-?>")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"""[\s/]*(?:(>)|([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*))?)?|=)""")
#: Values that show count as well, as a later one undoes an earlier `none`; others are invalid and set nothing.
DISPLAY = r"none|block|inline(?:-[a-z]+)?|flex|grid|table(?:-[a-z-]+)?|list-item|contents|flow-root|run-in|ruby(?:-[a-z]+)?|-webkit-(?:inline-)?(?:box|flex)|initial|inherit|unset|revert(?:-layer)?"
VISIBILITY = r"hidden|collapse|visible|initial|inherit|unset|revert(?:-layer)?"
HIDING = re.compile(rf"(?:^|;)\s*(?:(display)\s*:\s*({DISPLAY})|(visibility)\s*:\s*({VISIBILITY}))\s*(!\s*important)?\s*(?=;|$)", re.I)
#: Braces and semicolons of style sheets; those in texts are none.
BRACE = re.compile(r"""[{};]|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""", re.S)
#: Media that a wide screen always is.
SCREEN = re.compile(r"(?:only\s+)?(?:all|screen)|not\s+(?:print|speech)", re.I)
SELECTOR = re.compile(r"([A-Za-z][\w-]*)?(?:([.#])([\w-]+))?")
BLANKS = re.compile(r"[ \t\n\r\f]+")


def tokens(page: str) -> Iterator[tuple[str, str, dict]]:
    """("text", text, {}), ("start", tag, attributes) and ("end", tag, {}) in the order of the page."""
    at, size = 0, len(page)
    lower = None
    while at < size:
        m = MARKUP.search(page, at)
        if m is None:
            yield "text", html.unescape(page[at:]), {}
            return
        if m.start() > at:
            yield "text", html.unescape(page[at : m.start()]), {}
        comment, other, end, tag = m.groups()
        if comment:
            stop = SHORT_COMMENT.match(page, m.end()) or COMMENT_END.search(page, m.end())
            at = stop.end() if stop else size
            continue
        if other:
            at = page.find(">", m.end()) + 1 or size
            continue
        attributes: dict[str, str] = {}
        pos, closed = m.end(), False
        while (a := ATTRIBUTE.match(page, pos)) and a.end() > pos:
            pos = a.end()
            if a[1]:
                closed = True
                break
            if a[2]:
                attributes.setdefault(a[2].lower(), html.unescape(next((x for x in a.groups()[2:] if x is not None), "")))
        if not closed:
            # A quote that never ends, or the end of the page: the tag ends at the next ">".
            pos = page.find(">", pos) + 1
            if not pos:
                return
        at, tag = pos, tag.lower()
        if end:
            yield "end", tag, {}
            continue
        yield "start", tag, attributes
        if tag == "plaintext":
            yield "text", page[at:], {}
            return
        if tag in RAW:
            lower = page.lower() if lower is None else lower
            if len(lower) != size:  # signs whose lower case is longer: search without it
                stop = re.compile(f"</{tag}", re.I).search(page, at)
                close = stop.start() if stop else -1
            else:
                close = lower.find(f"</{tag}", at)
            close = size if close < 0 else close
            text = page[at:close]
            if text:
                yield "text", html.unescape(text) if tag in ("textarea", "title") else text, {}
            yield "end", tag, {}
            at = page.find(">", close) + 1 or size


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None, children: list | None = None) -> None:
        self.tag, self.attributes, self.children = tag, attributes or {}, children or []


class Builder:
    """The tree of a page; `open` are the elements not closed yet, from html on."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.head, self.body = Node("head"), Node("body")
        self.root.children = [self.head, self.body]
        self.in_head = True
        self.open = [self.root, self.head]
        self.styles: list[str] = []

    def enter_body(self) -> None:
        self.in_head = False
        self.open = [self.root, self.body]

    def add(self, node: Node, stays_open: bool) -> None:
        if stays_open and len(self.open) >= DEEPEST:
            self.open.pop()
        self.open[-1].children.append(node)
        if stays_open:
            self.open.append(node)

    def text(self, text: str) -> None:
        top = self.open[-1].tag
        if self.in_head and len(self.open) == 2:
            if not text.strip(" \t\n\r\f"):
                return
            self.enter_body()
        if top == "style" and on_screen(self.open[-1].attributes.get("media", "")):
            self.styles.append(text)
        if top in ("table", "tbody", "thead", "tfoot", "tr") and not text.strip(" \t\n\r\f"):
            return
        self.open[-1].children.append(text)

    def close_to(self, at: int) -> None:
        del self.open[max(at, 2) :]

    def close_implied(self, tag: str) -> None:
        ends, limit = IMPLIED_ENDS[tag]
        low = None
        for i in range(len(self.open) - 1, 1, -1):
            if self.open[i].tag in ends:
                low = i
            elif self.open[i].tag in limit:
                break
        if low is not None:
            self.close_to(low)

    def close_paragraph(self) -> None:
        for i in range(len(self.open) - 1, 1, -1):
            if self.open[i].tag == "p":
                return self.close_to(i)
            if self.open[i].tag in SCOPES or self.open[i].tag == "button":
                return None
        return None

    def inside(self, *tags: str) -> bool:
        """Whether one of the tags is open within the innermost table."""
        for node in reversed(self.open):
            if node.tag in tags:
                return True
            if node.tag == "table":
                return False
        return False

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag == "html":
            for k, v in attributes.items():
                self.root.attributes.setdefault(k, v)
            return
        if tag == "head":
            return
        if tag == "body":
            if self.in_head:
                self.enter_body()
            for k, v in attributes.items():
                self.body.attributes.setdefault(k, v)
            return
        if self.in_head:
            if tag in HEAD_ONLY:
                if tag not in VOID:
                    self.add(Node(tag, attributes), True)
                return
            if len(self.open) == 2 or self.open[2].tag != "template":
                self.enter_body()
        if tag in CLOSE_P:
            self.close_paragraph()
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.open.pop()
        if tag in IMPLIED_ENDS:
            self.close_implied(tag)
        if any(x.tag == "table" for x in self.open):
            if tag in ("td", "th"):
                if not self.inside("tbody", "thead", "tfoot"):
                    self.add(Node("tbody"), True)
                if not self.inside("tr"):
                    self.add(Node("tr"), True)
            elif tag == "tr" and not self.inside("tbody", "thead", "tfoot"):
                self.add(Node("tbody"), True)
        elif tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup", "col"):
            return  # parts of a table outside of any: only their content counts
        self.add(Node(tag, attributes), tag not in VOID)

    def end(self, tag: str) -> None:
        if tag == "head":
            if self.in_head:
                self.enter_body()
            return
        if tag in ("body", "html") or tag in VOID - {"br"}:
            return
        if tag == "br":
            return self.start("br", {})
        if tag == "p" and not any(x.tag == "p" for x in self.open[2:]):
            if self.in_head:
                self.enter_body()
            self.add(Node("p"), False)
            return
        if tag in FORMATTING:
            return self.end_formatting(tag)
        for i in range(len(self.open) - 1, 1, -1):
            own = self.open[i].tag
            if own == tag or (tag in HEADINGS and own in HEADINGS):
                return self.close_to(i)
            # An end tag within a cell doesn't close what stands around the table.
            if own in ("td", "th", "caption") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return
            if own == "table":
                return


    def end_formatting(self, tag: str) -> None:
        """Close a formatting element; blocks opened within it move out of it and stay open."""
        at = None
        for i in range(len(self.open) - 1, 1, -1):
            if self.open[i].tag == tag:
                at = i
                break
            if self.open[i].tag in SCOPES:
                return
        if at is None:
            return
        while (j := next((k for k in range(at + 1, len(self.open)) if self.open[k].tag in BLOCKS), None)) is not None:
            block, held = self.open[j], self.open[j - 1].children
            if not (held and held[-1] is block):
                del self.open[at]  # elements this deep were made siblings
                return
            held.pop()
            self.open[at - 1].children.append(block)
            copy = Node(tag, self.open[at].attributes)
            copy.children, block.children = block.children, [copy]
            self.open[at : j + 1] = [block, copy]
            at += 1
        self.close_to(at)


def build(page: str) -> tuple[Node, list[str]]:
    """The tree of a page, and the texts of its style sheets."""
    builder = Builder()
    for kind, value, attributes in tokens(page):
        if kind == "text":
            builder.text(value)
        elif kind == "start":
            builder.start(value, attributes)
        else:
            builder.end(value)
    return builder.root, builder.styles


def declared(body: str) -> dict[str, tuple[bool, str]]:
    """The display and visibility that declarations set, with whether they are important; later ones win."""
    found: dict[str, tuple[bool, str]] = {}
    for display, shape, _, state, weight in HIDING.findall(body):
        name = "display" if display else "visibility"
        if weight or not found.get(name, (False, ""))[0]:
            found[name] = (bool(weight), (shape or state).lower())
    return found


def on_screen(query: str) -> bool:
    """Whether one of a list of media queries always holds on a wide screen."""
    return not query.strip() or any(SCREEN.fullmatch(x.strip()) for x in query.split(","))


def holds(head: str) -> bool:
    """Whether the rules in an at-rule's block hold: those of @media for screens, @layer and @supports."""
    m = re.match(r"@([\w-]+)(.*)", head, re.S)
    name, rest = (m[1].lower(), m[2]) if m else ("", "")
    return on_screen(rest) if name == "media" else name == "layer" or (name == "supports" and not re.match(r"\s*not\b", rest, re.I))


def style_rules(sheet: str) -> Iterator[tuple[str, str]]:
    """Selectors and declarations of the rules of a style sheet that hold on a wide screen."""
    sheet = re.sub(r"/\*.*?\*/", "", sheet, flags=re.S)
    groups: list[bool] = []  # of the open at-rules, whether they and all around them hold
    head, depth, start = "", 0, 0  # of the open rule: its selectors, its blocks, its body
    for m in BRACE.finditer(sheet):
        if m[0] == "{":
            if depth:
                depth += 1
                continue
            head = sheet[start : m.start()].strip()
            start = m.end()
            if head.startswith("@"):
                groups.append(holds(head) and all(groups[-1:]))
            else:
                depth = 1
        elif m[0] == "}":
            if depth:
                depth -= 1
                if depth:
                    continue
                if all(groups[-1:]):
                    yield head, sheet[start : m.start()]
            elif groups:
                groups.pop()
            start = m.end()
        elif m[0] == ";" and not depth:
            start = m.end()


class Rules:
    """Simple selectors of style sheets that set display or visibility.

    Of several that match, the important, then the most specific, then the last counts, as in browsers.
    """

    def __init__(self, sheets: list[str]) -> None:
        self.by: dict[tuple[str, str, str], dict[str, tuple]] = {}
        for at, (selectors, body) in enumerate(x for sheet in sheets for x in style_rules(sheet)):
            found = declared(body)
            for selector in selectors.split(",") if found else ():
                m = SELECTOR.fullmatch(selector.strip())
                if m and m[0]:
                    own = self.by.setdefault(((m[1] or "").lower(), m[2] or "", m[3] or ""), {})
                    rank = (m[2] == "#", m[2] == ".", bool(m[1]), at)
                    for name, (weight, value) in found.items():
                        own[name] = max(own.get(name, ((),)), ((weight, False, *rank), value))

    def of(self, node: Node) -> dict[str, str]:
        found: dict[str, tuple] = {}
        if self.by:
            keys = [("", "")]
            keys += [(".", c) for c in node.attributes.get("class", "").split()]
            if "id" in node.attributes:
                keys.append(("#", node.attributes["id"]))
            for sign, name in keys:
                for tag in ("", node.tag):
                    for k, v in self.by.get((tag, sign, name), {}).items():
                        found[k] = max(found.get(k, ((),)), v)
        if "style" in node.attributes:
            for k, (weight, value) in declared(node.attributes["style"]).items():
                found[k] = max(found.get(k, ((),)), ((weight, True), value))
        return {k: v[1] for k, v in found.items()}


def width(text: str) -> int:
    """Columns that a text takes: wide East Asian signs two, combining signs none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def roman(n: int) -> str:
    out = ""
    for sign, value in zip("m cm d cd c xc l xl x ix v iv i".split(), (1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), strict=True):
        out += sign * (n // value)
        n %= value
    return out


def letters(n: int) -> str:
    out = ""
    while n > 0:
        n, rest = divmod(n - 1, 26)
        out = chr(97 + rest) + out
    return out


def number(text: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", text or "")
    return int(m[1]) if m else default


def mark(n: int, kind: str) -> str:
    if kind in "aA" and n > 0:
        text = letters(n)
    elif kind in "iI" and 0 < n < 4000:
        text = roman(n)
    else:
        return f"{n}. "
    return (text.upper() if kind.isupper() else text) + ". "


class Writer:
    """Lines of text; blank lines between blocks collapse."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0

    def words(self, text: str) -> None:
        parts = BLANKS.split(text)
        if not parts[0] and self.line:
            self.space = True
        body = " ".join(x for x in parts if x)
        if body:
            if self.space and self.line:
                self.line.append(" ")
            self.line.append(body)
            self.space = len(parts) > 1 and not parts[-1]

    def exact(self, text: str) -> None:
        first, *rest = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if first:
            self.line.append(first)
        for x in rest:
            self.newline()
            if x:
                self.line.append(x)

    def newline(self) -> None:
        """End the line, empty or not."""
        self.open_gap()
        self.lines.append("".join(self.line).rstrip(" "))
        self.line, self.space = [], False

    def open_gap(self) -> None:
        if self.gap and self.lines:
            self.lines += [""] * (self.gap - 1)
        self.gap = 0

    def block(self, gap: int = 1) -> None:
        """End the line if it holds anything; the next text begins ``gap`` lines on."""
        if self.line:
            self.newline()
        self.space = False
        self.gap = max(self.gap, gap)

    def put(self, lines: list[str], first: str = "", other: str = "") -> None:
        """Whole lines, with a prefix for the first and one for the others."""
        if lines:
            self.open_gap()
            self.lines += [(first if i == 0 else other) + x if x or i == 0 else other.rstrip() for i, x in enumerate(lines)]

    def done(self) -> list[str]:
        if self.line:
            self.newline()
        return self.lines


class Renderer:
    def __init__(self, styles: list[str]) -> None:
        self.rules = Rules(styles)

    def lines(self, node: Node, seen: bool, pre: bool, depth: int) -> list[str]:
        out = Writer()
        self.content(node, out, seen, pre, depth)
        return out.done()

    def content(self, node: Node, out: Writer, seen: bool, pre: bool, depth: int) -> None:
        for child in node.children:
            if isinstance(child, str):
                if seen:
                    out.exact(child) if pre else out.words(child)
            else:
                self.element(child, out, seen, pre, depth)

    def shown(self, node: Node, seen: bool) -> bool | None:
        """None: nothing of it is laid out; else whether its own text is visible."""
        if node.tag in UNSEEN or "hidden" in node.attributes or (node.tag == "dialog" and "open" not in node.attributes):
            return None
        if not self.rules.by and "style" not in node.attributes:
            return seen
        rules = self.rules.of(node)
        if rules.get("display") == "none":
            return None
        state = rules.get("visibility")
        return False if state in ("hidden", "collapse") else True if state in ("visible", "initial") else seen

    def element(self, node: Node, out: Writer, seen: bool, pre: bool, depth: int) -> None:
        seen = self.shown(node, seen)
        if seen is None:
            return
        tag = node.tag
        if tag == "br":
            if out.line:
                out.newline()
            else:
                out.gap = 2
            return
        if tag == "input":
            if seen and node.attributes.get("type", "text").lower() not in ("hidden", "password", "checkbox", "radio"):
                out.words(f" {node.attributes.get('value', '')} ")
            return
        if tag == "table":
            out.block(2)
            self.table(node, out, seen, depth)
            out.block(2)
            return
        if tag not in BLOCKS:
            if tag in ("td", "th"):
                out.words(" ")
            self.content(node, out, seen, pre or tag in PRE, depth)
            return
        if tag == "details" and "open" not in node.attributes:
            node = Node(tag, node.attributes, [x for x in node.children if not isinstance(x, str) and x.tag == "summary"][:1])
        gap = 2 if tag in SPACED and not (depth and tag in ("ul", "ol", "menu", "dir")) else 1
        out.block(gap)
        if tag in ("ul", "ol", "menu", "dir"):
            self.list(node, out, seen, depth)
        elif tag == "blockquote":
            out.put(self.lines(node, seen, False, depth), "> ", "> ")
        elif tag == "dd":
            out.put(self.lines(node, seen, pre, depth), "    ", "    ")
        elif tag == "li":
            out.put(self.lines(node, seen, pre, depth + 1), "- ", "  ")
        elif tag in PRE:
            text = self.lines(node, seen, True, depth)
            out.put(text[1:] if text and not text[0] else text)
        else:
            self.content(node, out, seen, pre, depth)
        out.block(gap)

    def list(self, node: Node, out: Writer, seen: bool, depth: int) -> None:
        ordered = node.tag == "ol"
        items = sum(not isinstance(x, str) and x.tag == "li" for x in node.children)
        step = -1 if "reversed" in node.attributes else 1
        at = number(node.attributes.get("start"), items if step < 0 else 1)
        kind = node.attributes.get("type", "1")
        for child in node.children:
            if isinstance(child, str):
                if seen:
                    out.words(child)
            elif child.tag == "li":
                own = self.shown(child, seen)
                if own is None:
                    continue
                at = number(child.attributes.get("value"), at)
                sign = mark(at, kind) if ordered else "- "
                at += step
                out.block(1)
                out.put(self.lines(child, own, False, depth + 1), sign, " " * len(sign))
                out.block(1)
            else:
                self.element(child, out, seen, False, depth + 1)

    def table(self, node: Node, out: Writer, seen: bool, depth: int) -> None:
        """Rows with aligned columns; a cell that spans columns widens none of them."""
        rows: list[list[tuple[int, int, list[str]]]] = []
        after: list[list[str]] = []
        covered: dict[int, int] = {}

        def row(tr: Node, seen: bool) -> None:
            cells, column = [], 0
            for cell in tr.children:
                if isinstance(cell, str) or cell.tag not in ("td", "th"):
                    # Text that stands between cells is shown before the table.
                    holder = Node("div")
                    holder.children = [cell]
                    out.put(self.lines(holder, seen, False, depth))
                    out.block(1)
                    continue
                own = self.shown(cell, seen)
                if own is None:
                    continue
                while covered.get(column, 0) > 0:
                    column += 1
                wide = min(1000, max(1, number(cell.attributes.get("colspan"), 1)))
                high = min(65534, max(1, number(cell.attributes.get("rowspan"), 1)))
                cells.append((column, wide, self.lines(cell, own, False, 0)))
                if high > 1:
                    for c in range(column, column + wide):
                        covered[c] = max(covered.get(c, 0), high)
                column += wide
            for c in list(covered):
                covered[c] -= 1
                if covered[c] <= 0:
                    del covered[c]
            if any(x[2] for x in cells):
                rows.append(cells)

        def part(node: Node, seen: bool) -> None:
            for child in node.children:
                if isinstance(child, str):
                    if seen:
                        out.words(child)
                    continue
                own = self.shown(child, seen)
                if own is None:
                    continue
                if child.tag == "tr":
                    row(child, own)
                elif child.tag == "tfoot":
                    after.append(child)
                elif child.tag in ("tbody", "thead"):
                    part(child, own)
                elif child.tag == "caption":
                    out.put(self.lines(child, own, False, depth))
                    out.block(1)
                else:
                    self.element(child, out, seen, False, depth)

        part(node, seen)
        for foot in after:
            part(foot, seen)
        out.block(1)
        widths: dict[int, int] = {}
        for cells in rows:
            for column, wide, lines in cells:
                fits = [w for x in lines if (w := width(x)) <= WIDEST] if wide == 1 else []
                widths[column] = max([widths.get(column, 0), *fits])
        columns = sorted(widths)
        place = {}
        at = 0
        for c in columns:
            place[c] = at
            at += widths[c] + 2
        for cells in rows:
            lines = []
            for i in range(max(len(x[2]) for x in cells)):
                line, used = "", 0
                for column, _, own in cells:
                    if i < len(own) and own[i]:
                        pad = place[column] - used if not line else max(2, place[column] - used)
                        line += " " * max(0, pad) + own[i]
                        used += max(0, pad) + width(own[i])
                lines.append(line)
            out.put(lines)
            out.gap = 1


def page_text(page: str | None) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    if sys.getrecursionlimit() < 12 * DEEPEST:
        sys.setrecursionlimit(12 * DEEPEST)
    root, styles = build(page.replace("\0", "�"))
    lines = Renderer(styles).lines(root, True, False, 0)
    while lines and not lines[0]:
        lines.pop(0)
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


def html_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The id, text (its visible text), n_chars and n_lines: one row for each row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "html"):
            texts = [page_text(x) for x in batch.column("html").to_pylist()]
            yield pa.record_batch(
                [batch.column("id"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), pa.array([x.count("\n") + bool(x) for x in texts], pa.int64())],
                ["id", "text", "n_chars", "n_lines"],
            )

    kind = pages.schema[id_col].dataType.simpleString()
    found = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(run, f"id {kind}, text string, n_chars long, n_lines long")
    return found.select(F.col("id").alias(id_col), "text", "n_chars", "n_lines")
