"""Layout-aware text of HTML pages.

A small tree builder (implied end tags, void and raw-text elements, stray end tags ignored) is followed by a
renderer that emits every visible text: blocks on lines of their own with blank lines where browsers leave
space, list markers with indents, preformatted text as it is, table cells aligned in columns. Hidden are
scripts, styles, head matter, fallbacks, closed details and dialogs, the ``hidden`` attribute, and
``display:none`` or ``visibility:hidden`` by style attribute or by rules of the page's own style sheets that
hold on every screen, where no stronger rule shows it again (``cascade``): rules for print or under conditions (widths, preferences) hide nothing. Of drawings the text
elements are emitted, each on lines of its own; definitions and what ``use`` repeats of them are not.

Pages are independent: one pass, no shuffle, memory bounded by a page. Elements nested deeper than
``MAX_DEPTH`` are laid out at that depth; columns wider than ``MAX_COLUMN`` are not padded, so that padding
stays small. Nothing is cut.

Defined results: null, empty and invisible pages give the empty text; repeated rows are rendered alike; an
empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from affinis.llm.cascade import Sheet, declarations

MAX_DEPTH = 150
MAX_COLUMN = 60
MAX_SPAN = 100

# Element lists of the public HTML rules. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset(
    "head title script style template noscript iframe noembed noframes object audio video canvas datalist base link meta param "
    "source track area rp".split())
#: Blocks with a blank line around them, and blocks on lines of their own.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset hr menu".split())
BLOCKS = SPACED | frozenset(
    "html body div article section nav aside header footer main address center form li dt dd tr caption thead tbody tfoot td th "
    "figcaption details summary dialog legend hgroup search option optgroup select textarea".split())
#: What a start tag ends, up to the elements that bound the search.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    **{x: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}) for x in ("thead", "tbody", "tfoot")},
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: Start tags that end an open paragraph.
ENDS_P = (BLOCKS | {"hr"}) - {"html", "body", "li", "dt", "dd", "tr", "td", "th", "caption", "thead", "tbody", "tfoot", "option", "optgroup", "select", "textarea", "legend"}
#: What a drawing holds without drawing it, and the elements that end a drawing left open.
UNDRAWN = frozenset("defs symbol clippath mask pattern marker lineargradient radialgradient filter metadata desc title".split())
ENDS_SVG = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby "
    "s small span strong strike sub sup table tt u ul var".split())
HEAD_ONLY = frozenset("head title meta link base style script template noscript".split())

START = re.compile(r"<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
END = re.compile(r"</([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
#: What a style sheet is cut at: comments, strings, addresses and escapes are passed over as wholes.
CSS = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*+\"?|'(?:[^'\\\n]|\\.)*+'?|\b[uU][rR][lL]\([^\"'()]*\)|\\.|[{};]", re.S)
MEDIUM = re.compile(r"(?:only\s+)?(?:all|screen)|not\s+(?!(?:all|screen|only|not)$)[a-z-]+")
SPACE = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], None


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def build(html: str) -> Node:
    root = Node("#root", {})
    stack = [root]
    drawings = False

    def drawing() -> int:
        """Where the drawing begins whose elements are read, or 0."""
        for i in range(len(stack) - 1 if drawings else 0, 0, -1):
            if stack[i].tag in ("svg", "foreignobject"):
                return i if stack[i].tag == "svg" else 0
        return 0

    def close(tags: set[str], bounds: set[str]) -> None:
        """End the outermost of ``tags`` that is open within ``bounds``."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in bounds:
                i += 1
                break
        else:
            i = 1
        for k in range(i, len(stack)):
            if stack[k].tag in tags:
                del stack[k:]
                return

    def add_text(text: str) -> None:
        if stack[-1].tag == "head" and text.strip():
            stack.pop()
        stack[-1].children.append(text)

    at = 0
    while at < len(html):
        open_at = html.find("<", at)
        if open_at != at:
            add_text(unescape(html[at: open_at if open_at >= 0 else len(html)]))
            if open_at < 0:
                break
        tag_end, start, end = html.find(">", open_at), None, None
        if html.startswith("<!--", open_at):
            tag_end = html.find("-->", open_at + 2 if html.startswith(("<!-->", "<!--->"), open_at) else open_at + 4)
            at = len(html) if tag_end < 0 else tag_end + 3
            continue
        if html[open_at + 1: open_at + 2] in ("!", "?"):
            at = len(html) if tag_end < 0 else tag_end + 1
            continue
        if found := END.match(html, open_at):
            end = found[1]
        elif html[open_at + 1: open_at + 2].isalpha() and html[open_at + 1].isascii():
            found = START.match(html, open_at)
            if found:
                tag_end = found.end() - 1
                start, rest = found.groups()
            elif tag_end >= 0:  # quotes that never close: the tag ends at the next bracket
                start, _, rest = html[open_at + 1: tag_end].replace("/", " ").partition(" ")
                start = start.split()[0]
        else:
            add_text("<")
            at = open_at + 1
            continue
        if tag_end < 0:  # a tag cut off by the end of the page
            break
        at = tag_end + 1
        if end:
            end = end.lower()
            if end == "p" and not any(n.tag == "p" for n in stack):
                stack[-1].children.append(Node("p", {}))
            elif end == "br":
                stack[-1].children.append(Node("br", {}))
            else:
                bounds = {"td", "th", "table"} if end not in ("table", "tr", "td", "th", "thead", "tbody", "tfoot") else {"table"} - {end}
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == end:
                        del stack[i:]
                        break
                    if stack[i].tag in bounds:
                        break
        elif start:
            tag = start.lower()
            if stack[-1].tag == "head" and tag not in HEAD_ONLY:
                stack.pop()
            drawn = drawing()
            if drawn and tag in ENDS_SVG:
                del stack[drawn:]
                drawn = 0
            drawings |= tag == "svg"
            if tag in ENDS_P:
                close({"p"}, {"td", "th", "table", "button", "li", "dd"})
            if tag in ENDS:
                close(*ENDS[tag])
            node = Node(tag, _attributes(rest) if rest.strip(" \t\n/") else {})
            stack[-1].children.append(node)
            if (drawn or tag in ("svg", "path")) and rest.rstrip().endswith("/"):
                continue
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                text = html[at: stop.start() if stop else len(html)]
                node.children.append(unescape(text) if tag in ("textarea", "title") else text)
                at = stop.end() if stop else len(html)
            # A drawing leaves room for the elements that hold its text.
            elif tag not in VOID and len(stack) < MAX_DEPTH - (2 if tag == "svg" else 1 if drawn and tag not in ("text", "foreignobject") else 0):
                stack.append(node)
    return root


def _plain(style: str) -> str:
    """A style attribute without comments and strings."""
    return CSS.sub(lambda m: m[0] if m[0] in "{};" else "" if m[0].startswith("/*") else '""', style)


def _any_screen(media: str) -> bool:
    """Whether a list of media holds on every screen."""
    return not media.strip() or any(MEDIUM.fullmatch(m.strip()) for m in media.lower().split(","))


def _holds(at_rule: str) -> bool:
    """Whether the rules within an at-rule hold on every screen."""
    name, rest = re.fullmatch(r"@([\w-]*)(.*)", at_rule, re.S).groups()
    name = name.lower()
    return name == "layer" or name == "media" and _any_screen(rest) or name == "supports" and not re.match(r"\s*not\b", rest, re.I)


def _rules(css: str) -> Iterator[tuple[str, str]]:
    """Selectors and declarations of the style rules that hold on every screen; a sheet's end closes what is open."""
    open_: list[tuple[str, bool, list[str]]] = [("", True, [])]  # selectors, whether the rules hold, declarations
    now: list[str] = []
    at = 0
    for token in CSS.finditer(css):
        now.append(css[at: token.start()])
        at, what = token.end(), token[0]
        selectors, holds, body = open_[-1]
        if what == "{":
            head, now = "".join(now).strip(), []
            if head.startswith("@"):
                open_.append((selectors, holds and _holds(head), []))
            else:  # a rule within a rule is about elements within others
                open_.append((head, holds and not selectors, []))
        elif what == "}":
            body.append("".join(now))
            now = []
            if len(open_) > 1:
                open_.pop()
                if selectors and holds:
                    yield selectors, "".join(body)
        elif what == ";":
            if selectors:
                body.append("".join([*now, ";"]))
                now = []
            elif next((x for x in now if x.strip()), "").lstrip().startswith("@"):
                now = []
            else:
                now.append(";")
        elif what[0] in "\"'":
            now.append('""')
        elif not what.startswith("/*"):
            now.append(what)
    if open_[-1][0]:
        open_[-1][2].append("".join([*now, css[at:]]))
    for selectors, holds, body in reversed(open_):
        if selectors and holds:
            yield selectors, "".join(body)


def _sheets(root: Node) -> Sheet:
    """The rules of the page's style sheets in their order; elements learn what they lie within."""
    found, nodes = Sheet(), [root]
    while nodes:
        node = nodes.pop()
        if node.tag == "style" and _any_screen(node.attrs.get("media", "")):
            for selectors, body in _rules("".join(c for c in node.children if isinstance(c, str))):
                found.add(selectors, body)
        inner = [c for c in node.children if not isinstance(c, str)]
        for child in inner:
            child.parent = node
        nodes.extend(reversed(inner))
    return found


class Page:
    """Lines under way: inline text is gathered until a block ends it."""

    def __init__(self, sheet: Sheet):
        self.sheet, self.lines, self.now = sheet, [], []
        self.indent, self.marker, self.gap = "", "", 0

    def text(self, text: str, pre: bool) -> None:
        if pre:
            first, *more = text.replace("\r\n", "\n").split("\n")
            self.now.append(first)
            for line in more:
                self.end_line(keep=True)
                self.now.append(line)
            return
        text = SPACE.sub(" ", text)
        if not self.now or self.now[-1].endswith((" ", "\n")):
            text = text.lstrip(" ")
        if text:
            self.now.append(text)

    def end_line(self, keep: bool = False) -> None:
        line = "".join(self.now).rstrip(" \n")
        self.now = []
        if line or keep:
            self._put(line)

    def _put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = 0
        self.lines.append((self.indent[: len(self.indent) - len(self.marker)] + self.marker + line).rstrip() if self.marker else (self.indent + line).rstrip())
        self.marker = ""

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap = max(self.gap, int(spaced))

    def says(self, node: Node, given: str = "") -> str:
        """"none", "hidden", "visible" or nothing; ``given`` are declarations that any rule outweighs."""
        a = node.attrs
        if node.tag in UNSEEN or (node.tag == "input" and a.get("type") not in ("submit", "button", "reset")):
            return "none"
        said = self.sheet.says(node, _plain(a["style"]) if "style" in a else "")
        if given:
            said = {name: value for name, (value, _) in declarations(given).items()} | said
        # What rules say of display outweighs what the element itself does.
        closed = "hidden" in a or node.tag == "dialog" and "open" not in a
        if said.get("display", "revert" if closed else "") in ("none", *(("revert", "revert-layer") if closed else ())):
            return "none"
        shown = said.get("visibility", "")
        return "hidden" if shown in ("hidden", "collapse") else "visible" if shown in ("visible", "initial") else ""

    def walk(self, node: Node, seen: bool = True, pre: bool = False) -> None:
        order = 0
        for child in node.children:
            if isinstance(child, str):
                if seen and not (node.tag == "details" and "open" not in node.attrs):
                    self.text(child, pre)
                continue
            tag = child.tag
            if (says := self.says(child)) == "none" or node.tag == "details" and "open" not in node.attrs and tag != "summary":
                continue
            shown = seen if not says else says == "visible"
            if tag == "br":
                self.end_line(keep=True)
            elif tag == "input":
                if shown:
                    self.text(" " + child.attrs.get("value", "") + " ", False)
            elif tag == "svg":
                self.draw(child, shown)
            elif tag == "table":
                self.block(True)
                self.table(child, shown)
                self.block(True)
            elif tag in BLOCKS:
                spaced = tag in SPACED and not (tag in ("ul", "ol") and node.tag == "li")
                self.block(spaced)
                held = self.indent
                if tag == "li" and shown:
                    order += 1
                    number = child.attrs.get("value") or str(int(node.attrs["start"]) + order - 1 if re.fullmatch(r"-?\d{1,9}", node.attrs.get("start", "")) else order)
                    self.marker = f"{number}. " if node.tag == "ol" else "- "
                    self.indent += " " * len(self.marker)
                elif tag in ("dd", "blockquote"):
                    self.indent += "  "
                self.walk(child, shown, pre or tag in ("pre", "textarea"))
                self.block(spaced)
                self.indent, self.marker = held, ""
            elif tag == "q":
                self.text("“", False) if shown else None
                self.walk(child, shown, pre)
                self.text("”", False) if shown else None
            else:
                self.walk(child, shown, pre)

    def draw(self, node: Node, seen: bool, text: bool = False) -> None:
        """The text elements of a drawing."""
        for child in node.children:
            if isinstance(child, str):
                if seen and text:
                    self.text(child, False)
                continue
            a = child.attrs
            says = self.says(child, f"display:{a.get('display', '')};visibility:{a.get('visibility', '')}")
            if says == "none" or child.tag in UNDRAWN:
                continue
            shown = seen if not says else says == "visible"
            if child.tag in ("text", "foreignobject"):
                if shown:
                    self.block(False)
                self.draw(child, shown, True) if child.tag == "text" else self.walk(child, shown)
                if shown:
                    self.block(False)
            else:
                if text and child.tag == "tspan" and ("x" in a or "y" in a):
                    self.end_line()
                self.draw(child, shown, text)

    def table(self, table: Node, seen: bool) -> None:
        """Rows of cells, each cell laid out for itself, padded to the width of its column."""
        rows: list[list[list[str]]] = []
        held: dict[int, int] = {}  # column to rows still covered from above
        parts = [(table, seen)]
        while parts:
            node, shown = parts.pop(0)
            inner = []
            for child in node.children:
                if isinstance(child, str):
                    if shown and child.strip(" \t\r\n\f"):
                        self.text(child, False)
                        self.end_line()
                    continue
                says = self.says(child)
                if says == "none":
                    continue
                visible = shown if not says else says == "visible"
                if child.tag == "tr":
                    rows.append(self.row(child, visible, held))
                elif child.tag in ("thead", "tbody", "tfoot"):
                    inner.append((child, visible))
                elif child.tag in ("td", "th"):
                    loose = Node("tr", {})
                    loose.children = [child]
                    rows.append(self.row(loose, visible, held))
                elif child.tag not in ("colgroup", "col"):
                    self.walk(_wrap(child), visible)
                    self.block(False)
            parts[:0] = inner
        width: dict[int, int] = {}
        for row in rows:
            for k, cell in enumerate(row):
                widest = max(map(len, cell), default=0)
                if k + 1 < len(row) and widest <= MAX_COLUMN:
                    width[k] = max(width.get(k, 0), widest)
        for row in rows:
            for i in range(max(map(len, row), default=0)):
                line = "  ".join((cell[i] if i < len(cell) else "").ljust(width.get(k, 0)) for k, cell in enumerate(row)).rstrip()
                if line:
                    self._put(line)

    def row(self, row: Node, seen: bool, held: dict[int, int]) -> list[list[str]]:
        out: list[list[str]] = []

        def covered() -> None:
            while held.get(len(out), 0) > 0:
                held[len(out)] -= 1
                out.append([])

        for child in row.children:
            if isinstance(child, str) and not child.strip(" \t\r\n\f"):
                continue
            node = _wrap(child)
            says = "" if isinstance(child, str) else self.says(child)
            if says == "none":
                continue
            covered()
            cell = Page(self.sheet)
            if not isinstance(child, str) and child.tag in ("td", "th"):
                node = child
            cell.walk(node, seen if not says else says == "visible")
            cell.end_line()
            spans = [] if isinstance(child, str) else [_span(child.attrs.get(k)) for k in ("colspan", "rowspan")]
            for k in range(spans[0] if spans else 1):
                if spans and spans[1] > 1:
                    held[len(out)] = spans[1] - 1
                out.append(cell.lines if k == 0 else [])
        covered()
        return out


def _wrap(child) -> Node:
    node = Node("#cell", {})
    node.children = [child]
    return node


def _span(text: str | None) -> int:
    return min(MAX_SPAN, max(1, int(text))) if text and re.fullmatch(r"\d{1,6}", text) else 1


def render(html: str | None) -> str:
    """The visible text of a page."""
    root = build(html or "")
    page = Page(_sheets(root))
    page.walk(root)
    page.end_line()
    return "\n".join(page.lines).strip("\n")


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [render(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: its id (under its own name) and ``text``."""
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_run, f"id {kind}, text string").withColumnRenamed("id", id_col)
