"""Visible text of web pages, laid out as a text browser would.

A tokenizer and a tree builder with implied tags turn the bytes into elements: a block start
closes an open paragraph, list items, table rows and cells close their like, end tags close what
is open inside them, and stray end tags are ignored. Elements that aren't shown are left out:
scripts, styles, the head, templates, ``hidden``, closed dialogs, and what ``display: none`` or
``visibility: hidden`` says in a style attribute or in the page's own style sheets. Those are read
with comments, at-rules and the cascade: important declarations, inline style, specificity and
order decide, selectors may be compound and may have descendant and child combinators, and
visibility is inherited and can be set back by a child. The rest is written out: blocks on lines
of their own, paragraphs and headings apart by a blank line, list items with their mark or number
and indented by depth, table cells padded to the width of their column with column and row spans
observed, preformatted text as it is, formulas and the text elements of drawings too.

Defined cases: null and empty pages give an empty text; a tag that the page ends in drops what
follows, as in browsers; selectors with pseudo-classes or sibling combinators hide nothing; a
media query holds unless it names another medium than the screen or sets a largest width; details
are shown as if open; a table that padding would make more than ``PADDING`` times as long as its
text (and longer than 64 KB) has its cells apart by two spaces, unaligned; column spans are at
most 1,000 and row spans at most 65,534, as the HTML standard says; tables inside tables deeper than
``DEEPEST`` are written as blocks; rows that agree in id are rendered one by one; elements nested
deeper than ``MOST_OPEN`` lose their nesting, not their text; other columns, whatever their names,
aren't read; an empty table gives an empty table. Time and memory grow with the length of a page.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Element names as the HTML standard groups them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas select datalist title meta link desc metadata defs symbol annotation annotation-xml".split())
#: Elements of a drawing whose text is shown.
SVG_TEXT = frozenset("text foreignobject".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
BLOCK = PARAGRAPH | frozenset("address article aside body center details dialog dd dir div dt fieldset figcaption footer form header hgroup html legend li main menu nav optgroup option search section summary tr caption thead tbody tfoot".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: A start tag closes the nearest of these if no scope element lies between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"table", "tr"}),
    "th": ({"td", "th", "caption"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
}
SCOPE = frozenset("table td th caption button object html template".split())
#: Inline elements whose end tag leaves open blocks inside them open.
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
DEEPEST = 8
PADDING = 16
#: Elements open at once; what is nested deeper is attached to the last of them, as browsers do.
MOST_OPEN = 512

#: Attributes by the standard's states: a quote opens a value only straight after "=", elsewhere it
#: is a character like others. Nothing is tried twice, so time stays in proportion.
_VALUE = r"""[ \t\n\f]*+=[ \t\n\f]*+(?:"{d}"|'{s}'|{u}|(?=>|\Z))"""
_NAME = r"""[^ \t\n\f/>][^ \t\n\f/>=]*+"""
_BARE = _VALUE.format(d='[^"]*+', s="[^']*+", u=r"""[^ \t\n\f>"'][^ \t\n\f>]*+""")
_TAG = re.compile(rf"""<(/?)([a-zA-Z][^ \t\n\f/>]*+)((?:[ \t\n\f/]++|{_NAME}(?:{_BARE}|(?![ \t\n\f]*+=)))*+)>""")
_ATTRIBUTE = re.compile(rf"""({_NAME})(?:{_VALUE.format(d='([^"]*+)', s="([^']*+)", u=r"""([^ \t\n\f>"'][^ \t\n\f>]*+)""")})?+""")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_IMPORTANT = re.compile(r"\s*!\s*important$")
_KEYWORDS = re.compile(r"[a-z-]+(?: +[a-z-]+)*")
_COMPOUND = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+|\[[^\[\]]*\])*)")
_PART = re.compile(r"([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:=\s*[\"']?([^\"'\]]*?)[\"']?\s*)?\]")
_MAX_WIDTH = re.compile(r"max-(?:device-)?(?:width|height)")


class Node:
    __slots__ = ("attributes", "children", "name", "parent")

    def __init__(self, name: str, attributes: dict[str, str] | None = None, parent: Node | None = None):
        self.name, self.attributes, self.children, self.parent = name, attributes or {}, [], parent


def _attributes(text: str) -> dict[str, str]:
    if not text.strip(" /\n\t"):
        return {}
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _declarations(text: str) -> dict[str, tuple[str, bool]]:
    """Value of display and visibility, and whether it is important; later ones win among equals."""
    out: dict[str, tuple[str, bool]] = {}
    for part in text.split(";"):
        name, colon, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if colon and name in ("display", "visibility"):
            plain = _IMPORTANT.sub("", value)
            important = plain != value
            if _KEYWORDS.fullmatch(plain) and (important or not out.get(name, ("", False))[1]):
                out[name] = (plain, important)
    return out


def _holds(medium: str) -> bool:
    """Whether a list of media queries holds on a wide screen."""
    for query in medium.lower().split(","):
        words = query.split()
        if words and words[0] == "only":
            words = words[1:]
        kind = "all" if not words or words[0].startswith("(") else words[0]
        if kind == "not":
            if len(words) > 1 and words[1] not in ("all", "screen"):
                return True
        elif kind in ("all", "screen") and not _MAX_WIDTH.search(query):
            return True
    return False


class Styles:
    """What style sheets say about display and visibility, by the last compound of each selector."""

    def __init__(self):
        self.rules: dict[str, list] = {}
        self.count = 0

    def read(self, sheet: str) -> None:
        text, at, holds = _COMMENT.sub(" ", sheet), 0, [True]
        for m in re.finditer(r"[{};]", text):
            if m.start() < at:
                continue
            prelude, at = text[at : m.start()].strip(), m.end()
            if m[0] == "}":
                if len(holds) > 1:
                    holds.pop()
            elif m[0] == "{" and prelude.startswith("@"):
                name, _, rest = prelude[1:].partition(" ")
                name, _, more = name.partition("(")
                inside = name in ("media", "supports", "layer", "container") and (name != "media" or _holds(f"({more} {rest}" if more else rest))
                holds.append(holds[-1] and inside)
            elif m[0] == "{":
                end = text.find("}", at)
                body = text[at : end if end >= 0 else len(text)]
                at = end + 1 if end >= 0 else len(text)
                found = _declarations(body) if holds[-1] else None
                if found:
                    self.count += 1
                    for selector in prelude.split(","):
                        self._add(selector.strip(), found)

    def _add(self, selector: str, found: dict) -> None:
        parts, rank = [], [0, 0, 0]
        pieces = re.split(r"(\s*>\s*|\s+)", selector)
        for k in range(0, len(pieces), 2):
            m = _COMPOUND.fullmatch(pieces[k])
            if not m or not pieces[k]:
                return  # not understood
            tag = "" if m[1] in (None, "*") else m[1].lower()
            needs = [("id" if p[1] == "#" else "class" if p[1] == "." else p[3].lower(), p[2] or p[4]) for p in _PART.finditer(m[2])]
            rank[0] += sum(n == "id" for n, _ in needs)
            rank[1] += sum(n != "id" for n, _ in needs)
            rank[2] += bool(tag)
            parts.append((tag, needs, pieces[k - 1].strip() == ">" if k else False))
        tag, needs, _ = parts[-1]
        named = next((f"{'#' if n == 'id' else '.'}{v}" for n, v in needs if n in ("id", "class") and v), tag or "*")
        self.rules.setdefault(named, []).append((parts[::-1], (tuple(rank), self.count), found))

    def _best(self, node: Node) -> dict:
        best: dict[str, tuple] = {}

        def take(found, rank):
            for name, (value, important) in found.items():
                key = (important, rank)
                if name not in best or key >= best[name][0]:
                    best[name] = (key, value)

        a = node.attributes
        if self.rules:
            keys = ["*", node.name, *([f"#{a['id']}"] if "id" in a else []), *[f".{c}" for c in set(a.get("class", "").split())]]
            for key in keys:
                for parts, rank, found in self.rules.get(key, ()):
                    if _matches(node, parts):
                        take(found, rank)
        if "style" in a:
            take(_declarations(_COMMENT.sub(" ", a["style"])), ((9_999, 0, 0), 0))
        return {name: value for name, (_, value) in best.items()}

    def of(self, node: Node, visible: bool) -> tuple[bool, bool]:
        """Whether the node is displayed, and whether its text is visible if that of its parent is ``visible``."""
        a = node.attributes
        if node.name in UNSEEN:
            return False, visible
        said = self._best(node) if a or self.rules else {}
        if "display" in said:
            displayed = said["display"] != "none"
        else:
            displayed = "hidden" not in a and not (node.name == "dialog" and "open" not in a)
        if node.name == "input" and a.get("type", "").lower() == "hidden":
            displayed = False
        seen = said.get("visibility")
        return displayed, visible if seen in (None, "inherit", "unset") else seen not in ("hidden", "collapse")


def _fits(node: Node, tag: str, needs: list) -> bool:
    if tag and node.name != tag:
        return False
    for name, value in needs:
        own = node.attributes.get(name)
        if own is None or (value not in own.split() if name == "class" else value is not None and own != value):
            return False
    return True


def _matches(node: Node, parts: list) -> bool:
    """Whether the compounds ``parts``, the last one first, fit the node and elements above it."""
    tag, needs, child = parts[0]
    if not _fits(node, tag, needs):
        return False
    if len(parts) == 1:
        return True
    above = []
    while node.parent is not None:
        node = node.parent
        above.append(node)
    now = {-1}
    for tag, needs, following in parts[1:]:
        places = {k + 1 for k in now if k + 1 < len(above)} if child else range(min(now) + 1, len(above))
        now = {k for k in places if _fits(above[k], tag, needs)}
        if not now:
            return False
        child = following
    return True


def tree(page: str) -> tuple[Node, Styles]:
    """The page's elements, and what its style sheets hide."""
    root, styles = Node("html"), Styles()
    stack, at, n = [root], 0, len(page)

    def pop_to(names, stop) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                del stack[k:]
                return
            if stack[k].name in stop:
                return

    while at < n:
        low = page.find("<", at)
        if low < 0:
            low = n
        if low > at:
            stack[-1].children.append(html.unescape(page[at:low]))
        if low >= n:
            break
        at = low
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        follows = page[at + 1 : at + 2]
        if follows in ("!", "?") or (follows == "/" and not (page[at + 2 : at + 3].isascii() and page[at + 2 : at + 3].isalpha())):
            end = page.find(">", at + 1)
            at = n if end < 0 else end + 1
            continue
        if not (follows == "/" or (follows.isascii() and follows.isalpha())):
            stack[-1].children.append("<")
            at += 1
            continue
        m = _TAG.match(page, at)
        if not m:  # the page ends inside a tag
            break
        at, name = m.end(), m[2].lower()
        if m[1]:
            if name == "p" and not any(x.name == "p" for x in stack):
                stack[-1].children.append(Node("p", None, stack[-1]))
            elif name in FORMATTING:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name:
                        if any(x.name in BLOCK for x in stack[k + 1 :]):
                            del stack[k]
                        else:
                            del stack[k:]
                        break
            elif name not in ("html", "body"):
                pop_to({name}, SCOPE - {name} if name not in ("table", "tr", "thead", "tbody", "tfoot") else {"table"} - {name})
            continue
        if name in ("html", "body"):
            stack[0].attributes |= _attributes(m[3])
            pop_to({"head"}, ())
            continue
        if name in CLOSES_P:
            pop_to({"p"}, SCOPE)
        if name[0] == "h" and name[1:] in "123456" and name[1:] and stack[-1].name[0] == "h" and stack[-1].name[1:].isdigit():
            stack.pop()
        if name in IMPLIED:
            names, stop = IMPLIED[name]
            if name[0] == "t":
                for k in range(len(stack) - 1, 0, -1):  # all that the row or cell ends
                    if stack[k].name in stop:
                        break
                    if stack[k].name in names:
                        low = k
                        while low > 1 and stack[low - 1].name in names:
                            low -= 1
                        del stack[low:]
                        break
            else:
                pop_to(names, stop | SCOPE)
        if stack[-1].name == "head" and name not in ("title", "meta", "link", "script", "style", "base", "noscript", "template"):
            stack.pop()
        node = Node(name, _attributes(m[3]), stack[-1])
        stack[-1].children.append(node)
        if name in RAW:
            low = at
            while True:
                low = page.find("</", low)
                if low < 0 or page[low + 2 : low + 2 + len(name)].lower() == name:
                    break
                low += 2
            body = page[at:] if low < 0 else page[at:low]
            if name == "style":
                if _holds(node.attributes.get("media", "")):
                    styles.read(body)
            elif name in ("textarea", "title"):
                node.children.append(html.unescape(body))
            end = -1 if low < 0 else page.find(">", low)
            at = n if end < 0 else end + 1
        elif name not in VOID and len(stack) < MOST_OPEN:
            stack.append(node)
    return root, styles


class Page:
    """Lines of text under way: ``gap`` is how many line ends must come before the next text."""

    def __init__(self):
        self.parts, self.gap, self.space, self.indent, self.mark = [], 0, False, "", ""

    def block(self, gap: int) -> None:
        self.space = False
        if self.parts:
            self.gap = max(self.gap, gap)

    def _open(self) -> None:
        if self.gap or not self.parts:
            self.parts.append("\n" * self.gap + (self.mark or self.indent))
            self.gap, self.mark, self.space = 0, "", False

    def text(self, text: str) -> None:
        words = _SPACES.sub(" ", text)
        if words.strip(" ") == "":
            self.space = self.space or (bool(words) and not self.gap and bool(self.parts))
            return
        self._open_for(words.startswith(" "))
        self.parts.append(words.strip(" "))
        self.space = words.endswith(" ")

    def _open_for(self, leading: bool) -> None:
        begun = bool(self.gap) or not self.parts
        spaced = self.space or leading
        self._open()
        if spaced and not begun:
            self.parts.append(" ")

    def verbatim(self, text: str) -> None:
        for k, line in enumerate(text.split("\n")):
            if k:
                self.block(1)
                self.gap = max(self.gap, 1) if line else self.gap + 1
            if line:
                self._open()
                self.parts.append(line)

    def out(self) -> str:
        return "".join(self.parts).strip("\n")


def _strays(children: list) -> list[str]:
    return [x for x in children if isinstance(x, str) and x.strip()]


def _rows(table: Node, styles: Styles, visible: bool) -> tuple[list, list[list]]:
    """What is shown before the table, text outside cells among it, and the cells of each row; all with their visibility."""
    captions, rows = [], []

    def displayed(children, seen):
        for x in children:
            if isinstance(x, Node):
                shown, of_x = styles.of(x, seen)
                if shown:
                    yield x, of_x

    def strays(children, seen):
        captions.extend((x, seen) for x in _strays(children) if seen)

    def row(tr, seen):
        strays(tr.children, seen)
        rows.append(list(displayed(tr.children, seen)))

    for child in table.children:
        if isinstance(child, str):
            strays([child], visible)
            continue
        for x, seen in displayed([child], visible):
            if x.name in ("thead", "tbody", "tfoot"):
                rows.append([])  # row spans end with their group
                strays(x.children, seen)
                for y, of_y in displayed(x.children, seen):
                    if y.name == "tr":
                        row(y, of_y)
                    else:
                        rows.append([(y, of_y)])
                rows.append([])
            elif x.name == "tr":
                row(x, seen)
            elif x.name in ("td", "th"):
                rows.append([(x, seen)])
            elif x.name not in ("colgroup", "col"):
                captions.append((x, seen))
    return captions, rows


def _span(cell: Node, name: str, most: int) -> int:
    text = cell.attributes.get(name, "1").strip()
    return min(int(text[:9]), most) if text.isascii() and text.isdigit() else 1


def _table(node: Node, page: Page, styles: Styles, depth: int, visible: bool) -> None:
    captions, rows = _rows(node, styles, visible)
    for x, seen in captions:
        page.block(1)
        page.text(x) if isinstance(x, str) else _render(x, page, styles, depth, seen)
    grid, held = [], {}  # held: column -> how many more rows a cell above reaches into it
    for row in rows:
        if not row:
            held = {}
            continue
        cells, column = [], 0
        reached = held
        held = {k: n - 1 for k, n in reached.items() if n > 1}
        for cell, seen in row:
            while column in reached:
                column += 1
            inner = Page()
            _render(cell, inner, styles, depth + 1, seen)
            wide, high = max(1, _span(cell, "colspan", 1000)), _span(cell, "rowspan", 65534) or 65534
            cells.append((column, column + wide, inner.out().split("\n")))
            if high > 1:
                held.update(dict.fromkeys(range(column, column + wide), high - 1))
            column += wide
        grid.append(cells)
    # only columns in which a cell starts or ends count; each begins where all cells that end before it are over
    edges = sorted({x for cells in grid for a, b, _ in cells for x in (a, b)})
    number = {x: k for k, x in enumerate(edges)}
    ending: list[list] = [[] for _ in edges]
    for cells in grid:
        for a, b, lines in cells:
            ending[number[b]].append((number[a], max(map(len, lines))))
    offset = [0] * len(edges)
    for k in range(1, len(edges)):
        offset[k] = max([offset[k - 1], *(offset[a] + width + 2 for a, width in ending[k])])
    lines_of = lambda cells: max((len(lines) for _, _, lines in cells), default=0)
    plain = sum(len(line) + 2 for cells in grid for _, _, lines in cells for line in lines)
    padded = sum(lines_of(cells) * offset[number[cells[-1][0]]] for cells in grid if cells)
    aligned = padded <= max(1 << 16, PADDING * plain)
    for cells in grid:
        for k in range(lines_of(cells)):
            parts, long = [], 0
            for a, _, lines in cells:
                text = lines[k] if k < len(lines) else ""
                if aligned:
                    pad = offset[number[a]] - long
                    parts.append(" " * pad)
                    long += pad
                elif parts:
                    parts.append("  ")
                parts.append(text)
                long += len(text)
            line = "".join(parts).rstrip(" ")
            page.block(1)
            if line:
                page._open()
                page.parts.append(line)


def _render(top: Node, page: Page, styles: Styles, depth: int = 0, visible: bool = True) -> None:
    """Writes what ``top`` holds, by a stack of its own: pages may be nested deeper than calls can be."""
    work: list = [("in", top, False, [], visible, False)]
    while work:
        kind, node, pre, lists, seen, drawing = work.pop()
        if kind == "text":
            if seen and not drawing:
                page.verbatim(node) if pre else page.text(node)
            continue
        name = node.name
        gap = 2 if name in PARAGRAPH and not (name in ("ul", "ol") and lists) else 1 if name in BLOCK or (drawing and name in SVG_TEXT) else 0
        if kind == "out":
            if gap:
                page.block(gap)
            if name == "li":
                page.indent = "  " * max(0, len(lists) - 1)
                page.mark = ""
            elif name in ("ul", "ol", "menu"):
                page.indent = "  " * len(lists)
            continue
        if node is not top:
            shown, seen = styles.of(node, seen)
            if not shown:
                continue
        if name == "br":
            page.space = False
            page.gap = page.gap + 1 if page.parts else 0
            continue
        if name == "hr":
            page.block(2)
            continue
        if name == "table" and depth < DEEPEST:
            page.block(2)
            _table(node, page, styles, depth, seen)
            page.block(2)
            continue
        if name == "img" or name in VOID:
            continue
        if gap:
            page.block(gap)
        if name in ("ul", "ol", "menu"):
            start = node.attributes.get("start", "1")
            inner = [*lists, [name, int(start) if start.isascii() and start.isdigit() and len(start) < 10 else 1]]
        else:
            inner = lists
        if name == "li":
            depth_in = max(0, len(lists) - 1)
            if lists and lists[-1][0] == "ol":
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            else:
                mark = "- "
            page.mark, page.indent = "  " * depth_in + mark, "  " * depth_in + " " * len(mark)
        if name in ("td", "th") and node is not top:
            page.space = True
        pre = pre or name in ("pre", "textarea")
        inside = name == "svg" or (drawing and name not in SVG_TEXT)
        work.append(("out", node, pre, lists, seen, drawing))
        work += [("text" if isinstance(c, str) else "in", c, pre, inner, seen, inside) for c in reversed(node.children)]


def visible_text(page: str | None) -> str:
    if not page:
        return ""
    root, styles = tree(page.replace("\r\n", "\n").replace("\r", "\n"))
    out = Page()
    shown, seen = styles.of(root, True)
    if shown:
        _render(root, out, styles, 0, seen)
    return out.out()


def _rendered(batches):
    for whole in batches:
        for batch in slices(whole, "_html"):
            texts = [visible_text(x) for x in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string())], names=["_id", "_url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col and the visible text of each row."""
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.col(html_col).cast("string").alias("_html"))
    out = rows.mapInArrow(_rendered, f"_id {kind}, _url string, text string")
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text")
