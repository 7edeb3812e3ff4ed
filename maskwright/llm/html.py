"""Visible text of HTML pages, laid out as a text browser would.

1. A tokenizer that follows the HTML rules for tags, attributes, comments, character references and raw-text elements.
2. A tree builder that supplies implied tags: paragraphs end where a block begins, list items, options and table parts end
   where the next begins, cells get their row, the head ends where content begins; unmatched end tags are ignored.
3. Visibility: elements without rendering (head, script, template, ...), the hidden attribute, display and visibility in
   style attributes and in the page's own style rules (compounds of tag, .class and #id, with descendant and child
   combinators, also within `@media screen` and `all`), in cascade order, and the content of closed details beyond their
   summary. Visibility is inherited, so that a part of a hidden element may show. Of svg, text elements and foreign objects
   show. Rules with sibling combinators, pseudo-classes or attributes and those within other at-rules are not read.
4. Layout: white space collapses outside pre; blocks begin on new lines, those with margins after a blank one; list items
   get bullets or numbers and hanging indents; table cells are aligned in columns, with row and column spans. Columns are as
   wide as their widest cell, unless the blanks would be several times the table's text (one very long cell among thousands
   of rows): then the widest columns are cut down to what keeps the output in proportion.

Everything is iterative: open elements are found by their last places, rules by their id, class or tag, and descendant rules by
counts of what the open elements have matched. Work is in proportion to the page, but for pages with thousands of style rules that
match thousands of elements, or of cells with huge spans, where it grows with their product. Neither depth nor length is limited;
the layout is: NESTED tables within tables, INDENT columns of indentation, PADDING times a table's text.

Defined cases. Null html: as empty. Empty page: empty text. Null page_id: kept. Repeated rows: each. Empty table: empty.
Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, prepare, strings, table

#: Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset(("title", "textarea"))
NEVER = frozenset("head script style template title meta link base noembed noframes iframe audio video canvas datalist param source track area".split())
DISPLAY_SHOWS = re.compile(r"block|inline|flow|flow-root|flex|grid|table|contents|list-item|ruby|run-in|math|initial|unset|inherit|revert|revert-layer|-(?:webkit|moz|ms)-.+|(?:inline|table|ruby)-[a-z-]+|(?:block|inline) .+")
VISIBILITY = {"visible": True, "initial": True, "hidden": False, "collapse": False, "inherit": None, "unset": None, "revert": None, "revert-layer": None}
#: Within svg only text is drawn; titles, descriptions and definitions are not.
SVG_UNSEEN = frozenset("title desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter".split())
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template head html".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dt dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu dir".split())
CELLS = frozenset(("td", "th"))
SECTIONS = frozenset(("thead", "tbody", "tfoot"))
TABLE_PARTS = CELLS | SECTIONS | {"table", "tr", "caption", "colgroup"}
#: An end tag or an implied end does not reach beyond these.
WALLS = frozenset(("table", "td", "th", "caption", "html", "template", "object", "marquee"))
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var".split())
#: Line breaks around a block: 2 leaves a blank line.
MARGIN = dict.fromkeys("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl blockquote pre table figure hr".split(), 2) | dict.fromkeys("html body div section article header footer nav aside main form address figcaption option optgroup legend fieldset summary details center dialog hgroup li dt dd search select textarea".split(), 1)

#: Tables within tables that are laid out as such (deeper ones as blocks), and columns of indentation, which then stays.
NESTED, INDENT = 12, 48
#: Blanks that align a table, for each character of its text, at most (some thousands are free).
PADDING = 8

SPACE = " \t\n\r\f"
QUICK_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)[ \t\n\r\f]*>")
TAG_NAME = re.compile(r"<(/?)([A-Za-z][^ \t\n\r\f/>]*)")
BEFORE_ATTRIBUTE = re.compile(r"[ \t\n\r\f/]*")
ATTRIBUTE = re.compile(r"(=?[^ \t\n\r\f/>=]*)(?:[ \t\n\r\f]*=[ \t\n\r\f]*(?:\"([^\"]*)\"|'([^']*)'|(?![\"'])([^ \t\n\r\f>]*)))?")
DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+(?:\s+[a-z-]+)*)\s*(!\s*important)?\s*(?=;|$)", re.IGNORECASE)
MEDIA = re.compile(r"@media\s+(?:only\s+)?(?:all|screen)\s*\{((?:[^{}]*\{[^{}]*\})*)[^{}]*\}", re.IGNORECASE)
AT_RULE = re.compile(r"@[^{};]*(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*\})")
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
SELECTOR = re.compile(r"([A-Za-z][A-Za-z0-9]*|\*)?((?:[.#][A-Za-z_-][\w-]*)*)")
BLANKS = re.compile(f"[{SPACE}]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


def declarations(css: str) -> list[tuple[str, str, bool]]:
    """The display and visibility declarations of a block, in order: (property, value, important)."""
    css = re.sub(r"/\*.*?\*/", "", css, flags=re.DOTALL) if "/*" in css else css
    found = [(m[1].lower(), BLANKS.sub(" ", m[2].lower()), bool(m[3])) for m in DECLARATION.finditer(css)]
    return [d for d in found if (d[1] in VISIBILITY if d[0] == "visibility" else d[1] == "none" or DISPLAY_SHOWS.fullmatch(d[1]))]


class Compound(NamedTuple):
    """A tag (or none) with classes and ids."""

    tag: str
    classes: frozenset[str]
    ids: frozenset[str]

    @property
    def weight(self) -> tuple[int, int, int]:
        return len(self.ids), len(self.classes), int(bool(self.tag))

    @property
    def bucket(self) -> str:
        """Every node that matches has this mark."""
        return "#" + min(self.ids) if self.ids else "." + min(self.classes) if self.classes else self.tag or "*"

    def fits(self, tag: str, classes: set[str], name: str) -> bool:
        return (not self.tag or self.tag == tag) and self.classes <= classes and all(i == name for i in self.ids)


def compound(text: str) -> Compound | None:
    m = SELECTOR.fullmatch(text)
    if not m or not m[0]:
        return None
    marks = re.findall(r"[.#][\w-]+", m[2])
    return Compound((m[1] or "").replace("*", "").lower(), frozenset(x[1:] for x in marks if x[0] == "."), frozenset(x[1:] for x in marks if x[0] == "#"))


class Rules:
    """Display and visibility by the page's rules. A rule of one compound is filed under a mark of it, with all rules of that
    compound as one. A rule with combinators is a chain of steps, each filed likewise: a step is taken by a node that fits it
    if the step before was taken by the parent (child) or by any open ancestor (descendant)."""

    def __init__(self) -> None:
        #: mark: compound: property: (rank, value)
        self.simple: dict[str, dict[Compound, dict[str, tuple[tuple, str]]]] = {}
        #: mark: (compound, step before or -1, only the parent's, this step, what a last step declares)
        self.chains: dict[str, list[tuple[Compound, int, bool, int, dict[str, tuple[tuple, str]] | None]]] = {}
        self.steps = self.order = 0
        self.names: set[str] = set()
        self.known: dict[tuple, dict[str, tuple[tuple, str]]] = {}
        #: how many open elements have taken a step
        self.active: Counter = Counter()

    def add(self, css: str) -> None:
        css = re.sub(r"/\*.*?\*/", "", css, flags=re.DOTALL)
        css = AT_RULE.sub("", MEDIA.sub(r"\1", css))
        for selectors, body in RULE.findall(css):
            if found := declarations(body):
                for s in selectors.split(","):
                    self.select(re.sub(r"\s*([>+~])\s*", r" \1 ", s).split(), found)
        self.known.clear()

    def select(self, tokens: list[str], found: list[tuple[str, str, bool]]) -> None:
        compounds = [compound(t) for t in tokens if t != ">"]
        if not compounds or None in compounds or ">" in (tokens[0], tokens[-1]) or any(a == b == ">" for a, b in zip(tokens, tokens[1:], strict=False)):
            return
        self.order += 1
        weight = tuple(sum(c.weight[k] for c in compounds) for k in range(3))
        self.names.update(*(c.ids for c in compounds))
        says: dict[str, tuple[tuple, str]] = {}
        for name, value, important in found:
            put(says, name, (important, 0, *weight, self.order), value)
        if len(compounds) == 1:
            own = self.simple.setdefault(compounds[0].bucket, {}).setdefault(compounds[0], {})
            for name, (rank, value) in says.items():
                put(own, name, rank, value)
            return
        before, child = -1, False
        for k, c in enumerate(c for c in tokens):
            if c == ">":
                child = True
                continue
            c = compound(c)
            last = k == len(tokens) - 1
            self.chains.setdefault(c.bucket, []).append((c, before, child, self.steps, says if last else None))
            before, child, self.steps = self.steps, False, self.steps + 1

    def style(self, node: Node, above: tuple[int, ...] = ()) -> tuple[dict[str, str], tuple[int, ...]]:
        """The values that win for the node: important ones first, then inline, then by specificity, then the last; and the steps
        that the node takes. above: the parent's."""
        inline = node.attrs.get("style", "")
        if not self.order and not inline:
            return {}, ()
        words, name = node.attrs.get("class", ""), node.attrs.get("id", "")
        key = (node.tag, words, name if name in self.names else "")
        classes = set(words.split())
        marks = ["#" + name, *("." + c for c in classes), node.tag, "*"]
        if (won := self.known.get(key)) is None:
            won = {}
            for mark in marks:
                for c, says in self.simple.get(mark, {}).items():
                    if c.fits(node.tag, classes, name):
                        for what, (rank, value) in says.items():
                            put(won, what, rank, value)
            self.known[key] = won
        taken: list[int] = []
        if self.chains or inline:
            won = dict(won)
            for mark in marks if self.chains else ():
                for c, before, child, step, says in self.chains.get(mark, ()):
                    if (before < 0 or (before in above if child else self.active[before])) and c.fits(node.tag, classes, name):
                        if says is None:
                            taken.append(step)
                        else:
                            for what, (rank, value) in says.items():
                                put(won, what, rank, value)
            for what, value, important in declarations(inline):
                put(won, what, (important, 1, 0, 0, 0, 0), value)
        return {what: value for what, (_, value) in won.items()}, tuple(taken)


def put(won: dict[str, tuple[tuple, str]], name: str, rank: tuple, value: str) -> None:
    if name not in won or rank >= won[name][0]:
        won[name] = rank, value


class Builder:
    """Open elements, and the rules for what ends or begins by implication."""

    def __init__(self) -> None:
        self.root = Node("html", {})
        #: open elements; for each tag, and "" for all blocks, the places of those that are open
        self.open: list[Node] = []
        self.places: dict[str, list[int]] = {"": []}
        self.rules = Rules()
        self.put(self.root)

    def put(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.open))
        if node.tag in MARGIN:
            self.places[""].append(len(self.open))
        self.open.append(node)

    def push(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        self.put(node)

    def pop(self) -> None:
        tag = self.open.pop().tag
        self.places[tag].pop()
        if tag in MARGIN:
            self.places[""].pop()

    def pop_to(self, at: int) -> None:
        """Close everything from stack place `at` on."""
        while len(self.open) > max(at, 1):
            self.pop()

    def top(self, tags) -> int:
        """The place of the topmost open element among tags ("": any block), or -1."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def find(self, tags, walls=WALLS, blocks: bool = False) -> int:
        """The topmost open element among tags above any wall (or other block), or -1; never the root."""
        at = self.top(tags)
        if at <= 0 or self.top(walls) > at or blocks and self.top(("",)) > at:
            return -1
        return at

    def end_if_open(self, tags, walls=WALLS) -> None:
        if (at := self.find(tags, walls)) > 0:
            self.pop_to(at)

    def leave_head(self) -> None:
        if self.places.get("head"):
            self.end_if_open(("head",), ())

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag not in IN_HEAD:
            self.leave_head()
        if tag in ("html", "body", "head"):
            if self.places.get(tag) or tag == "head" and self.places.get("body"):
                for k, v in attrs.items() if self.places.get(tag) else ():
                    self.open[self.places[tag][0]].attrs.setdefault(k, v)
                return
        if tag in ENDS_P and self.places.get("p"):
            self.end_if_open(("p",), WALLS | {"button"})
        if tag == "li":
            self.end_if_open(("li",), WALLS | LISTS)
        elif tag in ("dt", "dd"):
            self.end_if_open(("dt", "dd"), WALLS | {"dl"})
        elif tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.pop()
        elif tag == "option":
            self.end_if_open(("option",), WALLS | {"select", "optgroup", "datalist"})
        elif tag == "optgroup":
            self.end_if_open(("optgroup", "option"), WALLS | {"select"})
        elif tag in ("a", "button"):
            if (at := self.find((tag,), blocks=True)) > 0:
                self.pop_to(at)
        elif tag in TABLE_PARTS - {"table"}:
            self.table_part(tag)
        if tag in VOID:
            self.open[-1].children.append(Node(tag, attrs))
        else:
            self.push(tag, attrs)

    def table_part(self, tag: str) -> None:
        """Close what the part ends and open the row that a cell needs; nothing outside a table."""
        table = self.find(("table",), ())
        if table < 0:
            return
        if tag in CELLS:
            row = self.find(("tr",), ("table",))
            if row < 0:
                self.table_part("tr")
                self.push("tr", {})
            else:
                self.pop_to(row + 1)
        elif tag == "tr":
            part = self.find(SECTIONS, ("table",))
            self.pop_to((part if part > 0 else table) + 1)
        else:
            self.pop_to(table + 1)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {})
        elif tag in HEADINGS:
            self.end_if_open(HEADINGS)
        elif not self.places.get(tag):
            if tag == "p":
                self.start("p", {})
                self.pop()
        elif tag in ("html", "body"):
            pass  # what follows is still content
        elif tag in TABLE_PARTS:
            self.end_if_open((tag,), () if tag == "table" else ("table",))
        elif tag in INLINE:
            at = self.find((tag,))
            if at > 0 and self.top(("",)) <= at:
                self.pop_to(at)
        else:
            self.end_if_open((tag,), WALLS | ({"ul", "ol"} if tag == "li" else set()))

    def text(self, s: str) -> None:
        if self.places.get("head") and s.strip(SPACE) and self.open[-1].tag not in ("title", "noscript"):
            self.leave_head()
        self.open[-1].children.append(s)


def attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from the end of a tag's name on, and the place after >; -1: the page ends first."""
    out: dict[str, str] = {}
    while True:
        at = BEFORE_ATTRIBUTE.match(html, at).end()
        if at >= len(html):
            return out, -1
        if html[at] == ">":
            return out, at + 1
        m = ATTRIBUTE.match(html, at)
        rest = html[m.end() : m.end() + 1]
        if m.lastindex == 1 and rest and BLANKS.sub("", html[m.end() : m.end() + 64])[:1] == "=":
            return out, -1  # an open quote swallows the rest
        value = next((v for v in m.groups()[1:] if v is not None), "")
        if m[1]:
            out.setdefault(m[1].lower(), unescape(value))
        at = max(m.end(), at + 1)


def build(html: str) -> tuple[Node, Rules]:
    builder = Builder()
    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            builder.text(unescape(html[at:lt]))
        if lt >= n:
            break
        m = QUICK_TAG.match(html, lt)
        if m:
            attrs, after = {}, m.end()
        elif m := TAG_NAME.match(html, lt):
            attrs, after = attributes(html, m.end())
            if after < 0:
                break
        elif html.startswith("<!--", lt):
            if html.startswith((">", "->"), lt + 4):
                at = html.find(">", lt) + 1
                continue
            ends = [e for e in (html.find("-->", lt + 4), html.find("--!>", lt + 4)) if e >= 0]
            if not ends:
                break
            at = html.find(">", min(ends)) + 1
            continue
        elif html.startswith(("<!", "<?", "</"), lt) and lt + 2 < n:
            at = html.find(">", lt) + 1
            if not at:
                break
            continue
        else:
            builder.text("<")
            at = lt + 1
            continue
        tag = m[2].lower()
        at = after
        if m[1]:
            builder.end(tag)
        elif tag in RAW or tag in ESCAPABLE:
            close = re.compile(rf"</{tag}(?=[ \t\n\r\f/>])", re.IGNORECASE).search(html, at)
            stop = close.start() if close else n
            raw = html[at:stop]
            builder.start(tag, attrs)
            if tag in ESCAPABLE:
                builder.open[-1].children.append(unescape(raw.removeprefix("\n")))
            elif tag == "style":
                builder.rules.add(raw)
            elif tag == "xmp":
                builder.open[-1].children.append(raw)
            builder.pop()
            at = (html.find(">", stop) + 1 or n) if close else n
        else:
            foreign = builder.places.get("svg") or builder.places.get("math") or tag in ("svg", "math")
            builder.start(tag, attrs)
            if foreign and html[after - 2] == "/" and tag not in VOID and tag not in ENDS_P | INLINE | TABLE_PARTS:
                builder.pop()
            if tag in ("pre", "listing") and html.startswith("\n", at):
                at += 1
    return builder.root, builder.rules


class Out:
    """Lines of text under way: gap is the line breaks due before the next text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space, self.gap = False, 0
        self.indent, self.marker = "", None

    def flush(self) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []

    def due(self, gap: int) -> None:
        self.gap = max(self.gap, gap)

    def br(self) -> None:
        self.gap = 1 if self.gap == 0 and self.now else 2

    def begin(self) -> None:
        """Before text is put: breaks and blanks that are due."""
        if self.gap:
            self.flush()
            if self.gap > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap, self.space = 0, False
        if not self.now:
            self.now.append(self.indent if self.marker is None else self.marker)
            self.marker = None
        elif self.space:
            self.now.append(" ")
        self.space = False

    def text(self, s: str) -> None:
        words = BLANKS.sub(" ", s)
        if words == " " or not words:
            self.space = self.space or bool(words and self.now and not self.gap)
            return
        if words[0] == " ":
            self.space = self.space or bool(self.now and not self.gap)
        self.begin()
        self.now.append(words.strip(" "))
        self.space = words[-1] == " "

    def kept(self, s: str) -> None:
        """Text with its own white space."""
        for k, line in enumerate(s.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if k:
                if not self.now and not self.gap:
                    self.lines.append("")
                self.flush()
                self.gap = 0
            if line:
                self.begin()
                self.now.append(line)

    def block(self, lines: list[str]) -> None:
        for line in lines:
            self.begin()
            self.now.append(line)
            self.gap = 1

    def done(self) -> list[str]:
        self.flush()
        return self.lines


def whole(value: str | None, least: int, most: int, default: int) -> int:
    """An integer attribute within bounds."""
    m = re.match(r"\s*([+-]?\d{1,9})", value or "")
    return min(max(int(m[1]), least), most) if m else default


class Table:
    """Cells of a table, by row: (column, column span, lines)."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.below: dict[int, int] = {}  # columns that a cell above still covers, and for how many rows

    def row(self) -> None:
        self.rows.append([])
        self.covered = {c for c, n in self.below.items() if n > 0}
        self.below = {c: n - 1 for c, n in self.below.items() if n > 1}

    def cell(self, attrs: dict[str, str], lines: list[str]) -> None:
        if not self.rows:
            self.row()
        at = sum(self.rows[-1][-1][:2]) if self.rows[-1] else 0
        while at in self.covered:
            at += 1
        span = whole(attrs.get("colspan"), 1, 1000, 1)
        for c in range(at, at + span):
            if (down := whole(attrs.get("rowspan"), 1, 65534, 1)) > 1:
                self.below[c] = down - 1
        self.rows[-1].append((at, span, lines))

    def laid_out(self) -> list[str]:
        widths: dict[int, int] = {}
        for row in self.rows:
            for at, span, lines in row:
                if span == 1:
                    widths[at] = max([widths.get(at, 0), *map(len, lines)])
        for row in self.rows:
            for at, span, lines in row:
                if span > 1:
                    have = sum(widths.get(c, 0) for c in range(at, at + span)) + 2 * (span - 1)
                    widths[at + span - 1] = widths.get(at + span - 1, 0) + max(0, max(map(len, lines), default=0) - have)
        heights = sum(max((len(lines) for _, _, lines in row), default=0) for row in self.rows)
        most = 4096 + PADDING * sum(len(line) for row in self.rows for _, _, lines in row for line in lines)
        cap = max(widths.values(), default=0)
        while cap > 8 and heights * sum(min(w, cap) for w in widths.values()) > most:
            cap //= 2
        widths = {c: min(w, cap) for c, w in widths.items()}
        used = sorted(c for c, w in widths.items() if w)
        starts, x = {}, 0
        for c in used:
            starts[c] = x
            x += widths[c] + 2
        out = []
        for row in self.rows:
            for k in range(max((len(lines) for _, _, lines in row), default=0)):
                line = ""
                for at, span, lines in row:
                    if k < len(lines) and lines[k]:
                        begin = starts.get(at, next((starts[c] for c in range(at, at + span) if c in starts), x))
                        line = line.ljust(begin) if len(line) <= begin else line + "  "
                        line += lines[k]
                if line.strip():
                    out.append(line.rstrip())
        return out


def removed(node: Node, style: dict[str, str], svg: bool) -> bool:
    """Neither the node nor anything below it is shown. A display that is declared wins over the hidden attribute."""
    if node.tag in NEVER or svg and node.tag in SVG_UNSEEN:
        return True
    display = style.get("display", "")
    if display in ("", "revert", "revert-layer"):
        return "hidden" in node.attrs or node.tag == "dialog" and "open" not in node.attrs
    return display == "none"


def in_svg(tag: str, svg: bool) -> bool:
    """Whether text in an element is svg's, which is not drawn outside text elements. HTML elements end svg."""
    return tag == "svg" or svg and tag not in ("text", "foreignobject") and (tag == "a" or tag not in ENDS_P | INLINE | TABLE_PARTS)


def render(root: Node, rules: Rules) -> str:
    """Walk the tree with a stack of (node, next child, visible, in svg, steps taken), and write what is seen."""
    outs, tables = [Out()], []
    numbers: list[int | None] = []
    indents: list[str] = []
    pre = 0
    style, steps = rules.style(root)
    if removed(root, style, False):
        return ""
    rules.active.update(steps)
    stack: list[list] = [[root, 0, VISIBILITY.get(style.get("visibility", "inherit")) is not False, False, steps]]

    def enter(node: Node, parent: Node | None) -> None:
        nonlocal pre
        tag, out = node.tag, outs[-1]
        if tag in ("td", "th", "caption") and tables:
            if tables[-1]:
                outs.append(Out())
            else:
                out.due(1)
        elif tag == "tr" and tables:
            tables[-1].row() if tables[-1] else out.due(1)
        elif tag == "table":
            out.due(MARGIN["table"])
            tables.append(Table() if len(tables) < NESTED else None)
        elif tag in MARGIN:
            nested = tag in LISTS and numbers
            out.due(1 if nested else MARGIN[tag])
        if tag in LISTS:
            numbers.append(whole(node.attrs.get("start"), -(10**9), 10**9, 1) if tag == "ol" else None)
        elif tag == "li":
            if numbers and numbers[-1] is not None:
                number = whole(node.attrs.get("value"), -(10**9), 10**9, numbers[-1])
                numbers[-1] = number + 1
                mark = f"{number}. "
            else:
                mark = "- "
            indents.append(out.indent)
            out.marker = out.indent + mark
            if len(out.indent) < INDENT:
                out.indent += " " * len(mark)
        elif tag in ("dd", "blockquote"):
            indents.append(out.indent)
            if len(out.indent) < INDENT:
                out.indent += "  "
        elif tag in ("pre", "textarea", "listing", "xmp"):
            pre += 1

    def leave(node: Node) -> None:
        nonlocal pre
        tag = node.tag
        if tag in ("td", "th", "caption") and tables and not tables[-1]:
            outs[-1].due(1)
            return
        if tag in ("td", "th", "caption") and tables:
            lines = outs.pop().done()
            while lines and not lines[-1]:
                lines.pop()
            if tag == "caption":
                outs[-1].block(lines)
            else:
                tables[-1].cell(node.attrs, lines)
            return
        out = outs[-1]
        if tag == "table":
            out.due(1)
            if done := tables.pop():
                out.block(done.laid_out())
        if tag in LISTS:
            numbers.pop()
        elif tag in ("li", "dd", "blockquote"):
            out.indent, out.marker = indents.pop(), None
        elif tag in ("pre", "textarea", "listing", "xmp"):
            pre -= 1
        if tag in MARGIN:
            out.due(1 if tag in LISTS and numbers else MARGIN[tag])

    enter(root, None)
    while stack:
        node, k, visible, svg, above = stack[-1]
        if k == len(node.children):
            stack.pop()
            rules.active.subtract(above)
            leave(node)
            if node.tag == "text" and stack and stack[-1][3]:
                outs[-1].text(" ")
            continue
        stack[-1][1] += 1
        child = node.children[k]
        if node.tag == "details" and "open" not in node.attrs and (isinstance(child, str) or child.tag != "summary"):
            continue
        if isinstance(child, str):
            if svg or not visible:
                continue
            if tables and node.tag in ("table", "tr", "thead", "tbody", "tfoot", "colgroup") and not child.strip(SPACE):
                continue
            outs[-1].kept(child) if pre else outs[-1].text(child)
            continue
        style, steps = rules.style(child, above)
        if removed(child, style, svg) or child.tag in ("annotation", "annotation-xml") and node.tag == "semantics":
            continue
        elif child.tag == "br":
            outs[-1].br()
        elif child.tag == "wbr" or child.tag in VOID and child.tag != "hr":
            continue
        else:
            enter(child, node)
            shown = VISIBILITY.get(style.get("visibility", "inherit"))
            rules.active.update(steps)
            stack.append([child, 0, visible if shown is None else shown, in_svg(child.tag, svg), steps])
    lines = outs[0].done()
    return "\n".join(lines).replace("\xa0", " ").strip("\n")


def extract_text(html: str) -> str:
    return render(*build(html))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars of every page."""
    prepare(pages.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract_text(h) for h in strings(batch.column("html"))]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "text", "n_chars"])

    return map_arrow(pages.select("page_id", "html"), run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, text string, n_chars long")


def op9_html(spark, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return extract(table(spark, sf_dir, "pages"))
