"""Layout-aware text of HTML pages.

A small tree builder closes tags as the HTML standard implies (paragraphs, list items, table parts, options) and drops
what is not shown (head, scripts, styles, hidden elements, comments). What is left is emitted whole, as a page looks without scripts and
plugins: blocks on lines of their own, paragraphs and headings between blank lines, lists with bullets or numbers, table cells in
aligned columns (cells may span columns and rows), options, text areas and labels of drawings as lines, formulas inline.

Null and empty pages give empty text. Broken markup never fails: unknown end tags are ignored, open tags end with the page, an
attribute without its closing quote or a tag without its end takes the rest of the page, as in browsers. Time is linear in the page's
length: beyond DEEPEST levels lists and quotes aren't indented further, and tables inside tables are rows of plain lines.
"""

from __future__ import annotations

import hashlib
import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_id

TAG_NAME = re.compile(r"[^\s/>]+")
ATTRIBUTE_NAME = re.compile(r"[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(\s*=\s*)?)")
UNQUOTED = re.compile(r"[^\s>]*")
INVISIBLE_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
BLANKS = re.compile(r"[ \t\n\f\r]+")

# Element classes of the HTML standard (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template iframe noembed noframes audio video canvas datalist title annotation annotation-xml mphantom".split())
#: Parts of drawings that aren't shown where they stand; parts of formulas that stand apart.
UNDRAWN = frozenset("desc metadata defs symbol clippath mask marker pattern".split())
APART = frozenset("mfrac mtr munder mover munderover".split())
#: Elements that take lines of their own though they aren't blocks.
LINES = frozenset("tr td th select option optgroup textarea text mtr".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset".split())
BLOCK = SPACED | frozenset("address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend li main menu nav section summary caption".split())
#: A start tag of the key closes open elements of the values, up to a boundary.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tbody", "tfoot", "thead", "tr", "td", "th", "caption"}, "tbody": {"tbody", "tfoot", "thead", "tr", "td", "th", "caption"}, "tfoot": {"tbody", "tfoot", "thead", "tr", "td", "th", "caption"}, "body": {"head"}}
BOUNDARY = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "optgroup": {"select"}}
#: Cells wider than this don't widen their column.
WIDEST = 60
#: Levels of lists and quotes that are indented, and of tables that are aligned; columns and rows that a cell spans at most.
DEEPEST, TABLES, SPAN = 40, 12, 100


class Flow:
    """Lines of one container: the page, a list item, a table cell."""

    def __init__(self, kind: str = "", mark: str = ""):
        self.kind, self.mark = kind, mark
        self.lines: list[str | Flow] = []
        self.spans = (1, 1)
        self.now: list[str] = []
        self.space = False
        self.gap = 0

    def text(self, s: str) -> None:
        if not (words := BLANKS.sub(" ", s)).strip(" "):
            self.space = self.space or bool(words and self.now)
            return
        if (self.space or words[0] == " ") and self.now:
            self.now.append(" ")
        self.now.append(words.strip(" "))
        self.space = words[-1] == " "

    def end_line(self, gap: int = 0, keep: bool = False) -> None:
        if self.now or keep:
            self.put(["".join(self.now)])
        self.now, self.space = [], False
        self.gap = max(self.gap, gap)

    def put(self, lines: list) -> None:
        """Lines, or flows whose lines stand here with their marks."""
        if self.lines and lines:
            self.lines += [""] * self.gap
        if lines:
            self.gap = 0
            self.lines += lines

    def flat(self) -> list[str]:
        """All lines, those of inner flows behind their marks."""
        out: list[str] = []
        inside: list[tuple] = [(iter(self.lines), "")]
        first = ""  # what stands before the next line instead of its indentation
        while inside:
            lines, prefix = inside[-1]
            for x in lines:
                if isinstance(x, Flow):
                    deep = len(inside) > DEEPEST
                    rest = x.mark if x.kind == "blockquote" else " " * len(x.mark)
                    first = (first or prefix) + x.mark if not deep else (first or prefix)
                    inside.append((iter(x.lines or [""]), prefix if deep else prefix + rest))
                    break
                out.append(((first or prefix) + x).rstrip())
                first = ""
            else:
                inside.pop()
        return out


def table_lines(rows: list[list[Flow]]) -> list[str]:
    """Rows of cells in aligned columns, two blanks apart; a cell over several columns widens none of them."""
    width: list[int] = []
    placed = []  # of each row: (column, columns, lines) of its cells
    taken: dict[int, int] = {}  # columns that cells of earlier rows go on in: rows left
    for row in rows:
        at, line, below = 0, [], {}
        for cell in row:
            while taken.get(at):
                at += 1
            across, down = cell.spans if at < SPAN else (1, 1)
            line.append((at, across, cell.flat()))
            if down > 1:
                below |= dict.fromkeys(range(at, at + across), down)
            at += across
        placed.append(line)
        taken = {c: n - 1 for c, n in (taken | below).items() if n > 1}
        width += [0] * (max([x[0] for x in line], default=-1) + 1 - len(width))
        for i, (at, across, cell) in enumerate(line):
            if across == 1 and i < len(line) - 1:
                width[at] = max(width[at], max((len(x) for x in cell if len(x) <= WIDEST), default=0))
    left = [0]
    for w in width:
        left.append(left[-1] + w + 2)
    out = []
    for line in placed:
        for k in range(max((len(c) for _, _, c in line), default=0)):
            text, end = [], 0
            for at, _, cell in line:
                shown = cell[k] if k < len(cell) else ""
                # Text that is wider than its column moves what follows two blanks on.
                gap = max(left[at] - end, 2 if end else 0)
                text += [" " * gap, shown]
                end += gap + len(shown)
            out.append("".join(text).rstrip())
    return out


class Renderer:
    def __init__(self):
        self.open: list[str] = []
        self.own: list[Flow | None] = []  # the flow of each open element that has one
        self.places: dict[str, list[int]] = {}  # of each tag: where it stands in open
        self.flows = [Flow()]
        self.lists: list[int | None] = []
        self.tables: list[list[list[Flow]]] = []
        self.unseen = 0  # depth of what isn't shown: elements open since
        self.pre = 0

    def last(self, tags) -> int:
        """Where the innermost open element of the tags stands, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in BLOCK and tag not in ("body", "html") and self.places.get("p"):
            self.close_up_to({"p"}, {"table", "td", "th", "button", "caption"})
        if tag in BLOCK or tag in ("tr", "td", "th", "br", "hr"):
            self.close_up_to({"svg", "math"}, {"foreignobject", "annotation-xml"})
        if tag in IMPLIED:
            self.close_up_to(IMPLIED[tag], BOUNDARY.get(tag, {"table"}))
        elif self.places.get("head") and tag not in ("meta", "link", "base", "html", "head", "noscript", "template") and tag not in RAW:
            self.close_up_to({"head"}, set())
        if tag == "hr":
            self.flows[-1].end_line()
        if tag == "br" and not self.unseen:
            self.flows[-1].end_line(keep=True)
        if tag in VOID:
            return
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(tag)
        self.own.append(None)
        if self.unseen:
            self.unseen += 1
            return
        if tag in UNSEEN or tag in UNDRAWN and self.places.get("svg") or attributes and self.hidden(attributes):
            self.unseen = 1
            return
        flow = self.flows[-1]
        if len(self.open) > 1 and self.open[-2] in APART:
            flow.space = bool(flow.now)
        if tag in BLOCK or self.on_lines(tag):
            flow.end_line(1 if tag in SPACED and not (tag in ("ul", "ol") and self.lists) else 0)
        if tag == "optgroup":
            flow.text(html.unescape(attributes.get("label", "")))
            flow.end_line()
        if tag == "ol":
            found = re.match(r"\s*(-?[0-9]{1,9})", attributes.get("start", ""))
            self.lists.append(int(found[1]) if found else 1)
        elif tag in ("ul", "menu", "dir"):
            self.lists.append(None)
        elif tag == "li":
            mark = "- "
            if self.lists and self.lists[-1] is not None:
                mark = f"{self.lists[-1]}. "
                self.lists[-1] += 1
            self.inside(Flow(tag, mark))
        elif tag == "dd":
            self.inside(Flow(tag, "    "))
        elif tag == "blockquote":
            self.inside(Flow(tag, "> "))
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and len(self.tables) <= TABLES:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.inside(Flow(tag))
            self.flows[-1].spans = tuple(min(SPAN, max(1, int(x))) if (x := attributes.get(name, "").strip()).isascii() and x.isdigit() and len(x) < 9 else 1 for name in ("colspan", "rowspan"))
        elif tag in ("pre", "textarea"):
            self.pre += 1

    def inside(self, flow: Flow) -> None:
        self.flows.append(flow)
        self.own[-1] = flow

    def on_lines(self, tag: str) -> bool:
        return tag in LINES and (tag != "text" or bool(self.places.get("svg")))

    @staticmethod
    def hidden(attributes: dict[str, str]) -> bool:
        return "hidden" in attributes and attributes["hidden"].lower() != "until-found" or bool(INVISIBLE_STYLE.search(attributes.get("style", "")))

    def close_up_to(self, which: set[str], boundary: set[str]) -> None:
        """Close open elements from the innermost on, through the outermost of which above the boundary."""
        edge = self.last(boundary)
        while (at := self.last(which)) > edge:
            while len(self.open) > at:
                self.pop()

    def end(self, tag: str) -> None:
        if tag == "br":
            return self.start("br", {})
        at = self.last({tag})
        inner = tag in ("li", "p", "div", "span", "ul", "ol", "dl", "dd", "dt") and self.last({"table"}) > at
        while at >= 0 and not inner and len(self.open) > at:
            self.pop()
        return None

    def pop(self) -> None:
        tag, own = self.open.pop(), self.own.pop()
        self.places[tag].pop()
        if self.unseen:
            self.unseen -= 1
            return
        flow = self.flows[-1]
        if own is not None:
            flow.end_line()
            self.flows.pop()
            outer = self.flows[-1]
            if tag in ("td", "th"):
                self.tables[-1][-1].append(flow)
            else:
                outer.end_line()
                outer.put([flow] if flow.lines or tag == "li" else [])
                outer.gap = 1 if tag == "blockquote" else 0
            return
        if tag in ("ul", "ol", "menu", "dir") and self.lists:
            self.lists.pop()
            flow.end_line(0 if self.lists else 1)
        elif tag == "table" and self.tables:
            flow.end_line(1)
            flow.put(table_lines(self.tables.pop()))
            flow.gap = 1
        elif tag in BLOCK:
            flow.end_line(1 if tag in SPACED else 0)
            self.pre -= tag == "pre"
        elif self.on_lines(tag):
            flow.end_line()
            self.pre -= tag == "textarea"

    def text(self, s: str) -> None:
        if self.unseen or not s:
            return
        if self.places.get("svg") and not self.places.get("text") and not self.places.get("foreignobject"):
            return
        if "&" in s:
            s = html.unescape(s)
        if self.places.get("head") and s.strip():
            self.close_up_to({"head"}, set())
        if not self.pre:
            self.flows[-1].text(s)
            return
        *lines, last = s.replace("\r\n", "\n").split("\n")
        for line in lines:
            self.flows[-1].now.append(line)
            self.flows[-1].end_line(keep=True)
        if last:
            self.flows[-1].now.append(last)


def attributes_at(page: str, at: int) -> tuple[dict[str, str] | None, int, bool]:
    """Attributes of a tag from the end of its name on, where it ends, whether it closes itself; no attributes if the page ends in it."""
    found: dict[str, str] = {}
    while (m := ATTRIBUTE_NAME.match(page, at)) is not None:
        at = m.end()
        if m[1]:
            return found, at, page[at - 2] == "/"
        value = ""
        if m[3]:
            quote = page[at : at + 1]
            if quote and quote in "\"'":
                end = page.find(quote, at + 1)
                if end < 0:
                    break
                value, at = page[at + 1 : end], end + 1
            else:
                v = UNQUOTED.match(page, at)
                value, at = v[0], v.end()
        found.setdefault(m[2].lower(), value)
    return None, len(page), False


def render(page: str | None) -> str:
    """All visible text of a page."""
    page, r, at = page or "", Renderer(), 0
    while at < len(page):
        cut = page.find("<", at)
        r.text(page[at:cut] if cut >= 0 else page[at:])
        if cut < 0:
            break
        after = page[cut + 1 : cut + 3]
        if after[:1] in ("!", "?") or after[:1] == "/" and after[1:] and not after[1:].isalpha():
            comment = page.startswith("<!--", cut)
            end = page.find("-->", cut + 2) if comment else page.find(">", cut)
            at = end + (3 if comment else 1) if end >= 0 else len(page)
            continue
        closing = after[:1] == "/"
        initial = after[closing : closing + 1]
        if not (initial.isascii() and initial.isalpha()):
            r.text("<")
            at = cut + 1
            continue
        name = TAG_NAME.match(page, cut + 1 + closing)
        tag = name[0].lower()
        attributes, at, alone = attributes_at(page, name.end())
        if attributes is None:
            break
        if closing:
            r.end(tag)
            continue
        r.start(tag, attributes)
        foreign = r.places.get("svg") or r.places.get("math")
        if foreign and alone:
            r.end(tag)
        elif tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            end = stop.start() if stop else len(page)
            if tag == "textarea":
                r.text(re.sub(r"^\r?\n", "", page[at:end]))
            at = end
    while r.open:
        r.pop()
    r.flows[0].end_line()
    return "\n".join(r.flows[0].flat()).strip("\n")


def page_texts(pages: DataFrame, page_id: str = "page_id", markup: str = "html") -> DataFrame:
    """page_id, text, n_lines, text_sha256: a row for each row of pages."""

    def run(batches):
        for batch in batches:
            text = [render(x) for x in batch["html"].tolist()]
            yield pd.DataFrame({"page_id": batch["page_id"], "text": text, "n_lines": [x.count("\n") + bool(x) for x in text], "text_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in text]})

    source = pages.select(F.col(page_id).cast("string").alias("page_id"), F.col(markup).cast("string").alias("html"))
    return kept_id(source.mapInPandas(run, "page_id string, text string, n_lines long, text_sha256 string"), "page_id")
