"""HTML extraction: main text by the distribution of text over line blocks."""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cuegrid.llm.arrow_text import column, slices

#: Lines of one window, and the share of the fullest window below which a window is no surge.
WINDOW, SURGE = 3, 0.08
#: A further stretch of text is kept if it holds so much of what the fullest stretch holds.
FURTHER = 0.35

# ---- fixed values: what HTML elements are ----
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "object", "svg", "math", "canvas", "audio", "video", "xmp", "noframes")
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 "
    "h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol optgroup option p pre search section select summary table tbody td "
    "tfoot th thead tr ul".split())
#: Block elements that hold a page's parts; others (paragraphs, lists, sections) are parts of what holds them.
HOLDERS = frozenset("html body main article div center td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never article text.
ASIDE = frozenset("nav footer aside form menu dialog select button fieldset head search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in class names and ids that say what a part is for.
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners".split())
READERS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
FRAME = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars widget widgets footer masthead topbar toolbar pagination pager share sharing "
    "social related recommended recommendations cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe "
    "subscription signup login search skip copyright legal disclaimer tags taglist".split())
HEADS = frozenset("header head".split())
#: Parts that are put into the midst of an article, by their words and by their elements.
BOXES = ADVERTS | frozenset("widget widgets share sharing social related recommended recommendations notice notices alert alerts popup modal overlay newsletter subscribe subscription signup".split())
BOXED = frozenset("form dialog select button fieldset".split())
#: Words of these that also name what an article is about.
TOPICS = frozenset("promotion banner banners discussion related social sharing search legal notice notices alert alerts copyright disclaimer consent recommended recommendations "
                   "navigation skip subscription".split())
#: Words that stand beside them in names of parts of a page's layout.
LAYOUT = frozenset(
    "area article articles bar block body bottom box boxes button buttons center col column container content count desktop entry float form google grid group head header holder icon icons info inline inner item items "
    "left link links list main meta mobile more outer page panel post posts primary right row section site slot sticky stories story thread title top unit wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that turn a class name into a statement about the page's layout.
ABOUT = frozenset("with has no without is not hide show".split())
# ---- end of fixed values ----

#: An attribute's value: a quote opens one only straight after the equals sign, anywhere else it is a character.
_VALUE = r"\s*+=\s*+(?:\"([^\"]*+)(?:\"|$)|'([^']*+)(?:'|$)|((?![\"'])[^\s>]*+))"
_ATTRIBUTE = re.compile(rf"(=?[^\s/>=]++|=)(?:{_VALUE})?", re.S)
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)"
    rf"(?P<attrs>(?:[\s/]++|{_ATTRIBUTE.pattern})*+)(?:>|$)", re.S)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|$)", re.I) for name in RAW}
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Holder:
    """An element of HOLDERS, with the numbers of its first and last line."""

    outer: Holder | None
    article: bool
    path: int  # hash of its own and all outer holders' names and classes
    first: int
    last: int = sys.maxsize


@dataclass
class Line:
    """Text between two block tags."""

    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    aside: bool = False
    inside: bool = False  # of an article or main element
    box: bool = False  # aside, but put into the midst of an article
    doubt: int = 0  # number of the first line of a block whose text decides whether it is aside
    number: int = 0
    holder: Holder | None = None

    def text(self) -> str:
        return " ".join("".join(self.pieces).split())


@dataclass
class _Open:
    name: str
    aside: bool
    inside: bool
    link: bool
    box: bool = False
    doubt: int = 0
    holder: Holder | None = None


def _attributes(attrs: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attrs):
        found.setdefault(m.group(1).lower(), next((x for x in m.group(2, 3, 4) if x is not None), ""))
    return found


def _kinds(attributes: dict[str, str], whole: bool = False) -> set[str]:
    """Words in the class names and the id; `whole`: only of those that say nothing but a part of the layout."""
    kinds: set[str] = set()
    for name in (attributes.get("class", "") + " " + attributes.get("id", "")).split():
        parts = set(_PARTS.findall(_CAMEL.sub("-", name).lower()))
        if not parts & ABOUT and not (whole and any(len(x) > 1 and x not in ADVERTS | READERS | FRAME | LAYOUT for x in parts)):
            kinds |= parts
    return kinds


def _sets_aside(name: str, attributes: dict[str, str], inside: bool) -> bool | None:
    """Whether the element is a part of the page that is not its article; None if its text decides."""
    if "hidden" in attributes or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
        return name not in ("html", "body")
    if name in ("html", "body", "main"):
        return False
    if name not in HEADINGS:
        part = inside or name == "section"  # parts of an article have names too
        kinds = _kinds(attributes, whole=part)
        sure = kinds & (ADVERTS | READERS | FRAME) - (TOPICS if part else frozenset())
        if sure & (ADVERTS | READERS):
            return True
        if name == "article":
            return None if kinds & TOPICS & (ADVERTS | READERS) else False
        if name in ASIDE or attributes.get("role", "").lower() in ROLES or sure:
            return True
        if not inside and (name == "header" or kinds & HEADS):
            return True
        return None if kinds & TOPICS else False
    return attributes.get("role", "").lower() in ROLES


def _is_box(name: str, attributes: dict[str, str]) -> bool:
    """Whether an element that is set aside says nothing about where the text around it ends."""
    return name in BOXED or bool(_kinds(attributes) & BOXES) or name not in ASIDE and ("hidden" in attributes or "style" in attributes)


def lines_of(page: str) -> list[Line]:
    """The page's lines: markup, comments and raw elements stripped, a new line at every block tag."""
    lines, now, at = [], Line(), 0
    stack: list[_Open] = []
    opened_now: dict[str, int] = {}  # how many elements of each name are open

    def pop() -> str:
        closed = stack.pop()
        opened_now[closed.name] -= 1
        if closed.name in HOLDERS:
            closed.holder.last = now.number
        return closed.name

    def doubtful(apart: bool | None, name: str, attributes: dict[str, str], outer: _Open, first: bool) -> tuple[bool, int]:
        """Whether an opened element is a box if it is aside, and the block that decides whether it is."""
        if first:
            return False, 0
        if outer.aside or apart is False or outer.doubt and apart is None:
            return outer.box, outer.doubt
        return outer.box or _is_box(name, attributes), now.number + 1 if apart is None else outer.doubt

    def put(text: str) -> None:
        if text:
            text = html.unescape(text)
            now.pieces.append(text)
            if stack and stack[-1].link:
                now.linked += len("".join(text.split()))

    def turn() -> None:
        nonlocal now
        if now.pieces:
            lines.append(now)
        within = stack[-1] if stack else _Open("", False, False, False)
        now = Line(aside=within.aside, inside=within.inside, box=within.box, doubt=within.doubt, number=now.number + 1, holder=within.holder)

    end = len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at:m.start()])
        at = m.end()
        if m.group("cdata") is not None:
            put(m.group("cdata"))
        if m.group("name") is None:
            continue
        name = m.group("name").lower()
        if m.group("close"):
            if opened_now.get(name):
                while pop() != name:
                    pass
            if name in BLOCK:
                turn()
            continue
        if name in RAW:
            closing = None if m.group("attrs").rstrip().endswith("/") and name in ("svg", "math") else _ENDS[name].search(page, at)
            if closing is not None:
                at = page.find(">", closing.end()) + 1 or end
            elif name in ("script", "style", "title", "textarea"):
                at = end
            continue
        outer = stack[-1] if stack else _Open("", False, False, False)
        if name in BLOCK or name == "a" or m.group("attrs").strip():
            attributes = _attributes(m.group("attrs"))
            apart = _sets_aside(name, attributes, outer.inside)
            article = name in ("article", "main") and apart is False
            # an article is never part of an advert or a menu left open before it
            first = article and not outer.inside
            aside = bool(apart) or outer.aside and not first
            opened = _Open(name, aside, outer.inside or article, outer.link or name == "a", *doubtful(apart, name, attributes, outer, first))
        else:
            opened = _Open(name, outer.aside, outer.inside, outer.link, outer.box, outer.doubt)
        if name in ("p", "li", "dt", "dd", "option", "tr", "td", "th"):  # these close one another
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    while len(stack) > k:
                        pop()
                    outer = stack[-1] if stack else _Open("", False, False, False)
                    attributes = _attributes(m.group("attrs"))
                    apart = _sets_aside(name, attributes, outer.inside)
                    opened = _Open(name, outer.aside or bool(apart), outer.inside, outer.link, *doubtful(apart, name, attributes, outer, False))
                    break
                if stack[k].name in BLOCK:
                    break
        if name in HOLDERS:
            path = hash((outer.holder.path if outer.holder else 0, name, attributes.get("class")))
            opened.holder = Holder(outer.holder, opened.inside and not outer.inside, path, now.number + 1)
        else:
            opened.holder = outer.holder
        if name not in VOID:
            stack.append(opened)
            opened_now[name] = opened_now.get(name, 0) + 1
        if name in BLOCK:
            turn()
    turn()
    lines = [x for x in lines if x.text()]
    _settle(lines)
    return lines


def _settle(lines: list[Line]) -> None:
    """Blocks in doubt are aside unless they hold text like the rest: a window with a good share of
    the fullest window of lines that are in no doubt."""
    blocks: dict[int, list[int]] = {0: []}
    if any(x.doubt for x in lines):
        for x in lines:
            if not x.aside:
                size = len("".join(x.text().split()))
                blocks.setdefault(x.doubt, []).append(size - x.linked if 2 * x.linked <= size else 0)
    peaks = {k: np.convolve(v, np.ones(WINDOW, int)).max() if v else 0 for k, v in blocks.items()}
    for x in lines:
        x.aside = x.aside or x.doubt > 0 and peaks[x.doubt] < max(1, FURTHER * peaks[0])
        x.box = x.box and x.aside


def _home(lines: list[Line], filled: np.ndarray, a: int, b: int) -> Holder | None:
    """The innermost holder of the lines from a to b that has more than one line with weight, or the
    article or main element around it; None is the page."""
    numbers = np.array([lines[k].number for k in filled])
    home = lines[a].holder
    while home is not None and (home.last < lines[b].number or np.searchsorted(numbers, home.last, side="right") - np.searchsorted(numbers, home.first) < 2):
        home = home.outer
    around = home
    while around is not None and not around.article:
        around = around.outer
    return around or home


def main_text(page: str) -> str:
    """The text between surges and dives of the line-block distribution.

    A line counts with its letters outside links; lines of menus, notices, adverts, forms and the
    like count nothing. A window's mass is the sum over WINDOW lines. A stretch begins at a surge (a
    window with a share of the fullest window's mass after windows without) and ends at the dive
    where windows are empty again; the edges of article and main elements end it too. The fullest
    stretch is kept, wherever it lies, and further ones that hold a good share of it.

    Adverts, share boxes, forms and the like are no lines here, so that they end no stretch. Where
    other lines part the text of one block (a list of links between paragraphs), the stretches that
    share the holder of the fullest one, or lie in holders of the same names and classes, are kept
    with it, however short.

    An article or main element is trusted as far as the distribution bears it out: if the fullest
    stretch lies in one, its other lines and the stretches of its like are kept; if not, those of
    its stretches that are surges."""
    lines = [x for x in lines_of(page) if not x.box]
    if not lines:
        return ""
    texts = [x.text() for x in lines]
    counted = np.array([not x.aside for x in lines])
    inside = counted & np.array([x.inside for x in lines])
    sizes = np.array([len(t.replace(" ", "")) for t in texts])
    linked = np.array([x.linked for x in lines])
    weight = np.where(counted, np.maximum(sizes - linked, 0), 0)
    weight = np.where(counted & (2 * linked > sizes), 0, weight)
    if not weight.any():
        weight = np.where(inside if inside.any() else counted, sizes, 0)  # an article of nothing but links
    if not weight.any():
        return ""
    filled = np.flatnonzero(weight)
    # dives: WINDOW lines without text; stretches lie between them
    cuts = np.flatnonzero((np.diff(filled) > WINDOW) | (inside[filled[1:]] != inside[filled[:-1]]))
    first, last = filled[np.r_[0, cuts + 1]], filled[np.r_[cuts, len(filled) - 1]]
    totals = np.array([weight[a:b + 1].sum() for a, b in zip(first, last)])
    peaks = np.array([np.convolve(weight[a:b + 1], np.ones(WINDOW, int)).max() for a, b in zip(first, last)])  # of windows, each within its stretch
    top = totals.argmax()
    trusted = inside[first[top]]
    good = (peaks >= SURGE * peaks.max()) & (inside[first] | (totals >= FURTHER * totals[top])) | inside[first] & trusted
    good[top] = True
    home = _home(lines, filled, first[top], last[top])
    held = np.array([home is None or home.first <= x.number <= home.last for x in lines])
    if not trusted:
        paths = np.array([x.holder.path if x.holder else 0 for x in lines])
        alike = held | np.isin(paths, paths[first[top]:last[top] + 1][weight[first[top]:last[top] + 1] > 0])
        good |= ~inside[first] & np.array([alike[a:b + 1][weight[a:b + 1] > 0].any() for a, b in zip(first, last)])
    kept = np.zeros(len(lines), bool)
    for a, b in zip(first[good], last[good]):
        kept[a:b + 1] = True
    if trusted:  # linked lines at the edges of its article belong to it
        kept |= inside & held
    return " ".join(t for t, k in zip(texts, kept & counted) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = [main_text(h) if h else "" for h in column(batch, "html").to_pylist()]
        yield pa.record_batch({
            **{f.name: batch.column(k) for k, f in enumerate(batch.schema) if f.name not in ("html", "text", "n_chars")},
            "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def extract(pages: DataFrame) -> DataFrame:
    """`pages` with html replaced by text (main text, empty if none) and n_chars (its code points).

    One narrow pass; no shuffle. Null or empty html, and pages without article text, give the empty
    text. Broken markup is read as browsers do: unclosed elements end with their parents, a cut tag
    or comment ends the page. Other columns are kept, but for text and n_chars, which are replaced;
    repeated rows and null ids are kept; empty tables give no rows."""
    rows = pages.drop("text", "n_chars").withColumn("html", F.coalesce("html", F.lit("")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "html")
    return rows.mapInArrow(_extract, f"{schema}, text string, n_chars long")
