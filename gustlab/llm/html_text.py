"""Main text of web pages by line-block distribution.

A page is cut into lines, one a block element, with the markup stripped. A line's length is that of its text, or 0 where
the line is no article text by its place: menus, page headers, footers, sidebars, notices, adverts, forms, scripts,
styles, hidden parts and reader comments (by element, role, class or id), lines that are mostly links, and, on a page
with an ``article`` or ``main`` element, all lines outside of it. Inside of one, links are text of the article but for
menus (rows and unordered lists of short links only), a name that may also be a subject ("discussion") counts only
where a second such name or nothing but links comes with it, and a heading's id, often made of its words, never. Lengths are summed over sliding windows of ``WINDOW``
lines; a region surges where the sum first passes the threshold and dives where it falls to 0, and the text lines
between are kept. Inside an article element any text surges, elsewhere ``SURGE`` characters; where none surges, any
text does.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gustlab.llm import blocks as B

WINDOW, SURGE = 3, 86

# The element sets of the HTML standard, and common names of page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol
    p pre section summary table tbody td tfoot th thead title tr ul""".split())
DROPPED = frozenset("""head nav aside footer form script style noscript template iframe svg button select option
    textarea title dialog menu canvas object audio video datalist input applet noembed noframes map""".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
PARTS = re.compile(r"""^(?:ads?|adverts?|adsense|adslot|adbox|advertis\w*|sponsor\w*|promo\w*|banners?|menus?|nav|navs|navbar|
    navigation|navi|breadcrumbs?|sidebars?|sidenav|widgets?|related|recommend\w*|share|sharing|social|footers?|cookies?|
    cookiebar|consent|gdpr|notices?|notifications?|alerts?|disclaimers?|popups?|modals?|overlays?|newsletters?|subscribe|
    subscription|signup|login|comments?|commentlist|disqus|replies|reply|respond|discussion|toolbar|topbar|copyright|
    pagination|pager|masthead|skip|hidden)$""", re.X | re.I)
#: Of these, words that also name what an article is about.
AMBIGUOUS = re.compile(r"""^(?:cookies?|sponsor\w*|promo\w*|banners?|menus?|navigation|navi|widgets?|related|recommend\w*|share|sharing|
    social|consent|notices?|notifications?|alerts?|disclaimers?|overlays?|subscribe|subscription|signup|login|replies|reply|
    respond|discussion|copyright|skip|hidden)$""", re.X | re.I)
#: "ad" before one of these is an advert, before other words ("ad-hoc") it is not.
AD = re.compile(r"^ads?$", re.I)
AD_PLACE = re.compile(r"""^(?:slots?|box(?:es)?|units?|banners?|blocks?|containers?|wrapp?(?:er)?s?|holders?|spaces?|zones?|places?|areas?|
    label|text|link|top|bottom|left|right|side\w*|header|footer|content|frame|panel|row|col\w*|inner|outer|native|mobile|desktop|\d*)$""",
                      re.X | re.I)
#: Of these, only outside of an article: an article's own header holds its title.
HEADERS = re.compile(r"^(?:header|heading|masthead|topbar|top)$", re.I)
CLOSED_BY_BLOCK = frozenset(["p"])
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
            "th": ("td", "th"), "option": ("option",)}
LISTS = frozenset("ul ol dl table".split())
#: Dropped elements inside a line: nothing in them ends the line or closes an element around them.
INERT = frozenset("svg button select object applet canvas audio video datalist map template".split())
#: A form around one of these is the frame of the page, no form to fill in.
FRAMED = frozenset("article main nav header footer aside h1".split())

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
EDGE = 20  # a shorter line at the edge of a region, no heading and no sentence, is a label beside the text

# a tag as the standard's tokenizer reads it: an unquoted value may hold quotes, "<!-->" and "<!--->" are whole comments
_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:-->|--!>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)?+|=)*+)(?:>|\Z)""", re.X | re.S)
_ATTR = re.compile(r"""([^\s=/>][^\s=/>]*)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]+))?""")
_FORM = re.compile(rf"<(/?)({'|'.join(sorted(FRAMED))}|form)(?=[\s/>])", re.I)


def _is_part(name: str, attrs: str, in_article: bool) -> bool | None:
    """Whether an element is a page part that is no article text; None: only if it holds nothing but links."""
    if name in DROPPED:
        return True
    if name == "header" and not in_article:
        return True
    if not attrs or attrs.isspace():
        return False
    unsure = set()
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "role" and value.lower() in ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key in ("class", "id") and name not in ("body", "html", "main") and not (key == "id" and name in HEADINGS):
            for word in value.split():
                pieces = re.split(r"[-_]+", word)
                for x in (word, pieces[0], pieces[-1]):  # "ad", "ad-slot", "post-comments"
                    if len(pieces) > 1 and x is pieces[0] and AD.match(x) and not AD_PLACE.match(pieces[1]):
                        continue
                    if in_article and AMBIGUOUS.match(x):
                        unsure.add(x.lower())
                    elif PARTS.match(x) or (not in_article and name not in HEADINGS and HEADERS.match(x)):
                        return True
    return len(unsure) > 1 or (None if unsure else False)


def _frames(page: str) -> set[int]:
    """Where the forms begin that hold the page itself (tags inside comments and scripts may add one, which drops nothing)."""
    out: set[int] = set()
    form = None
    for m in _FORM.finditer(page):
        if m[2].lower() == "form":
            form = None if m[1] else (m.start() if form is None else form)
        elif form is not None and not m[1]:
            out.add(form)
    return out


class _Page:
    """The open elements of a page and the lines found so far.

    Text is judged where it stands: a piece inside a page part never joins its line. Names, blocks and headings that are open
    are counted, so a tag costs no walk through the open elements but for those it closes.
    """

    def __init__(self):
        self.out: list[tuple[str, bool, bool, bool]] = []
        self.label: list[tuple[bool, int, int]] = []  # of each line: is mostly links, its characters, its links
        self.stack: list[tuple[str, bool | None, int]] = []  # open elements, whether each is a page part, and the lines before it
        self.open: defaultdict[str, list[int]] = defaultdict(list)  # by name: places of open elements
        self.blocks: list[int] = []  # places of open blocks, list items and their lists, and inert elements
        self.marks: list[int] = []
        self.inert: list[int] = []
        self.parts = self.articles = self.headings = 0
        self._new_line()

    def _new_line(self):
        self.text, self.gone = [], []
        self.size = self.linked = self.n_links = 0

    def flush(self):
        if self.inert:
            return
        line, part = " ".join(html.unescape("".join(self.text)).split()), False
        if not line and self.gone:
            line, part = " ".join(html.unescape("".join(self.gone)).split()), True
        if line:
            linky, n = 2 * self.linked > self.size, max(1, self.n_links)
            block = self.stack[self.blocks[-1]][0] if self.blocks else ""
            row = n > 1 and block in ("div", "section") and len(line) < EDGE * n
            self.out.append((line, part or linky and (not self.articles or row), self.articles > 0, self.headings > 0))
            self.label.append((linky, len(line), n))
        self._new_line()

    def add(self, s: str):
        if self.parts:
            self.gone.append(s)
            return
        self.text.append(s)
        n = len(s) - s.count(" ")
        self.size += n
        self.linked += n if self.open["a"] else 0

    def push(self, name: str, part: bool | None):
        at = len(self.stack)
        self.stack.append((name, part, len(self.out)))
        self.open[name].append(at)
        if name in BLOCK:
            self.blocks.append(at)
        if name in SIBLINGS or name in LISTS:
            self.marks.append(at)
        if name in INERT:
            self.inert.append(at)
        self.parts += bool(part)
        self.articles += name in ("article", "main")
        self.headings += name in HEADINGS
        self.n_links += name == "a" and not self.parts

    def pop(self):
        name, part, begin = self.stack.pop()
        at = len(self.stack)
        self.open[name].pop()
        for places in (self.blocks, self.marks, self.inert):
            if places and places[-1] == at:
                places.pop()
        self.parts -= bool(part)
        self.articles -= name in ("article", "main")
        self.headings -= name in HEADINGS
        if self.articles and (part is None or name == "ul"):
            held = [x for x, y in zip(self.label[begin:], self.out[begin:]) if part is not None or not y[3]]
            n = sum(x[2] for x in held)
            if held and all(x[0] for x in held) and (part is None or n > 1 and sum(x[1] for x in held) < EDGE * n):
                self.out[begin:] = [(x[0], True, *x[2:]) for x in self.out[begin:]]

    def pop_to(self, at: int):
        while len(self.stack) > at:
            self.pop()

    def end(self, name: str):
        """An end tag: closes the nearest element of its name, and what is open inside."""
        if not self.open[name]:
            if name in BLOCK:
                self.flush()
            return
        if self.inert and self.open[name][-1] < self.inert[-1]:
            if name not in BLOCK:  # an inline end tag stays inside
                return
            self.pop_to(self.inert[0])  # the block around ends, and with it what was left open
        if name in BLOCK:
            self.flush()
        self.pop_to(self.open[name][-1])

    def closes(self, name: str):
        """What a start tag closes: an open paragraph before a block, and list items and cells before their like."""
        floor = self.inert[-1] if self.inert else -1
        if name in BLOCK and self.blocks and self.blocks[-1] > floor and self.stack[self.blocks[-1]][0] == "p":
            self.pop_to(self.blocks[-1])
        for at in reversed(self.marks) if name in SIBLINGS else ():
            other = self.stack[at][0]
            if at < floor or other in LISTS or other == "tr" and name in ("td", "th"):
                break
            if other in SIBLINGS[name]:
                self.pop_to(at)
                if name != "tr" or other == "tr":  # a row ends the cell, then the row before it
                    break


def lines(page: str) -> list[tuple[str, bool, bool, bool]]:
    """(text, is a page part or mostly links, inside an article or main element, is a heading) of a page's blocks, in order."""
    p, frames, at, n = _Page(), _frames(page), 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            p.add(page[at:])
            break
        if lt > at:
            p.add(page[at:lt])
        m = _TOKEN.match(page, lt)
        if not m:
            p.add("<")  # a sign, not a tag
            at = lt + 1
            continue
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                p.add(re.sub(r"\]\]>\Z", "", m[0][9:]))
            continue
        if name == "br":
            p.add(" ")
            continue
        if m[1]:
            p.end(name)
            continue
        attrs = m[3] or ""
        inside = p.stack[p.inert[-1]][0] if p.inert else ""
        if inside == "select":  # it holds options, and another control ends it
            if name not in ("select", "input", "textarea", "button"):
                if name in RAW:
                    at = _after(page, name, at)
                continue
            p.pop_to(p.inert[-1])
            if name == "select":
                continue
        elif inside == "svg" and name in BLOCK and name != "title" and not p.open["foreignobject"] and not p.open["desc"]:
            p.pop_to(p.inert[-1])  # text of the page ends a drawing that was left open
        if name in BLOCK:
            p.flush()
        p.closes(name)
        if name in VOID or attrs.rstrip().endswith("/") and name not in BLOCK and name != "a":
            continue
        if name in RAW:
            at = _after(page, name, at)
            continue
        part = False if name == "form" and lt in frames else _is_part(name, attrs, p.articles > 0 or name == "article")
        p.push(name, part)
    p.pop_to(p.inert[0] if p.inert else len(p.stack))
    p.flush()
    p.pop_to(0)
    return p.out


def _after(page: str, name: str, at: int) -> int:
    """The place after the end tag of an element whose content is no markup."""
    end = _RAW_END[name].search(page, at)
    return end.end() if end else len(page)


_RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}


def regions(lengths: np.ndarray, surge: int) -> np.ndarray:
    """Which lines lie between a surge point and the dive point after it."""
    n = len(lengths)
    keep = np.zeros(n, bool)
    if not n:
        return keep
    total = np.concatenate([[0], np.cumsum(lengths)])
    window = total[np.minimum(np.arange(n) + WINDOW, n)] - total[:n]
    i = 0
    while i < n:
        up = np.flatnonzero(window[i:] > surge)
        if not len(up):
            break
        start = i + int(up[0])
        down = np.flatnonzero(window[start:] == 0)
        i = start + int(down[0]) if len(down) else n
        keep[start:i] = True
    return keep


def main_text(page: str | None) -> str:
    """The article of a page, blocks joined by two line feeds; empty for null, empty and text-free pages."""
    got = lines(page or "")
    if not got:
        return ""
    inside = any(a and not p for _, p, a, _ in got)
    lengths = np.array([0 if p or (inside and not a) else len(t) for t, p, a, _ in got])
    keep = regions(lengths, 0 if inside else SURGE)
    if keep.any() and not inside:
        label = np.array([len(t) < EDGE and not h and not re.search(r"[.!?:;…\"')\]»”]$", t) for t, _, _, h in got])
        keep = _trim(keep, label | (lengths == 0))
    if not keep.any():
        keep = regions(lengths, 0)
    return "\n\n".join(x[0] for x, k, size in zip(got, keep, lengths) if k and size)


def _trim(keep: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Regions without the labels at their edges."""
    keep = keep.copy()
    edge = np.flatnonzero(np.diff(np.concatenate([[0], keep.astype(np.int8), [0]])))
    for a, b in zip(edge[::2], edge[1::2]):
        text = np.flatnonzero(~label[a:b])
        first, last = (a + text[0], a + text[-1] + 1) if len(text) else (b, b)
        keep[a:first] = False
        keep[last:b] = False
    return keep


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` (or its ``keep`` columns) plus ``text`` string and ``n_chars`` long (its code points).

    A null page has an empty text. Rows are independent: repeated rows give repeated results, an empty table an empty
    one. Input columns named like the outputs are replaced.
    """
    def make():
        def f(texts, _, __):
            got = [main_text(x) for x in texts.to_pylist()]
            return {"text": pa.array(got, pa.string()), "n_chars": pa.array([len(x) for x in got], pa.int64())}
        return f

    return B.append(pages, html, keep, "text string, n_chars bigint", make)
