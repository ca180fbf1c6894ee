"""Main text of web pages: a tree of elements, points for paragraphs, the best container and its siblings."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style noscript template title textarea iframe noembed noframes object svg math canvas audio video map".split())
FURNITURE = frozenset("nav header footer aside menu dialog form fieldset button select datalist input label".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
CELLS = frozenset(["td", "th"])
FENCES = frozenset("table td th caption button object template html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl dir menu".split())
CONTENT = HEADINGS | LISTS | frozenset("p pre blockquote table figure hgroup".split())
TABLE_PARTS = frozenset("table caption tbody thead tfoot tr td th".split())
HEAD_ONLY = frozenset("html head title meta link script style base noscript template".split())
LEAVES = CONTENT | TABLE_PARTS - {"td", "th"} | frozenset("li dt dd figcaption address summary legend option optgroup hr".split())
#: An opening tag of the key ends an open element of the value, down to the nearest of the fence.
CLOSES = {
    "li": (("li",), LISTS),
    "dt": (("dt", "dd"), LISTS),
    "dd": (("dt", "dd"), LISTS),
    "tr": (("tr", "td", "th"), frozenset(["table"])),
    "td": (("td", "th"), frozenset(["table", "tr"])),
    "th": (("td", "th"), frozenset(["table", "tr"])),
    "tbody": (("tbody", "thead", "tfoot", "caption"), frozenset(["table"])),
    "thead": (("tbody", "thead", "tfoot", "caption"), frozenset(["table"])),
    "tfoot": (("tbody", "thead", "tfoot", "caption"), frozenset(["table"])),
    "option": (("option",), frozenset(["select", "datalist"])),
    "body": (("head",), frozenset(["html"])),
}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form tablist".split())
# Words of class and id names. The first kind is never article text; the second only lays a page out.
NEVER = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion comment comments "
    "disqus respond reply replies cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup social share sharing "
    "breadcrumb breadcrumbs pagination pager related recommended recommendations outbrain taboola skip login hidden disclaimer".split()
)
LAYOUT = frozenset("nav navbar navigation menu menus sidebar sidebars header masthead footer banner notice notices widget widgets toolbar topbar search form".split())
HEADER = frozenset(["header"])
# First words of names that do not name the element itself.
SILENT = frozenset("has with no without hide show category tag type status format theme js".split())
MENUS = LISTS | frozenset("div section table nav".split())
STOPS = frozenset(".!?…。！？")

SHORT_COMMENT = re.compile(r"-?>")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for name in RAW}
COMMENT_END = re.compile(r"--!?>")
TAG = re.compile(
    r"""<(?:!--(?P<comment>)|[!?][^>]*+(?:>|\Z)|/[^a-zA-Z>][^>]*+(?:>|\Z)|/>"""
    r"""|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z))"""
)
ATTR = re.compile(r"""([^\s=/"'>]++)\s*+(?:=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]++)))?+""")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
COMMAS = re.compile("[,،、，]")

LONG = 25
LEVELS = 4
#: Share of the best container's points that a sibling needs, and link density from which a part is a menu.
SIBLING = 0.2
DENSE = 0.5
MENU = 0.8


class Page:
    """Elements in page order (parents first) and the pieces of text with their element.

    A piece is (element, text); text None ends a block, and comes wherever a block element starts or ends.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.attrs = ["html"], [-1], [{}]
        self.pieces: list[tuple[int, str | None]] = []
        self.stack, self.fences, self.blocks = [0], [0], [0]
        self.where: dict[str, list[int]] = {"html": [0]}  # depths at which an element of the name is open
        self._read(source)

    def _open(self, name: str, attrs: str) -> None:
        depth = len(self.stack)
        self.where.setdefault(name, []).append(depth)
        block = name in BLOCK
        if block or name in CELLS:
            self.blocks.append(depth)
        if name in FENCES:
            self.fences.append(depth)
        self.parent.append(self.stack[-1])
        self.tag.append(name)
        self.attrs.append(noted(attrs))
        self.stack.append(len(self.tag) - 1)
        if block or name in CELLS:
            self.pieces.append((self.stack[-1], None if block else " "))

    def _close_to(self, depth: int) -> None:
        """Close all elements at this depth and below."""
        while len(self.stack) > depth:
            name = self.tag[self.stack.pop()]
            self.where[name].pop()
            block = name in BLOCK
            if block or name in CELLS:
                self.blocks.pop()
                self.pieces.append((self.stack[-1], None if block else " "))
            if name in FENCES:
                self.fences.pop()

    def _depth(self, name: str) -> int:
        depths = self.where.get(name)
        return depths[-1] if depths else -1

    def _start(self, name: str, attrs: str) -> None:
        if name in ("html", "body") and self._depth(name) >= 0:
            return
        if self._depth("head") >= 0 and name not in HEAD_ONLY:
            self._close_to(self._depth("head"))
        if name in BLOCK and self._depth("p") > self.fences[-1]:
            self._close_to(self._depth("p"))
        if name in CLOSES:
            ends, fence = CLOSES[name]
            low = max(map(self._depth, fence))
            ended = [d for d in map(self._depth, ends) if d > low]
            if ended:
                self._close_to(min(ended))
        if name in HEADINGS and self.tag[self.stack[-1]] in HEADINGS or name == "a" and self._depth("a") > self.blocks[-1]:
            self._close_to(len(self.stack) - 1 if name != "a" else self._depth("a"))
        if name == "br":
            self.pieces.append((self.stack[-1], " "))
        elif name == "hr":
            self.pieces.append((self.stack[-1], None))
        elif name not in VOID:
            self._open(name, attrs)
            if attrs.endswith("/") and self._depth("svg") + self._depth("math") > -2:
                self._close_to(len(self.stack) - 1)

    def _end(self, name: str) -> None:
        """Close the element; what does not fit stays open: over a cell's bounds, or an inline element over a block's."""
        if name == "br":
            self.pieces.append((self.stack[-1], " "))
            return
        if name in TABLE_PARTS:
            guard = self._depth("table") if name != "table" else 0
        else:
            guard = self.fences[-1] if name in BLOCK else self.blocks[-1]
        if name not in ("html", "body") and self._depth(name) >= max(guard, 0):  # what follows </body> is still page
            self._close_to(self._depth(name))

    def _text(self, raw: str) -> None:
        if self._depth("head") == len(self.stack) - 1 and not raw.isspace():
            self._close_to(self._depth("head"))
        self.pieces.append((self.stack[-1], html.unescape(raw)))

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            m = TAG.search(source, at)
            if m is None:
                self._text(source[at:])
                return
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            if m["comment"] is not None:
                short = SHORT_COMMENT.match(source, at)
                end = short or COMMENT_END.search(source, at)
                at = end.end() if end else n
            elif m["name"]:
                name = m["name"].lower()
                if m["close"]:
                    self._end(name)
                elif name in RAW:
                    end = RAW_END[name].search(source, at)
                    at = end.end() if end else n
                else:
                    self._start(name, m["attrs"])


def noted(attrs: str) -> dict[str, str]:
    """Attributes by small name; the first of a name counts."""
    found: dict[str, str] = {}
    if attrs and not attrs.isspace():
        for m in ATTR.finditer(attrs):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def names(attrs: dict[str, str]) -> list[list[str]]:
    """Words of each class and id name, in small letters."""
    found = (attrs.get("class", "") + " " + attrs.get("id", "")).split()
    return [[w.lower() for w in PARTS.findall(name)] for name in found]


def named(attrs: dict[str, str], words: frozenset[str]) -> bool:
    """Whether a class or id name has one of the words. Names like ``no-ads`` and ``category-cookies`` say nothing."""
    if not ("class" in attrs or "id" in attrs):
        return False
    return any(not words.isdisjoint(parts) and parts[0] not in SILENT for parts in names(attrs) if parts)


def main_text(source: str | None) -> str:
    """Blocks of the article in page order, joined by two line feeds; see ``extract``."""
    if not source or source.isspace():
        return ""
    page = Page(source)
    tag, parent, attrs = page.tag, page.parent, page.attrs
    n = len(tag)

    # what never is article text, and what usually is not
    never, rather, link, block = [False] * n, [False] * n, [False] * n, [0] * n
    in_article = [False] * n
    holds_main = [False] * n
    for i in range(n):
        up, name, own = parent[i], tag[i], attrs[i]
        block[i] = i if name in BLOCK or name in CELLS or i == 0 else block[up]
        if i == 0:
            continue
        link[i] = link[up] or (name == "a" and "href" in own)
        in_article[i] = in_article[up] or name in ("article", "main") or own.get("role") == "main"
        bad = name in UNSEEN or name in FURNITURE and name not in ("form", "fieldset", "header")
        soft = name in ("form", "fieldset", "header")
        if own and not bad:
            bad = "hidden" in own or own.get("aria-hidden") == "true" or bool(INVISIBLE.search(own.get("style", "")))
            if name not in ("body", "main") and own.get("role") != "main":
                bad = bad or own.get("role", "").lower() in ROLES or named(own, NEVER)
                soft = soft or name != "article" and named(own, LAYOUT)
        never[i] = never[up] or bad
        rather[i] = soft
    for i in range(n - 1, 0, -1):
        if holds_main[i] or (tag[i] == "main" or attrs[i].get("role") == "main") and not never[i]:
            holds_main[parent[i]] = True

    # letters and commas of each block's own text
    size, linked, commas, last = [0] * n, [0] * n, [0] * n, [""] * n
    for i, text in page.pieces:
        if text and not never[i]:
            length = len(text) - text.count(" ")
            size[block[i]] += length
            linked[block[i]] += length if link[i] else 0
            commas[block[i]] += len(COMMAS.findall(text))
            last[block[i]] = text.rstrip()[-1:] or last[block[i]]
    whole, whole_linked, links = size[:], linked[:], [0] * n
    for i in range(n - 1, 0, -1):
        whole[parent[i]] += whole[i]
        whole_linked[parent[i]] += whole_linked[i]
        links[i] += tag[i] == "a" and link[i] and not never[i]
        links[parent[i]] += links[i]
        last[parent[i]] = last[parent[i]] or last[i]
    plain = whole[0] - whole_linked[0]
    gone, heads_only = never[:], [False] * n
    for i in range(1, n):
        up = parent[i]
        gone[i], heads_only[i] = gone[i] or gone[up], heads_only[up]
        if rather[i] and not gone[i] and not holds_main[i] and 2 * (whole[i] - whole_linked[i]) <= plain:
            if in_article[up] and (tag[i] == "header" or named(attrs[i], HEADER)):
                heads_only[i] = True
            else:
                gone[i] = True

    # points of paragraphs for their ancestors
    points = [0.0] * n
    for i in range(n):
        if size[i] and not gone[i] and not heads_only[i] and tag[i] not in HEADINGS:
            gain = (commas[i] + size[i] / 100 + (size[i] >= LONG)) * (1 - linked[i] / size[i])
            node = block[parent[i]] if tag[i] in LEAVES and i else i
            for level in range(1, LEVELS + 1):
                points[node] += gain / level
                if node == 0:
                    break
                node = block[parent[node]]
    best, most = 0, 0.0
    for i in range(n):
        if points[i] and not gone[i] and tag[i] not in LEAVES and tag[i] in BLOCK | CELLS:
            score = points[i] * (1 - whole_linked[i] / whole[i])
            if score > most:
                best, most = i, score
    node = best
    while node and tag[node] != "article":
        node = parent[node]
    best = node or best

    # the container, and the siblings that belong to it
    keep = [False] * n
    keep[best] = True
    home = block[parent[best]] if best else 0
    for i in range(1, n):
        if best and i != best and block[parent[i]] == home and block[i] == i and not gone[i] and whole[i]:
            keep[i] = _belongs(tag[i], tag[home], whole[i], whole_linked[i] / whole[i], points[i], most, last[i], i == best - 1)
    for i in range(1, n):
        if gone[i]:
            keep[i] = False
        else:
            keep[i] = keep[i] or keep[parent[i]]
            if keep[i] and tag[i] in MENUS and links[i] >= 3 and whole_linked[i] >= MENU * whole[i]:
                keep[i], gone[i] = False, True
        if gone[parent[i]]:
            keep[i], gone[i] = False, True
    headed = [False] * n
    for i in range(1, n):
        headed[i] = headed[parent[i]] or tag[i] in HEADINGS

    blocks: list[str] = []
    parts: list[str] = []
    for i, text in page.pieces:
        if text is None:
            blocks.append(" ".join("".join(parts).split()))
            parts = []
        elif text and keep[i] and (not heads_only[i] or headed[i]):
            parts.append(text)
    blocks.append(" ".join("".join(parts).split()))
    return "\n\n".join(b for b in blocks if b)


def _belongs(name: str, home: str, size: int, density: float, points: float, best: float, last: str, before: bool) -> bool:
    """Whether a sibling of the best container is part of the article."""
    if name in HEADINGS:
        return density < DENSE and before or name == "h1"
    if points * (1 - density) >= SIBLING * best:
        return True
    if name in CONTENT or home not in ("body", "html"):
        return density < DENSE and size >= 80 or density == 0 and last in STOPS
    return False


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``pages`` with ``text``, the article's text, and ``n_chars``, its code points, in place of ``html``.

    The page becomes a tree of elements (end tags may be missing or misplaced). Scripts, menus, headers, footers, side
    bars, forms, hidden parts, and parts named as adverts, notices or reader comments go. Each paragraph gives points for
    its length and commas, less its share of link text, to the block that holds it and, by falling shares, to
    ``LEVELS`` ancestors. The block with the most points, less by its link density, is the container; if it lies in an
    ``article``, that is. Siblings stay that have ``SIBLING`` of its points, or are paragraphs of sentences. Lists of nearly only
    links in it go. An article's own header keeps its headings.

    White space in a block is one space; line breaks count as white space, rows of tables as blocks. Nothing else is cut;
    a page without any article text, an empty or null one gives "". Each row is worked on alone, so ties and
    repeated rows need no rule (equal points: the first in the page). Columns named ``text`` or ``n_chars`` are replaced.
    """
    found = pages.withColumn("text", _texts(F.col(html_col).cast("string")))
    return found.withColumn("n_chars", F.length("text").cast("long")).drop(html_col)


def _texts(source):
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(x.as_py()) for x in batch], pa.string())

    return run(source)
