"""Main text of web pages by minimum cut.

A page is taken apart into blocks: the text between two borders of block elements, with the elements around it. A logistic classifier
gives each block the odds of being content; its two costs, -log(p) for calling it content and -log(1 - p) for calling it boilerplate,
are the capacities of its edges to the two terminals. Blocks that follow one another, and blocks that follow one another among
those of one parent or one section, are joined by smoothness edges that are the stronger the nearer the blocks are in the tree. A maximum
flow finds the minimum cut: the labels of least cost in all, so a short paragraph stays with its neighbours and a link list
between two paragraphs goes. Blocks whose own odds outweigh all their edges have their label before any flow, which changes no cut.

What isn't text for readers (head, scripts, styles, templates, comments of the markup, hidden elements) is no block at all. The text of
a block: character references decoded, each stretch of white space (Unicode's) one space, no space at either end; a line break inside
a block is white space. Blocks without text don't count.

A null or empty page has an empty text. Pages are judged one by one: repeated rows, ties, repeated or null page_ids and urls, columns of
any other names and empty tables need no rule of their own. Unclosed, misplaced and unknown tags are borne; a very long page is
read whole, in time that grows with its length (the flow's with its undecided blocks)."""

import html
import math
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, slices

TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*>?|(/?)([A-Za-z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*)(?:>|\Z)|/[^>]*>?)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[a-z]+|[0-9]+")

# Elements whose content is not read, and those that end a block.
RAW = frozenset("script style textarea title noscript template iframe noframes noembed svg object".split())
BORDERS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
    "nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
# Which open elements a start tag ends, and where the search for them stops.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"}}
LIMITS = frozenset("ul ol dl menu table select body html".split())
SECTIONS = frozenset("article aside body dialog div fieldset footer form header main menu nav section table td".split())

# Fixed values of the classifier: log-odds of content by element, by word of a class, id or role, and by shape of the text.
ELEMENT = {
    "nav": -9.0, "footer": -8.0, "aside": -7.0, "form": -7.0, "button": -7.0, "select": -7.0, "menu": -7.0, "fieldset": -5.0, "dialog": -7.0, "search": -7.0, "legend": -4.0,
    "article": 4.0, "main": 3.0, "p": 1.0, "blockquote": 1.0, "pre": 1.0, "h1": 1.5, "h2": 0.6, "h3": 0.4, "h4": 0.2, "h5": 0.2, "h6": 0.2, "figcaption": 0.3, "li": -0.3, "td": -0.2, "address": -1.5, "summary": -0.5,
}
HEADER, HEADER_IN_ARTICLE = -8.0, -0.5
MARK = {
    **dict.fromkeys("nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar pagination pager paging sitemap skip logo".split(), -8.0),
    **dict.fromkeys("ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored sponsors promo promos promotion promoted teaser outbrain taboola".split(), -8.0),
    **dict.fromkeys("comment comments commentlist disqus reply replies respond responses discussion reactions".split(), -8.0),
    **dict.fromkeys("cookie cookies consent gdpr notice notices alert disclaimer popup modal overlay newsletter subscribe subscription signup login paywall".split(), -8.0),
    **dict.fromkeys("share sharing social related recommended recommendations recommend trending popular widget widgets tags tagcloud legal copyright search form feedback complementary contentinfo toc".split(), -6.0),
    **dict.fromkeys("header head".split(), -5.0),
    **dict.fromkeys("meta byline author date timestamp rating tools print".split(), -1.5),
    **dict.fromkeys("article post entry story content main body text prose page hentry".split(), 2.0),
}
#: After these a word tells of what is around an element, as in no-sidebar.
NOT_ITSELF = ("no", "has", "with", "without", "hide", "show")
PRIOR, PER_LOG_LENGTH, PER_STOP, LINKED, NOTICE = -2.0, 0.9, 0.5, -6.0, -3.5
STOP = re.compile(r"[.!?…。！？][\"'»”’)\]]*(?:\s|$)")
LEGAL = re.compile(r"(?i)(?:©|\(c\) ?(?:19|20)\d\d|all rights reserved|copyright\b|privacy policy|terms of (?:use|service))")
#: Log-odds beyond this count as this much; capacities are whole numbers of 1 / UNIT.
MOST, UNIT = 12.0, 1024
#: Strength of an edge between blocks that follow one another, at no distance in the tree; how much of it each step between them
#: leaves; and of one between blocks that follow one another among their parent's or section's.
ADJACENT, DECAY, SIBLING = 2.6, 0.6, 1.3


class Element:
    __slots__ = ("children", "depth", "hidden", "last", "name", "odds", "parent", "within")

    def __init__(self, name: str, parent: "Element | None", odds: float, hidden: bool):
        self.name, self.parent, self.odds, self.hidden, self.last, self.children = name, parent, odds, hidden, -1, 0
        self.depth = parent.depth + 1 if parent else 0
        self.within = bool(parent) and parent.within or name in ("article", "main")


class Block:
    __slots__ = ("linked", "odds", "parent", "text")

    def __init__(self, text: str, linked: int, parent: Element):
        self.text, self.linked, self.parent, self.odds = text, linked, parent, 0.0


def marks_of(attributes: str) -> tuple[float, bool]:
    """Log-odds that an element's class, id and role give (the lowest, else the highest), and whether it is hidden."""
    low = high = 0.0
    hidden = False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id", "role"):
            before = ""
            for word in WORD.findall(value):
                odds = 0.0 if before in NOT_ITSELF else MARK.get(word, 0.0)
                low, high, before = min(low, odds), max(high, odds), word
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
    return low if low < 0 else high, hidden


def opened(name: str, attributes: str, parent: Element) -> Element:
    odds, hidden = marks_of(attributes) if attributes and not attributes.isspace() else (0.0, False)
    odds *= name != "body"  # its marks tell what kind of page it is
    odds += (HEADER_IN_ARTICLE if parent.within else HEADER) if name == "header" else ELEMENT.get(name, 0.0)
    return Element(name, parent, odds, hidden or parent.hidden)


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page that hold text, in order."""
    top = Element("html", None, 0.0, False)
    at, out, parts, linked, in_link, place, n = top, [], [], 0, False, 0, len(page)
    in_head = False

    def close():
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text and not at.hidden:
                out.append(Block(text, min(linked, len(text)), at))
            parts, linked = [], 0

    while place < n:
        m = TAG.search(page, place)
        end = m.start() if m else n
        if end > place and not in_head:
            piece = html.unescape(page[place:end]) if "&" in page[place:end] else page[place:end]
            parts.append(piece)
            if in_link:
                linked += len(piece.strip())
        if not m:
            break
        place, name = m.end(), m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:  # an end tag
            if name == "a":
                in_link = False
            elif name == "head":
                in_head = False
            elif name in BORDERS:
                close()
                to = at
                while to is not None and to.name != name and not (to.name in LIMITS and name in ("li", "td", "th", "tr", "p", "dd", "dt", "option")):
                    to = to.parent
                if to is not None and to.name == name and to.parent is not None:
                    at, in_link = to.parent, False
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, place)
            place = n if stop is None else stop.end()
            continue
        if name == "head":
            in_head = True
        elif name == "a":
            in_link = True
        elif name == "br":
            parts.append(" ")
        elif name == "hr":
            close()
        elif name in BORDERS and name != "html":
            in_head = in_head and name != "body"
            close()
            if at.name == "p" or at.name[0] == "h" and at.name[1:].isdigit():  # neither holds other blocks
                at = at.parent
            if gone := ENDS.get(name):
                to = at
                while to is not None and to.name not in gone and to.name not in LIMITS:
                    to = to.parent
                while to is not None and to.name in gone:
                    at = to = to.parent
            at = opened(name, m[3], at)
    close()
    return out


def score(blocks: list[Block]) -> None:
    """Log-odds of content of each block: what is around it and what its text looks like."""
    for b in blocks:
        odds, e, low, high, names = PRIOR, b.parent, 0.0, 0.0, set()
        while e is not None:
            if e.odds < 0:
                low += e.odds
            elif e.name not in names:
                names.add(e.name)
                high += e.odds
            e = e.parent
        n = len(b.text)
        odds += low + high + PER_LOG_LENGTH * min(6.0, math.log1p(n / 12)) + PER_STOP * min(4, len(STOP.findall(b.text)))
        odds += LINKED * b.linked / n
        if n < 300 and LEGAL.search(b.text):
            odds += NOTICE
        b.odds = max(-MOST, min(MOST, odds))


def edges_of(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness edges i < j with whole capacities."""
    found: dict[tuple[int, int], float] = {}
    for j, b in enumerate(blocks):
        if j:
            x, y, steps = blocks[j - 1].parent, b.parent, 0
            while x is not y:
                if x.depth >= y.depth:
                    x = x.parent
                else:
                    y = y.parent
                steps += 1
            found[j - 1, j] = found.get((j - 1, j), 0.0) + ADJACENT * DECAY**steps
        e = b.parent
        # among the blocks of its parent's parent, and of its section
        for holder in {id(x): x for x in (e.parent or e, section_of(e))}.values():
            if 0 <= holder.last < j - 1:
                found[holder.last, j] = found.get((holder.last, j), 0.0) + SIBLING * DECAY ** (e.depth - holder.depth)
            holder.last = j
    return [(i, j, round(w * UNIT)) for (i, j), w in found.items() if round(w * UNIT) > 0]


def section_of(e: Element) -> Element:
    while e.name not in SECTIONS and e.parent is not None:
        e = e.parent
    return e


def minimum_cut(content: list[int], boilerplate: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """content[i], boilerplate[i]: capacity of i's edge from the content terminal (what calling it boilerplate costs), and to the
    other. Whether each lies on the content side of a minimum cut: the smaller such side. Labels that no cut disputes come first;
    then Dinic's maximum flow over the rest."""
    n = len(content)
    odds, near, label = [c - b for c, b in zip(content, boilerplate, strict=True)], [{} for _ in range(n)], [None] * n
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0) + w
        near[j][i] = near[j].get(i, 0) + w
    free = [sum(x.values()) for x in near]
    queue = deque(i for i in range(n) if abs(odds[i]) >= free[i])
    while queue:
        i = queue.popleft()
        if label[i] is not None or abs(odds[i]) < free[i] or odds[i] == free[i] == 0 and near[i]:
            continue
        label[i] = odds[i] > 0
        for j, w in near[i].items():
            if label[j] is None:
                odds[j] += w if label[i] else -w
                free[j] -= w
                if abs(odds[j]) >= free[j]:
                    queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        place = {i: k for k, i in enumerate(rest)}
        flow = Flow(len(rest) + 2)
        s, t = len(rest), len(rest) + 1
        for i, k in place.items():
            if odds[i] > 0:
                flow.edge(s, k, odds[i], 0)
            elif odds[i] < 0:
                flow.edge(k, t, -odds[i], 0)
            for j, w in near[i].items():
                if label[j] is None and i < j:
                    flow.edge(k, place[j], w, w)
        side = flow.cut(s, t)
        for i, k in place.items():
            label[i] = side[k]
    return label


class Flow:
    """Dinic's maximum flow: levels by breadth, then blocking flows along them, without recursion."""

    def __init__(self, n: int):
        self.out, self.to, self.room = [[] for _ in range(n)], [], []

    def edge(self, a: int, b: int, there: int, back: int) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(c)

    def levels(self, s: int) -> list[int]:
        level, queue = [-1] * len(self.out), deque([s])
        level[s] = 0
        while queue:
            x = queue.popleft()
            for e in self.out[x]:
                if self.room[e] > 0 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        return level

    def cut(self, s: int, t: int) -> list[bool]:
        """Which nodes s still reaches when no more can flow."""
        while (level := self.levels(s))[t] >= 0:
            tried, path, x = [0] * len(self.out), [], s
            while True:
                if x == t:
                    most = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= most
                        self.room[e ^ 1] += most
                    full = next(k for k, e in enumerate(path) if not self.room[e])
                    x = self.to[path[full] ^ 1]
                    del path[full:]
                elif tried[x] < len(self.out[x]):
                    e = self.out[x][tried[x]]
                    if self.room[e] > 0 and level[self.to[e]] == level[x] + 1:
                        path.append(e)
                        x = self.to[e]
                    else:
                        tried[x] += 1
                elif path:
                    x = self.to[path.pop() ^ 1]
                    tried[x] += 1
                else:
                    break
        return [x >= 0 for x in level]


def labelled(page: str) -> list[tuple[Block, bool]]:
    """The blocks of a page, and whether each is content."""
    blocks = blocks_of(page)
    score(blocks)
    keep = lambda odds: round(UNIT * math.log1p(math.exp(odds)))  # noqa: E731  -log(1 - p), or with -odds -log(p)
    return list(zip(blocks, minimum_cut([keep(b.odds) for b in blocks], [keep(-b.odds) for b in blocks], edges_of(blocks)), strict=True))


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b, content in labelled(page or "") if content)


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages: page_id, url, html. page_id, url, text (the content blocks, joined by line feeds), n_chars (its code points), n_blocks and
    n_content (how many blocks there are, and how many are content)."""
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2):
                found = [labelled(x or "") for x in part.column(2).to_pylist()]
                texts = ["\n".join(b.text for b, content in rows if content) for rows in found]
                counts = [pa.array(x, pa.int64()) for x in (map(len, texts), map(len, found), (sum(c for _, c in rows) for rows in found))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), *counts], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_content"])

    return in_arrow(source, run, "page_id long, url string, text string, n_chars long, n_blocks long, n_content long")
