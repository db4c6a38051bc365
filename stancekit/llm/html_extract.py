"""Main text of HTML pages by minimum-cut labelling of text blocks.

A page is read into blocks (the text between borders of block-level elements). A linear
classifier over the elements around a block, its links, length and form gives a cost: the
capacity to the source (content) or to the sink (boilerplate). Smoothness edges join
neighbours on the page and neighbours below the same element, stronger the more of their
DOM path they share. The minimum cut, by maximum flow, labels the blocks.
"""
from __future__ import annotations

import html as entities
import math
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# names of elements (fixed values of HTML)
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary
table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("""script style noscript template textarea title svg math iframe object canvas audio video select button
head datalist map""".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
#: an opening tag ends an open element of these names
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tr", "td", "th"}, "tfoot": {"tr", "td", "th", "tbody"},
}
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "title"}
SCOPE = frozenset("table ul ol dl select body html article section div aside nav main form blockquote td th".split())

# words in class, id and role that speak for or against an element
AGAINST = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments
complementary consent contentinfo cookie cookies copyright credits cta dialog disclaimer disqus footer form gdpr header hidden
infobar legal login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination
popup promo promoted promotion recommend recommended recommendations related replies reply respond rss search share sharing
shoutbox sidebar signin signup skip skyscraper social sponsor sponsored sponsors subscribe subscription tags teaser tool toolbar
toolbox tracking widget widgets alert alerts cart captcha feedback rating ratings""".split())
FOR = frozenset("article articlebody body content entry main maincontent page post postbody story text".split())
AGAINST_TAGS = {"nav": -6.0, "footer": -6.0, "aside": -6.0, "form": -6.0, "menu": -6.0, "dialog": -6.0, "fieldset": -4.0}
FOR_TAGS = {"article": 5.0, "main": 4.0}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TELLING = frozenset("class id role style hidden aria-hidden itemprop".split())
_NEXT_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK - {'option', 'optgroup'}))})(?=[\s/>])", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")


class Element:
    __slots__ = ("name", "up", "depth", "weight", "own", "content")

    def __init__(self, name: str, up: "Element | None", weight: float):
        self.name, self.up, self.own = name, up, weight
        self.depth = up.depth + 1 if up else 0
        self.weight = 0.0
        self.content = False        # holds an article, main or first heading


def element_weight(name: str, attrs: str, in_article: bool) -> float:
    """What an element says about the text in it."""
    w = AGAINST_TAGS.get(name, 0.0) + FOR_TAGS.get(name, 0.0)
    if name == "header" and not in_article:
        w -= 6.0
    if attrs and name not in ("html", "body"):
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key not in _TELLING:
                continue
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                w -= 8.0
            elif key == "style":
                w -= 8.0 if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) else 0.0
            elif key != "hidden":
                words = set()
                for token in value.split():
                    own = {x.lower() for x in _WORDS.findall(token)}
                    words |= own - {"hidden"} if own & {"overflow", "backface"} else own      # these hide no text
                if words & AGAINST:
                    w -= 6.0
                elif words & FOR or value.lower() in FOR:
                    w += 2.5
    return w


def matching_ends(page: str, name: str, start: int) -> dict[int, int]:
    """Where the element of each opening tag ``name`` from ``start`` on ends, by the tag's position;
    tags without an end tag are left out, self-closing ones hold nothing."""
    ends, opened = {}, []
    for t in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*>", re.I).finditer(page, start):
        if not t[1]:
            if not t[0].endswith("/>"):
                opened.append(t.start())
        elif opened:
            ends[opened.pop()] = t.end()
    return ends


class Block:
    __slots__ = ("text", "linked", "at", "heading", "item")

    def __init__(self, text: str, linked: int, at: Element, heading: bool, item: bool):
        self.text, self.linked, self.at, self.heading, self.item = text, linked, at, heading, item


def blocks(page: str) -> list[Block]:
    """Text blocks in page order. Markup that is broken off or not closed never raises."""
    out: list[Block] = []
    root = Element("", None, 0.0)
    stack = [root]
    buffer: list[str] = []
    linked = links = articles = 0
    n, pos, odd = len(page), 0, False
    ends_of: dict[str, dict[int, int]] = {}
    bare: set[str] = set()      # elements of raw text that have no end tag from here on

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                names = [e.name for e in stack[-4:]]
                out.append(Block(text, linked, stack[-1], any(x in ("h1", "h2", "h3", "h4", "h5", "h6") for x in names), "li" in names))
            buffer.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            buffer.append(text)
            if links:
                linked += len(text.strip())

    def pop(to: int) -> None:
        nonlocal articles, links
        for e in stack[to:]:
            if e.name in ("article", "main"):
                articles -= 1
        links = 0
        del stack[to:]

    while pos < n:
        lt = page.find("<", pos)
        if lt < 0:
            say(page[pos:])
            break
        if lt > pos:
            say(page[pos:lt])
        nxt = page[lt + 1:lt + 2]
        if nxt == "!" or nxt == "?":
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                pos = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                pos = n if end < 0 else end + 1
            continue
        m = None if odd else _TAG.match(page, lt)
        if m is None:
            m = _PLAIN.match(page, lt)
            odd = odd or m is not None          # a quote is left open: from here on the plain rule holds
        if m is None:
            if nxt == "/" or nxt.isalpha():
                pos = n if page.find(">", lt) < 0 else page.find(">", lt) + 1     # a tag that is broken off
            else:
                say("<")
                pos = lt + 1
            continue
        closing, name, attrs = m[1], m[2].lower(), m[3]
        pos = m.end()
        if not closing:
            if name in RAW and not attrs.endswith("/"):
                end = None if name in bare else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, pos)
                if end:
                    pos = end.end()
                elif name in ("script", "style"):
                    pos = n
                else:               # not closed: its own text goes, up to the next tag
                    bare.add(name)
                    lt = page.find("<", pos)
                    pos = n if lt < 0 else lt
                continue
            if name in SKIPPED and name != "head":
                if attrs.endswith("/"):
                    continue
                if name not in ends_of:
                    ends_of[name] = matching_ends(page, name, lt)
                if lt in ends_of[name]:
                    pos = ends_of[name][lt]
                elif name in ("select", "datalist"):        # not closed: its options go
                    border = _NEXT_BLOCK.search(page, pos)
                    pos = border.start() if border else pos
                continue                                    # any other that is not closed: the tag alone
            if name == "br":
                buffer.append(" ")
                continue
            if name == "a":
                links = 1
                continue
            if name in VOID or name not in BLOCK:
                if name == "hr":
                    flush()
                continue
            flush()
            ends = CLOSES.get(name, ()) if name in CLOSES else ()
            for k in range(len(stack) - 1, 0, -1):
                e = stack[k].name
                if e in ends or e == "p" and name in ENDS_P:
                    pop(k)
                elif e in SCOPE or not ends and e != "p":
                    break
            e = Element(name, stack[-1], element_weight(name, attrs, articles > 0))
            if name in ("article", "main"):
                articles += 1
            if name in ("article", "main", "h1"):
                up = e.up
                while up is not None and not up.content:
                    up.content = True
                    up = up.up
            stack.append(e)
            links = 0
            if attrs.endswith("/") and name != "p":
                pop(len(stack) - 1)
        elif name == "a":
            links = 0
        elif name in BLOCK:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    flush()
                    pop(k)
                    break
                if stack[k].name in ("article", "body", "main") and name not in ("article", "body", "main", "html"):
                    break       # a stray end tag does not close what holds the text
    flush()
    return out


def cost(b: Block) -> float:
    """Log-odds that a block is content."""
    path, e = 0.0, b.at
    weights = []
    while e is not None:
        w = e.own
        if w < 0 and e.content and e.name not in ("nav", "aside", "footer", "form"):
            w = 0.0             # a wrapper of the article cannot speak against it
        weights.append(w)
        e = e.up
    path = min(weights) if min(weights) < 0 else max(weights)
    words = b.text.count(" ") + 1
    s = path + (-0.5 if path == 0 else 0.0)
    s += min(2.0, math.log(words) / 1.5) - 1.0
    s -= 4.0 * min(1.0, b.linked / max(1, len(b.text)))
    s += 0.5 if b.text[-1] in ".!?:;\"')…。»”" else 0.0
    s += 1.0 if b.heading else 0.0
    s -= 0.5 if b.item else 0.0
    return s


def shared_path(a: Element, b: Element) -> tuple[Element, float]:
    """The lowest common element, and the share of the longer path above it."""
    x, y = a, b
    while x is not y:
        if x.depth >= y.depth:
            x = x.up
        else:
            y = y.up
    return x, (x.depth + 1) / (max(a.depth, b.depth) + 1)


def edges(found: list[Block], strength: float = 1.0) -> list[tuple[int, int, float]]:
    """Page neighbours, and neighbours below the same element (skipping what lies between)."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            before = found[i - 1].at
            out.append((i - 1, i, strength * shared_path(before.up or before, b.at.up or b.at)[1] ** 2))
        parent = b.at.up or b.at
        j = last.get(id(parent))
        if j is not None and j != i - 1:
            out.append((j, i, 0.5 * strength))
        last[id(parent)] = i
    return out


def min_cut(costs: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source side of a minimum cut: costs above zero are capacities
    from the source, below zero to the sink, links hold both ways (Dinic's phases)."""
    n = len(costs)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, c: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(c)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, c in enumerate(costs):
        if c > 0:
            join(s, i, c, 0.0)
        elif c < 0:
            join(i, t, -c, 0.0)
    for a, b, c in links:
        join(a, b, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for k in out[a]:
                if cap[k] > tiny and level[to[k]] < 0:
                    level[to[k]] = level[a] + 1
                    queue.append(to[k])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[k] for k in path)
                for k in path:
                    cap[k] -= flow
                    cap[k ^ 1] += flow
                cutoff = next(i for i, k in enumerate(path) if cap[k] <= tiny)
                a = to[path[cutoff] ^ 1]
                del path[cutoff:]
                continue
            while at[a] < len(out[a]):
                k = out[a][at[a]]
                if cap[k] > tiny and level[to[k]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(out[a]):
                path.append(k)
                a = to[k]
            elif a == s:
                break
            else:
                level[a] = -1
                k = path.pop()
                a = to[k ^ 1]


def main_text(page: str | None) -> str:
    """Content blocks in page order, joined by an empty line; empty if there are none."""
    found = blocks(page or "")
    if not found:
        return ""
    keep = min_cut([cost(b) for b in found], edges(found))
    return "\n\n".join(b.text for b, k in zip(found, keep) if k)


def extract(page: Column) -> Column:
    """Main text of whole pages (null: empty)."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x) for x in column.to_pylist()], pa.string())

    return run(page)


def extract_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars (code points) of every row. Map-only: rows with null or equal
    keys stay rows of their own, other columns are ignored."""
    return pages.select(*keep, extract(F.col(html_col)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
