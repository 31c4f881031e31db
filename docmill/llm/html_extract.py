"""The main text of web pages by a minimum cut.

A page is cut into blocks of text at block-level tags. What a block's own words tell, its length, end, links and tag, is
its capacity to the content or the boilerplate terminal. What its surroundings tell comes over edges: a region, all that
lies in one article, menu, footer, named box or readers' part, is a node too, with a capacity that its tag and names
give for each of its blocks, and each block hangs on its region by an edge. Blocks that follow each other, nearest blocks
under one parent, and regions within each other are joined by weaker edges. The minimum cut labels blocks and regions
together: it pays where a block departs from its region, or a region from what its names say.

Before the flow, a node whose own cost exceeds all its edges is settled and folded into its neighbours.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docmill.llm._util import annotate

#: Capacities of edges: blocks in a row, the nearest blocks of one parent, regions within each other; a border between regions weakens the first two.
IN_ROW, SIBLING, NEST, ACROSS = 0.8, 0.4, 0.1, 0.1
#: By kind of region: its capacity for each of its blocks, to content if positive, and that of the edge between it and each.
REGIONS = {"article": (3.6, 4.0), "outside": (-5.8, 6.0), "named": (-2.9, 3.0), "plain": (0.3, 0.5)}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*+>"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|math|object|select|button|canvas|audio|video)\b(?:\"[^\"]*\"|'[^']*'|[^<>\"'])*?(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^<>\"'])*+)>",
    re.S | re.I,
)
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an open element of the first kind is closed by.
_CLOSED_BY = {
    "p": _BLOCK - {"td", "th", "tr"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}), "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}), "tr": frozenset({"tr", "tbody", "tfoot"}), "head": frozenset({"body"}),
}
_ATTR = re.compile(r"([a-zA-Z_:-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CUE = (
    r"(?:ad|ads|advert[a-z0-9]*|banner[a-z0-9]*|sponsor[a-z0-9]*|promo[a-z0-9]*|popup|modal|overlay|cookies?|consent|gdpr|notice[a-z0-9]*|alert|newsletter|subscribe|signup|login|social|shar(?:e|ing)|related|recommend[a-z0-9]*|trending|popular|"
    r"side-?bar[a-z0-9]*|(?:left|right)-?(?:col[a-z0-9]*|rail)|widget[a-z0-9]*|[a-z0-9]*menu[a-z0-9]*|nav[a-z0-9]*|[a-z0-9]+nav|breadcrumb[a-z0-9]*|pager|paginat[a-z0-9]*|foot[a-z0-9]*|[a-z0-9]+footer|masthead|site-?header|page-?header|top-?bar|comments?|disqus|repl(?:y|ies)|discussion|responses?|reviews?|feedback|toc|tags?|byline-?ad|copyright|legal|disclaimer|skip[a-z0-9]*|hidden|toolbar|search[a-z0-9]*)"
)
#: A whole class or id that names boilerplate: cues, with words for a part of a page before and after.
_CUES = re.compile(
    rf"(?:(?:site|page|main|global|top|bottom|left|right|primary|secondary|post|article|entry|user|reader|js|the)[_-]+)*{_CUE}\d*(?:[_-]+(?:{_CUE}|box|buttons?|bar|links?|list|items?|wrap|wrapper|container|section|area|block|inner|panel|content|text|posts?|articles?|stories|title|form|top|bottom|left|right|slot|unit|\d+)\d*)*",
    re.I,
)
_MAIN_CUES = re.compile(r"(?:^|[\s_-])(?:article\w*|main\w*|content\w*|post|entry|story|body-?text|post-?body|entry-?content|text)(?=$|[\s_-])", re.I)
_HEADER = re.compile(r"(?:^|\s)\w*header(?=$|\s)", re.I)
#: A heading after which its parent has readers' words, up to the next heading of its level or a higher one.
_READERS = re.compile(r"(?:\d+ )?(?:reader |user )?(?:comments?|commentaires?|kommentare?|comentarios?|responses?|replies)(?: ?\(\d+\))?:?|leave a (?:comment|reply)|join the (?:discussion|conversation)", re.I)
_LONG_NUMBER = re.compile(r"&#(?:0*[1-9][0-9]{7,};?|0{8,}(?=[0-9]))")
_BAD_TAGS = frozenset("nav footer aside form menu dialog fieldset search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())


class _Element:
    __slots__ = ("tag", "parent", "bad", "main", "number", "cue", "lifts", "chars", "open", "region")

    def __init__(self, tag: str, parent: _Element | None, bad: bool, main: bool, number: int, cue: bool = False, lifts: bool = False):
        self.tag, self.parent, self.bad, self.main, self.number = tag, parent, bad, main, number
        self.cue, self.lifts, self.chars = cue, lifts, 0  # lifts: an article or main
        self.open, self.region = True, self  # the outermost element around with the same marks


@lru_cache(maxsize=1 << 16)
def _named(value: str) -> tuple[bool, bool, bool]:
    """Whether a class or id, of names up to 80 characters, names boilerplate, a header, or the main part."""
    names = " ".join(x for x in value.split() if len(x) <= 80)
    return any(map(_CUES.fullmatch, names.split())), bool(_HEADER.search(names)), bool(_MAIN_CUES.search(names))


def _open(tag: str, attrs: str, parent: _Element | None, number: int) -> _Element:
    bad, main = bool(parent and parent.bad), bool(parent and parent.main)
    if tag in _BAD_TAGS or tag == "header" and not main or tag == "head":
        bad = True
    cue, lifts = False, tag in ("article", "main")
    main = main or lifts
    if attrs.strip():
        for name, *values in _ATTR.findall(attrs):
            name, value = name.lower(), "".join(values)
            if name in ("class", "id"):
                boiler, header, lead = _named(value)
                if (boiler or not main and header) and tag not in ("body", "html", "article", "main"):
                    cue = True
                elif lead and not bad:
                    main = True
            elif name == "role":
                lifts = lifts or value.lower() in ("main", "article")
                bad, main = bad or value.lower() in _ROLES, main or lifts
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                bad = True
    return _Element(tag, parent, bad, main, number, cue, lifts)


def _inherit(elements: list[_Element]) -> None:
    """Hands cues down, given elements in page order with their own characters.

    A wrapper's cue is void: that of an element with the longest article or main inside or, on a page without one, with
    over half of the text that isn't bad. Nor does a cue reach into the longest article or main.
    """
    for e in reversed(elements):
        if e.parent and not e.bad:
            e.parent.chars += e.chars
    lead = max((e for e in elements if e.lifts and not e.bad and e.chars), key=lambda e: e.chars, default=None)
    around, e = set(), lead
    while e:
        around.add(e.number)
        e = e.parent
    whole = elements[0].chars
    for e in elements:
        void = e.number in around if lead else 2 * e.chars > whole
        e.cue = not void and (e.cue or bool(e.parent and e.parent.cue))
        if (up := e.parent) and (up.bad, up.main, up.cue) == (e.bad, e.main, e.cue):
            e.region = up.region


def _level(e: _Element) -> int:
    """1 to 6 for headings; 7 for other elements."""
    return int(e.tag[1]) if re.fullmatch("h[1-6]", e.tag) else 7


def blocks(html: str) -> list[tuple[str, _Element, int, int]]:
    """Text, enclosing element, characters in links and number of the readers' heading above (0: none), of each block with text, in page order."""
    root = at = _Element("", None, False, False, 0)
    elements = [root]
    out: list[tuple[str, _Element, int, int]] = []
    under: tuple[_Element, int] | None = None  # the parent of the readers' heading in force, and its level
    headings = 0
    parts: list[str] = []
    opened: dict[str, int] = {}  # how many elements of a tag are open
    linked, in_link, number, done = 0, 0, 0, 0

    def close(e: _Element) -> _Element:
        e.open = False
        opened[e.tag] -= 1
        return e.parent

    def flush() -> None:
        nonlocal linked, under, headings
        if parts:
            if text := " ".join(unescape(_LONG_NUMBER.sub(lambda m: "&#" if m[0][-1] == "0" and not m[0].strip("&#0") else "\ufffd", "".join(parts))).split()):
                if len(text) < 40 and _READERS.fullmatch(text):
                    if not (under and under[0].open and _level(at) > under[1]):
                        under = at.parent or at, _level(at)
                        headings += 1
                elif under and not (under[0].open and (_level(at) == 7 or _level(at) > under[1])):
                    under = None
                at.chars += len(text)
                out.append((text, at, linked, headings if under else 0))
            parts.clear()
        linked = 0

    def text(a: int, b: int) -> None:
        nonlocal linked
        if b > a:
            parts.append(html[a:b])
            if in_link:
                linked += b - a

    for m in _TOKEN.finditer(html):
        text(done, m.start())
        done = m.end()
        tag = m["tag"]
        if tag is None:
            if (raw := m["raw"]) and raw.lower() in ("title", "svg"):
                continue
            whole = m.group()
            if whole.startswith("<![CDATA["):
                parts.append(whole[9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if tag not in _BLOCK:
            if tag == "a":
                in_link = 0 if m["close"] else 1
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        in_link = 0 if tag not in ("li", "td", "th") or m["close"] else in_link
        if m["close"]:
            if opened.get(tag):
                while at.tag != tag:
                    at = close(at)
                at = close(at)
        else:
            while at is not root and tag in _CLOSED_BY.get(at.tag, ()):
                at = close(at)
            if tag not in _VOID and not m["attrs"].endswith("/"):
                number += 1
                at = _open(tag, m["attrs"], at, number)
                opened[tag] = opened.get(tag, 0) + 1
                elements.append(at)
    text(done, len(html))
    flush()
    _inherit(elements)
    return out


def evidence(text: str, element: _Element, linked: int) -> float:
    """The log odds that a block is content, by itself."""
    n = len(text)
    s = -0.5 + min(n, 240) / 120 + 0.8 * (text[-1] in ".!?…:;\"”»") + 0.4 * (element.tag in ("p", "blockquote", "pre", "h1", "h2", "h3", "h4", "li", "figcaption"))
    s += max(0, min(n, 1440) - 240) / 480 - 3.5 * min(1.0, linked / n)
    return s - 3.0 * (text[0] in "©" or text[:9].lower() == "copyright")


def graph(found: list[tuple[str, _Element, int, int]]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Costs of the blocks, then of the regions, and edges between them by number."""
    any_main = any(e.main and not e.bad and not e.cue for _, e, _, _ in found)
    costs = [evidence(t, e, n) for t, e, n, _ in found]
    regions: dict[tuple[int, int], int] = {}
    edges, last, before = [], {}, None

    def region(e: _Element, readers: int) -> tuple[int, str]:
        if e.bad or any_main and not e.main:
            kind = "outside"
        else:
            kind = "named" if e.cue or readers else "article" if any_main else "plain"
        key = e.region.number, readers
        if key not in regions:
            regions[key] = len(costs)
            costs.append(0.0)
            out, up = regions[key], e.region.parent
            if readers or up:  # the region around: the same without the readers' heading, else the parent's
                edges.append((out, region(e if readers else up, 0)[0], NEST))
        return regions[key], kind

    for i, (_, e, _, readers) in enumerate(found):
        mine, kind = region(e, readers)
        each, bond = REGIONS[kind]
        costs[mine] += each
        edges.append((i, mine, bond))
        if i:
            edges.append((i - 1, i, IN_ROW * (1 if before == mine else ACROSS)))
        parent = e.parent.number if e.parent else -1
        if parent in last:
            j, other = last[parent]
            edges.append((j, i, SIBLING * (1 if other == mine else ACROSS)))
        last[parent], before = (i, mine), mine
    return costs, edges


def cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labels of a minimum cut: node i pays costs[i] if false and positive, -costs[i] if true and negative, and each edge its weight if its ends differ."""
    n = len(costs)
    s = list(costs)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    load = [0.0] * n
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
        load[a] += w
        load[b] += w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:  # a node whose own cost exceeds all its edges has the same label in every minimum cut
        i = todo.popleft()
        if label[i] is None and (abs(s[i]) > load[i] + 1e-9 or not near[i]):
            label[i] = s[i] > 0
            for j, w in near[i].items():
                s[j] += w if label[i] else -w
                load[j] -= w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        reach = _flow(rest, s, near)
        for i in rest:
            label[i] = i in reach
    return [bool(x) for x in label]


def _flow(rest: list[int], s: list[float], near: list[dict[int, float]]) -> set[int]:
    """The source side after maximum flow, by blocking flows on level graphs."""
    place = {i: k for k, i in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    out: list[list[int]] = [[] for _ in range(len(rest) + 2)]  # numbers of edges; an edge's reverse has the number next to it
    to: list[int] = []
    cap: list[float] = []

    def join(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((there, back))

    for i in rest:
        if s[i] > 0:
            join(source, place[i], s[i], 0.0)
        elif s[i] < 0:
            join(place[i], sink, -s[i], 0.0)
        for j, w in near[i].items():
            if i < j:
                join(place[i], place[j], w, w)
    while True:
        level = [-1] * len(out)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for k in out[a]:
                if cap[k] > 1e-9 and level[to[k]] < 0:
                    level[to[k]] = level[a] + 1
                    queue.append(to[k])
        if level[sink] < 0:
            return {i for i, k in place.items() if level[k] >= 0}
        following = [0] * len(out)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                least = min(cap[k] for k in path)
                first = None
                for n, k in enumerate(path):
                    cap[k] -= least
                    cap[k ^ 1] += least
                    if first is None and cap[k] <= 1e-9:
                        first = n
                at = to[path[first] ^ 1]
                del path[first:]
                continue
            edges = out[at]
            while following[at] < len(edges):
                k = edges[following[at]]
                if cap[k] > 1e-9 and level[to[k]] == level[at] + 1:
                    break
                following[at] += 1
            if following[at] < len(edges):
                path.append(k)
                at = to[k]
            elif path:
                at = to[path.pop() ^ 1]
                following[at] += 1
            else:
                break


def labelled(html: str | None) -> list[tuple[str, float, bool]]:
    """Text, own evidence and label of each block."""
    found = blocks(html or "")
    if not found:
        return []
    costs, edges = graph(found)
    return [(t, c, keep) for (t, *_), c, keep in zip(found, costs, cut(costs, edges))]


def main_text(html: str | None) -> str:
    """The content blocks of html, a blank line between; empty if there are none."""
    return "\n\n".join(t for t, _, keep in labelled(html) if keep)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text and n_chars (code points), from the whole of each html; html itself goes.

    A null or empty html, one without text or with boilerplate only has the text "" and 0. Equal pages get equal
    texts; other columns named text or n_chars give way; no rows give no rows.
    """

    def rows(values: list) -> Iterator[tuple]:
        for v in values:
            t = main_text(v)
            yield t, len(t)

    return annotate(pages, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], rows, html).drop(html)
