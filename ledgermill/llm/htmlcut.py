"""Main-text extraction from HTML by minimum-cut labelling of blocks.

A page becomes text blocks. A classifier of a block's text (length, links, element) gives it
a cost for content or for boilerplate: its capacity from or to the terminals. Elements whose
name or class tells what they hold are nodes too, with a bounded capacity for each block in
them. Smoothness edges tie a block to its nearest telling element, to its neighbours on the
page and to the block before it under one parent. A maximum flow separates content from
boilerplate at the least total cost, often against a block's own text.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

# A quote only opens an attribute's value right after its equals sign; one that never closes is a letter.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>=]|=)*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_TELLING = frozenset("class id role itemprop".split())
# Fixed values of the HTML standard: elements that make blocks, hold no text, or have no end tag.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
OPAQUE = frozenset("script style noscript template svg math iframe object audio video canvas head title textarea select button option datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEAVES = frozenset("p li dd dt h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Containers that tell a block's kind by their element or by words of their class, id or role.
BAD_TAGS = frozenset("nav header footer aside form menu dialog".split())
GOOD_TAGS = frozenset("article main".split())
BAD_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|menu|nav\w*|navbar|breadcrumbs?|sidebar|side|aside|widget\w*|related|recommend\w*|share|sharing|social|footer|header|masthead|topbar|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|comments?|disqus|replies|respond|reactions|pagination|pager|tags|copyright|legal|disclaimer|skip)(?=$|[\s_-])",
    re.I,
)
GOOD_WORDS = re.compile(r"(?:^|[\s_-])(?:article\w*|post|entry|content|main\w*|story|text|body|articlebody)(?=$|[\s_-])", re.I)
# Those of BAD_WORDS that also name the looks or the subject of an article's own parts.
WEAK_WORDS = re.compile(r"share|sharing|social|side|legal|disclaimer|copyright|tags|search|skip", re.I)
#: Costs of the classifier: length and its most, links, headings, bias, blocks outside a page's telling elements.
LENGTH_COST, LONGEST, LINK_COST, HEADING, BIAS, OUTSIDE = 1.2, 5.0, 4.0, 0.5, -1.0, 6.0
#: Edges: neighbours, siblings, and a block's tie to its telling element, which is also that element's capacity for each block:
#: to boilerplate (adverts and comments read like articles, so only their elements tell), and to content, which links outweigh.
ADJACENT, SIBLING, TIE, GOOD = 0.6, 0.8, 14.0, 4.5
#: Capacity of an element inside content that a weak word calls boilerplate, once and for each block; long text outweighs it.
DOUBT, DOUBT_EACH, LINKED = 5.0, 3.0, 0.3
#: Share of a page's unlinked text from which a class name like "sidebar" on its holder is not believed, if nothing else tells of content.
MOST = 0.7


@dataclass
class Block:
    tag: str
    parent: int
    hint: int
    depth: int
    text: str = ""
    linked: int = 0
    parts: list[str] = field(default_factory=list)


@dataclass
class Hint:
    """An element that tells what it holds: kind 1 content, -1 boilerplate; by its name or by its class only, and that by weak words only."""

    kind: int
    by_name: bool
    above: int
    weak: bool = False


def _kind(tag: str, attrs: str) -> tuple[int, bool, bool]:
    """-1 boilerplate, 1 content, 0 no hint, -2 hidden; whether the element's name says so, or only weak words do.

    Class names of body and html tell of the whole page, and names of both kinds tell nothing.
    """
    names = []
    if attrs and not attrs.isspace():
        for name, a, b, c in _ATTRIBUTE.findall(attrs):
            name = name.lower()
            if name == "hidden" or name == "aria-hidden" and (a or b or c).lower() == "true":
                return -2, True, False
            if name in _TELLING:
                names.append(a or b or c)
    if tag in BAD_TAGS:
        return -1, True, False
    if tag in ("body", "html"):
        return 0, False, False
    words = " ".join(names)
    weak = all(WEAK_WORDS.fullmatch(m.strip(" \t\n\f\r_-")) for m in BAD_WORDS.findall(words))
    bad, good = bool(BAD_WORDS.search(words)), bool(GOOD_WORDS.search(words)) and tag != "p"
    if tag in GOOD_TAGS:
        return (-1, False, weak) if bad and not good else (1, True, False)
    return (-1 if bad and not good else 1 if good and not bad else 0), False, weak


def blocks_of(page: str) -> tuple[list[Block], list[Hint]]:
    """Text blocks in page order and the telling elements. Unclosed and stray tags are tolerated.

    Every tag costs the same at any depth: open elements are counted by name, and a search
    down the stack ends at the first block element or takes off what it passes.
    """
    out: list[Block] = []
    hints: list[Hint] = []
    stack: list[tuple[str, int, int, bool]] = [("", 0, -1, False)]  # element, its number, nearest hint, is its text left out
    open_now: dict[str, int] = {}
    count, pos, opaque, links = 0, 0, 0, 0
    now: Block | None = None

    def flush() -> None:
        nonlocal now
        if now is not None:
            now.text = " ".join("".join(now.parts).split())
            if now.text:
                out.append(now)
            now = None

    def add(raw: str) -> None:
        nonlocal now
        if opaque or not raw:
            return
        text = html.unescape(raw)
        if now is None:
            if not text.strip():
                return
            at = len(stack) - 1
            while at and stack[at][0] not in BLOCKS:
                at -= 1
            tag = stack[at][0]
            now = Block(tag, stack[at - 1][1] if at and tag in LEAVES else stack[at][1], stack[-1][2], len(stack))
        now.parts.append(text)
        if links:
            now.linked += len(text.strip())

    def close(at: int) -> None:
        nonlocal links, opaque
        for s in stack[at:]:
            open_now[s[0]] -= 1
            links -= s[0] == "a"
            opaque -= s[3]
        del stack[at:]

    def above(tag: str, stop: bool) -> int:
        """The place of the innermost ``tag``, 0 if none; with ``stop`` no block element may lie over it."""
        if not open_now.get(tag):
            return 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                return k
            if stop and stack[k][0] in BLOCKS:
                return 0
        return 0

    for m in _TOKEN.finditer(page):
        if m.start() < pos:
            continue
        add(page[pos : m.start()])
        pos = m.end()
        if m[1] is not None:
            add(m[1])
        if m[3] is None:
            continue
        closing, tag = m[2] == "/", m[3].lower()
        if tag in VOID:
            if tag == "hr":
                flush()
            elif now is not None:
                now.parts.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if closing:
            at = above(tag, tag not in BLOCKS)
            if at:
                close(at)
            continue
        if tag in CLOSES_P:
            at = above("p", True)
            if at:
                close(at)
        if m[4].endswith("/") and tag not in BLOCKS and tag not in OPAQUE:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, pos)
            pos = end.end() if end else len(page)
            continue
        count += 1
        kind, by_name, weak = _kind(tag, m[4])
        near = stack[-1][2]
        if abs(kind) == 1:
            hints.append(Hint(kind, by_name, near, weak))
            near = len(hints) - 1
        left_out = tag in OPAQUE or kind == -2
        stack.append((tag, count, near, left_out))
        open_now[tag] = open_now.get(tag, 0) + 1
        links += tag == "a"
        opaque += left_out
    add(page[pos:])
    flush()
    return out, hints


def kinds_of(blocks: list[Block], hints: list[Hint]) -> tuple[list[int], list[int]]:
    """What each telling element says of what is in it, and the weakly named element around it that doubts it, or -1.

    Boilerplate wins over content around it, unless only a weak word tells of it: then what is
    in it is content in doubt. A class name that calls nearly all of the page's text
    boilerplate, with no content outside it, is about the page's layout and is not believed.
    """
    own, doubted = [0] * len(hints), [-1] * len(hints)
    total = 0
    for b in blocks:
        free = max(0, len(b.text) - b.linked)
        total += free
        if b.hint >= 0:
            own[b.hint] += free
    for k in range(len(hints) - 1, -1, -1):
        if hints[k].above >= 0:
            own[hints[k].above] += own[k]
    said = [h.kind for h in hints]

    def spread() -> list[int]:
        out: list[int] = []
        for k, h in enumerate(hints):
            up = out[h.above] if h.above >= 0 else 0
            doubted[k] = k if said[k] < 0 and h.weak and up > 0 else doubted[h.above] if said[k] <= 0 and h.above >= 0 else -1
            out.append(-1 if up < 0 or said[k] < 0 and doubted[k] != k else 1 if said[k] > 0 or up > 0 else 0)
        return out

    found = spread()
    while not any(b.hint >= 0 and found[b.hint] > 0 for b in blocks):
        outer = next((k for k, h in enumerate(hints) if said[k] < 0 and not h.by_name and own[k] > MOST * total), None)
        if outer is None:
            break
        said[outer] = 0
        found = spread()
    return found, doubted


def cost(b: Block) -> float:
    """The classifier: how much more likely content than boilerplate a block's own text is."""
    density, words = b.linked / max(1, len(b.text)), b.text.count(" ") + 1
    score = BIAS + min(LONGEST, LENGTH_COST * math.log(1 + words / 4)) - LINK_COST * density
    return score + HEADING * (b.tag in ("h1", "h2", "h3")) - 2.0 * (b.tag in ("li", "td")) * (words < 6)


def minimum_cut(score: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut; ``score`` are terminal capacities.

    Maximum flow by shortest level graphs; every search is iterative.
    """
    n = len(score)
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def tie(u: int, v: int, a: float, b: float) -> None:
        out[u].append(len(to))
        to.append(v)
        cap.append(a)
        out[v].append(len(to))
        to.append(u)
        cap.append(b)

    for k, s in enumerate(score):
        if s > 0:
            tie(source, k, s, 0.0)
        elif s < 0:
            tie(k, sink, -s, 0.0)
    for u, v, w in edges:
        tie(u, v, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if cap[e] <= 1e-9)
                u = to[path[first] ^ 1]
                del path[first:]
            while turn[u] < len(out[u]):
                e = out[u][turn[u]]
                if cap[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    break
                turn[u] += 1
            else:
                if not path:
                    break
                level[u] = -1
                u = to[path.pop() ^ 1]
                continue
            path.append(e)
            u = to[e]


def graph(blocks: list[Block], hints: list[Hint]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Terminal capacities of the blocks and the telling elements with blocks, and the edges."""
    kinds, doubted = kinds_of(blocks, hints)
    score, edges, last, nodes = [cost(b) for b in blocks], [], {}, {}
    told = any(b.hint >= 0 and kinds[b.hint] > 0 for b in blocks)

    def tied(k: int, name: tuple[int, int], once: float, each: float, edge: float) -> None:
        node = nodes.setdefault(name, len(blocks) + len(nodes))
        if node == len(score):
            score.append(once)
        score[node] += each
        edges.append((k, node, edge))

    for k, b in enumerate(blocks):
        kind = kinds[b.hint] if b.hint >= 0 else 0
        if kind:
            tied(k, (b.hint, kind), 0.0, kind * (GOOD if kind > 0 else TIE), GOOD if kind > 0 else TIE)
        elif told:
            score[k] -= OUTSIDE
        doubt = doubted[b.hint] if kind > 0 else -1
        if doubt >= 0:
            if b.linked > LINKED * len(b.text):
                score[k] -= TIE
            else:
                tied(k, (doubt, 0), -DOUBT, -DOUBT_EACH, DOUBT + DOUBT_EACH)
        if k:
            edges.append((k - 1, k, ADJACENT / (1 + abs(b.depth - blocks[k - 1].depth))))
        if b.parent in last:
            edges.append((last[b.parent], k, SIBLING))
        last[b.parent] = k
    return score, edges


def label(blocks: list[Block], hints: list[Hint]) -> list[bool]:
    """True for content, for each block."""
    return minimum_cut(*graph(blocks, hints))[: len(blocks)]


def main_text(page: str) -> str:
    blocks, hints = blocks_of(page)
    return "\n\n".join(b.text for b, keep in zip(blocks, label(blocks, hints), strict=True) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.decode("utf-8", "replace")) if x else "" for x in texts_of(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row for each input row, from the whole html.

    Null and empty html give an empty text; ids and urls may be null and rows may repeat.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
