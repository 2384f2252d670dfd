"""HTML extraction (operator 9): minimum-cut labelling of text blocks.

The page is cut into blocks (runs of text between block-level tags). A linear classifier over each block's place and
shape gives the cost of either label; the costs become capacities from the source (content) and to the sink
(boilerplate). Smoothness edges join neighbours in page order and blocks whose nearest sectioning ancestor is the same.
The maximum flow's cut separates content from boilerplate with the least total cost.

White space inside a block becomes one space; blocks are trimmed and joined by one newline. ``br`` counts as white
space. Scripts, styles, comments of the markup and the like never become blocks; formulas in ``math`` are text of the
block around them, without their annotations.

Nulls and edge cases: null or empty html, or none that is content, gives the empty text and 0; unclosed and stray tags
are put up with; after a tag whose quotes never close, tags end at the next ``>``; a tag without one is text; very long pages are taken whole; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch

# Element names of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("script style noscript template svg annotation annotation-xml textarea select button iframe object canvas audio video title head datalist".split())
RAW_TAGS = frozenset("script style textarea title".split())
SECTIONS = frozenset("article aside body div fieldset footer form header main menu nav section table ul ol dl td dialog".split())
UNWANTED_TAGS = frozenset("nav aside footer form menu dialog search fieldset".split())

# Words in class, id and role values that speak for boilerplate or for content.
UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|breadcrumbs?|byline|comments?|commentlist|consent|cookies?|copyright|disqus|dialog|discussion|feedback|footer|gdpr|header|legal|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|notification|pager|pagination|popup|promo|promoted|recommended|related|replies|reply|respond|responses|search|share|sharing|sidebar|social|sponsor|sponsored|subscribe|tags|teaser|toolbar|widget|alert|skip|login|signup)(?:$|[\s_-])",
    re.I,
)
WANTED = re.compile(r"(?:^|[\s_-])(?:article|content|entry|main|post|story|text|body)(?:$|[\s_-])", re.I)

_TOKEN = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_REST = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\baria-hidden\s*=\s*["']?true|display\s*:\s*none|(?:^|\s)hidden(?=[\s=/]|$)(?=(?:[^"']|"[^"]*"|'[^']*')*$)""", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: Weights of the classifier, in hundredths; positive speaks for content.
WEIGHTS = {"bias": -40, "article": 400, "wanted": 200, "unwanted_tag": -900, "unwanted_name": -700, "header": -500, "header_in_article": -100, "heading": 60, "paragraph": 90, "list_item": -40, "length": 35, "stops": 30, "links": -350}
#: Smoothness, in hundredths: between neighbours in page order of one section, of different ones, and further apart in one.
NEXT_SAME, NEXT_OTHER, SAME_SECTION = 60, 8, 15


class Block:
    __slots__ = ("text", "score", "section")

    def __init__(self, text: str, score: int, section: int):
        self.text, self.score, self.section = text, score, section


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page with their classifier scores (over 0: content)."""
    out: list[Block] = []
    stack: list[tuple] = []  # tag, section, article, wanted, unwanted tag, unwanted name, header, silent
    top = ("", 0, False, False, False, False, False, False)
    parts: list[str] = []
    linked, links, sections, at = 0, 0, 0, 0
    tag_of_block = ""

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html_lib.unescape("".join(parts))).strip()
            if text:
                w = WEIGHTS
                s = w["bias"] + w["length"] * min(8, len(text).bit_length() - 3) + w["stops"] * min(4, sum(map(text.count, ".,!?。，")))
                s += w["article"] * top[2] + w["wanted"] * top[3] + w["unwanted_tag"] * top[4] + w["unwanted_name"] * top[5]
                s += (w["header_in_article"] if top[2] else w["header"]) * top[6]
                s += w["heading"] * (tag_of_block in ("h1", "h2", "h3", "h4", "h5", "h6")) + w["paragraph"] * (tag_of_block in ("p", "blockquote", "pre")) + w["list_item"] * (tag_of_block == "li")
                s += w["links"] * min(linked, len(text)) // len(text)
                out.append(Block(text, s, top[1]))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not top[7]:
            parts.append(raw)
            if links:
                linked += len(raw.strip())

    n, last, quotes = len(page), page.rfind(">"), True
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            at = page.find("-->", at) + 3
            if at == 2:
                break
            continue
        if at > last:
            add(m[0])
            continue
        if m[2] is None:
            at = page.find(">", at) + 1
            continue
        tag = m[2].lower()
        # the one scan that finds no end ends the regard for quotes, so that every page is read in linear time
        rest = _REST.match(page, at) if quotes else None
        quotes = rest is not None
        end = rest.end() if quotes else page.find(">", at) + 1
        given, at = page[at : end - 1], end
        if not m[1]:
            if tag == "br":
                add(" ")
                continue
            if tag in BLOCK_TAGS:
                flush()
                if stack:
                    close = _CLOSES.get(tag, ())
                    if stack[-1][0] == "p" or stack[-1][0] in close:
                        stack.pop()
                        top = stack[-1] if stack else ("", 0, False, False, False, False, False, False)
                tag_of_block = tag
            if tag in VOID_TAGS:
                continue
            if tag == "a":
                links += 1
            if tag in RAW_TAGS:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at, last + 1)
                at = end.end() if end else n
                continue
            if tag in BLOCK_TAGS or tag in SILENT_TAGS:
                named = _CAMEL.sub("-", " ".join(filter(None, (x for g in _NAMES.findall(given) for x in g)))) if given else ""
                if tag in SECTIONS:
                    sections += 1
                root = tag in ("body", "html")
                top = (
                    tag,
                    sections if tag in SECTIONS else top[1],
                    top[2] or tag in ("article", "main"),
                    top[3] or bool(named and not root and WANTED.search(named)),
                    top[4] or tag in UNWANTED_TAGS,
                    top[5] or bool(named and not root and UNWANTED.search(named)),
                    top[6] or tag == "header",
                    top[7] or tag in SILENT_TAGS or bool(given and (_HIDDEN.search(given) or " hidden " in f" {named} ")),
                )
                stack.append(top)
        else:
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCK_TAGS or tag in SILENT_TAGS:
                if tag in BLOCK_TAGS:
                    flush()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                top = stack[-1] if stack else ("", 0, False, False, False, False, False, False)
                tag_of_block = top[0]
    flush()
    return out


def min_cut(scores: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes lie on the source's side of a least cut.

    A node's score is its capacity from the source if positive, to the sink if negative; edges (a, b, capacity) go
    both ways. Dinic's algorithm: level by level, with blocking flows found without recursion.
    """
    n = len(scores)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[int] = []

    def link(a: int, b: int, there: int, back: int) -> None:
        head[a].append(len(to))
        to.append(b)
        cap.append(there)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, s in enumerate(scores):
        if s > 0:
            link(source, i, s, 0)
        elif s < 0:
            link(i, sink, -s, 0)
    for a, b, c in edges:
        link(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if not cap[e])
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while nxt[u] < len(head[u]):
                e = head[u][nxt[u]]
                if cap[e] and level[to[e]] == level[u] + 1:
                    break
                nxt[u] += 1
            else:
                if u == source:
                    break
                level[u] = -1
                u = to[path.pop() ^ 1]
                continue
            path.append(e)
            u = to[e]


def smoothness(blocks: list[Block]) -> list[tuple[int, int, int]]:
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEXT_SAME if blocks[i - 1].section == b.section else NEXT_OTHER))
        before = last.get(b.section)
        if before is not None and before != i - 1:
            edges.append((before, i, SAME_SECTION))
        last[b.section] = i
    return edges


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by newlines."""
    blocks = blocks_of(page or "")
    keep = min_cut([b.score for b in blocks], smoothness(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield batch(_OUT, page_id=b.column(0), url=b.column(1), text=texts, n_chars=[len(t) for t in texts])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
