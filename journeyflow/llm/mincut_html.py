"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text. A linear classifier gives each block a cost for being called
content or boilerplate: evidence from its containers (semantic elements, class, id and role words)
with fixed weights, and a text part (length, links, sentence ends, capitals) that is trained here
on a bounded sample of pages whose own article and navigation elements mark their blocks. Costs
are the terminal capacities of a graph; edges between neighbours in page order and between blocks
that share a container make them smooth. The minimum cut, found by maximum flow, parts content
from boilerplate.

A null or empty page has an empty text. Broken markup is read as it comes: unclosed elements,
also those that are left out (buttons, drawings, choices), end with their container or where an
article, main part or navigation begins; a stray quote ends nothing. Formulas are text, buttons
are not. Names judge the wrapper they stand on; one that only says what a page has or has not
(`has-sidebar`, `no-comments`) judges nothing, and a page's main part, or an article in a wrapper
named for furniture, counts for itself. Blocks keep page order, repeated blocks and rows stay,
nothing is cut short. Null ids pass through; columns but page_id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 1000  # pages that the text part of the classifier is trained on, at most

#: Elements by what they mean for the text.
SKIPPED = set("script style noscript template iframe svg canvas object select textarea button head title video audio map".split())
RAW = set("script style noscript template iframe textarea title".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("ul ol dl table div article section main aside nav header footer body td th form blockquote".split())
BAD = set("nav footer aside form menu dialog search".split())
BAD_WORDS = set("ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright dialog disclaimer disqus footer gdpr header legal links login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promoted promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toc toolbar topbar tracking widget alert banner contentinfo complementary".split())
GOOD_WORDS = set("article articlebody body content entry main post story text".split())

ENDS_SKIP = set("article main nav section footer".split())
#: Names of wrappers that may stand around a whole page, and class words that make a name say nothing.
AROUND = set("banner breadcrumb breadcrumbs footer header legal login masthead menu nav navbar navigation search sidebar skip social toc toolbar topbar widget".split())
SAYS_NOTHING = set("has no with without not is off on".split())

# a quote counts where a value begins, and nothing is tried twice
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Log-odds for content by container evidence.
IN_ARTICLE, IN_BAD, BAD_NAME, GOOD_NAME = 5.0, -8.0, -9.0, 1.5
#: Log-odds of the text part before training: bias, length, link share, sentence ends, capitals, short.
PRIOR = np.array([-0.3, 1.2, -4.0, 0.6, -0.5, -0.6])
SMOOTH_NEXT, SMOOTH_SHARED = 0.6, 0.5
SPACES = re.compile(r"\s+")


class Block:
    """Text of a block with its container evidence."""

    __slots__ = ("text", "links", "parent", "evidence", "marked")

    def __init__(self, text: str, links: int, parent: int, evidence: float, marked: int):
        self.text, self.links, self.parent, self.evidence, self.marked = text, links, parent, evidence, marked


def _element(name: str, attributes: str, above: tuple) -> tuple:
    """Evidence of an element from its parent's: log-odds so far, in an article, in boilerplate (2: only by a
    name that may stand around a page)."""
    evidence, article, bad = above
    words: set[str] = set()
    hidden = False
    if attributes and ("=" in attributes or "hidden" in attributes):
        for key, *values in ATTRIBUTE.findall(attributes):
            value = "".join(values)
            key = key.lower()
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                hidden = True
            elif key in ("class", "id", "role"):
                for one in CAMEL.sub("-", value).lower().split():
                    own = WORD.findall(one)
                    if not SAYS_NOTHING.intersection(own[:1] + own[-1:]):
                        words.update(own)
    if name in ("article", "main"):
        if bad and (name == "main" or bad == 2):
            evidence, bad = 0.0, False
        article = True
        evidence = max(evidence, 0.0) + IN_ARTICLE if not bad else evidence
    elif name in BAD or (name in ("header",) and not article):
        evidence, bad = evidence + IN_BAD, True
    named = words & BAD_WORDS
    if words & GOOD_WORDS:  # a part of the text, whatever it has besides
        named = set()
    elif article:
        named -= {"header"}  # an article's own heading
    if hidden or (named and name not in ("html", "body", "main")):
        evidence, bad = evidence + BAD_NAME, bad if bad is True else True if hidden or named - AROUND else 2
    elif words & GOOD_WORDS and not bad:
        evidence += GOOD_NAME
    return evidence, article, bad


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text in order."""
    out: list[Block] = []
    stack: list[tuple] = [("", (0.0, False, False), 0)]
    parts: list[str] = []
    links = in_link = number = 0
    skip = ""  # the skipped element that is open
    depth = 0

    def close() -> None:
        nonlocal parts, links
        if parts:
            text = SPACES.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                evidence, article, bad = stack[-1][1]
                parent = stack[-2][2] if len(stack) > 1 else 0
                out.append(Block(text, links, parent, evidence, -1 if bad else 1 if article else 0))
            parts, links = [], 0

    at, end = 0, len(page)
    last = page.rfind(">") + 1  # no tag ends behind it
    while at < end:
        m = TOKEN.search(page, at, last)
        if not skip:
            piece = page[at:m.start()] if m else page[at:].partition("<!--")[0]
            if piece:
                parts.append(piece)
                if in_link:
                    links += len(piece)
        if not m:
            break
        at = end if m[0].startswith("<!--") and not m[0].endswith("-->") else m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if skip:
            if name == skip:
                depth += -1 if m[1] else 0 if name in RAW else 1
                if depth <= 0:
                    skip = ""
                continue
            container = m[1] and (any(s[0] == name for s in stack) if name in BLOCK else name == "a" and in_link)
            if not container and (m[1] or name not in ENDS_SKIP):
                continue
            skip = ""  # it was never closed: what stands around it ends, or something larger begins
        if m[1]:
            if name == "a":
                in_link = 0
            elif name in BLOCK:
                close()
                in_link = 0
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            continue
        attributes = m[3] or ""
        if name in SKIPPED:
            if attributes.endswith("/") and name not in RAW:
                continue
            if name == "head":
                continue
            if name in RAW:
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                at = end if stop is None else (page.find(">", stop.end()) + 1 or end)
                continue
            skip, depth = name, 1
        elif name == "br":
            parts.append(" ")
        elif name == "a":
            in_link = 1
        elif name in BLOCK:
            close()
            in_link = 0
            if name not in VOID:
                drop = CLOSES.get(name, ())
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p" or stack[k][0] in drop:
                        del stack[k:]
                        break
                    if stack[k][0] in SCOPE:
                        break
                number += 1
                stack.append((name, _element(name, attributes, stack[-1][1]), number))
    close()
    return out


def text_features(block: Block) -> tuple[float, ...]:
    """Bias, length, link share, sentence ends, share of capitals, short."""
    n = len(block.text)
    return (1.0, min(n, 400) / 200, min(1.0, block.links / n), float(block.text[-1] in ".!?:;\"'"),
            sum(map(str.isupper, block.text[:200])) / min(n, 200), float(n < 25))


def train_text_part(rows: list[tuple[list[float], int]], rounds: int = 60, pull: float = 20.0) -> np.ndarray:
    """Logistic regression (Newton steps) on the marked blocks' text features, pulled to PRIOR."""
    w = PRIOR.copy()
    if not rows:
        return w
    x = np.array([r[0] for r in rows])
    y = np.array([r[1] for r in rows]) > 0
    weight = np.where(y, 0.5 / max(y.sum(), 1), 0.5 / max((~y).sum(), 1)) * min(len(y), 400)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        gradient = x.T @ (weight * (p - y)) + pull * (w - PRIOR)
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def minimum_cut(cost: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source side of a minimum cut.

    A positive cost is the capacity from the source, a negative one that to the sink; edges hold
    both ways. A node whose cost is at least all its edges together is on its own side in some
    minimum cut: it is settled, its edges move its neighbours' costs, and so on. What is left is
    solved by blocking flows over levels.
    """
    n = len(cost)
    spare = [round(c * 1000) for c in cost]
    head: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    around = [0] * n
    for i, j, w in edges:
        c = round(w * 1000)
        head[i].append(len(to))
        head[j].append(len(to) + 1)
        to += [j, i]
        room += [c, c]
        around[i] += c
        around[j] += c
    side: list[bool | None] = [None] * n
    ready = list(range(n))
    while ready:
        i = ready.pop()
        if side[i] is not None or abs(spare[i]) < around[i]:
            continue
        side[i] = spare[i] > 0
        for e in head[i]:
            j = to[e]
            if side[j] is None:
                around[j] -= room[e]
                spare[j] += room[e] if side[i] else -room[e]
                ready.append(j)
    left = [i for i in range(n) if side[i] is None]
    head = [[e for e in head[i] if side[to[e]] is None] if side[i] is None else [] for i in range(n)]
    while left:
        sources = [i for i in left if spare[i] > 0]
        level, frontier, found = dict.fromkeys(sources, 0), sources, False
        while frontier and not found:
            further = []
            for i in frontier:
                for e in head[i]:
                    j = to[e]
                    if room[e] > 0 and j not in level:
                        level[j] = level[i] + 1
                        further.append(j)
                        found = found or spare[j] < 0
            frontier = further
        if not found:
            for i in left:
                side[i] = i in level
            break
        tried = dict.fromkeys(level, 0)
        for source in sources:
            path, i = [], source
            while spare[source] > 0:
                if spare[i] < 0:
                    flow = min(spare[source], -spare[i], *(room[e] for e in path))
                    spare[source] -= flow
                    spare[i] += flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    path, i = [], source
                    continue
                while tried[i] < len(head[i]):
                    e = head[i][tried[i]]
                    if room[e] > 0 and level.get(to[e]) == level[i] + 1:
                        break
                    tried[i] += 1
                if tried[i] < len(head[i]):
                    path.append(head[i][tried[i]])
                    i = to[path[-1]]
                elif path:
                    i = to[path.pop() ^ 1]
                    tried[i] += 1
                else:
                    break
    return [bool(x) for x in side]


def main_text(page: str, weights: np.ndarray) -> str:
    """The blocks on the content side, one a line."""
    blocks = blocks_of(page)
    w = weights.tolist()
    cost = [b.evidence + sum(x * y for x, y in zip(w, text_features(b), strict=True)) for b in blocks]
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, SMOOTH_NEXT))
        if b.parent in last:
            edges.append((last[b.parent], i, SMOOTH_SHARED))
        last[b.parent] = i
    side = minimum_cut(cost, edges)
    return "\n".join(b.text for b, s in zip(blocks, side, strict=True) if s)


def learn_weights(pages: DataFrame, sample: int = SAMPLE_PAGES) -> np.ndarray:
    """Train the text part on the marked blocks of at most ``sample`` pages (least hashes of page_id and url).

    Only hashes are sorted; the pages of the chosen ones are then read where they lie. Of several
    pages with one hash the least html counts.
    """

    def run(batches):
        for batch in batches:
            rows = [(list(text_features(b)), b.marked) for p in batch.column(0).to_pylist() for b in blocks_of(p or "") if b.marked]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.float64())), pa.array([r[1] for r in rows], pa.int32())],
                                             names=["x", "marked"])

    hashed = pages.select(F.xxhash64("page_id", "url").alias("h"), "html")
    chosen = hashed.select("h").distinct().orderBy("h").limit(sample)
    taken = hashed.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("html").alias("html"))  # `sample` hashes at most
    return train_text_part([(r["x"], r["marked"]) for r in taken.select("html").mapInArrow(run, "x array<double>, marked int").collect()])


def extract_text(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """Per page page_id, url, text, n_chars (code points)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(p or "", weights) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def extraction_digest(pages: DataFrame) -> DataFrame:
    """Weights from the sample, then the main text of every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return extract_text(pages, learn_weights(pages))
