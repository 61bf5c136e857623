"""Main-text extraction by minimum-cut labelling.

A page is cut into text blocks in one pass over its tags. Each block has a cost,
the logit of a classifier of its text, its neighbours' links and the marks of the
elements it stands in: where positive it is the capacity of the block's edge to
the content terminal, where negative of that to the boilerplate terminal.
Neighbouring blocks, and blocks that follow each other under one parent element,
are joined by edges whose capacity is the log-odds that blocks so close in the
document tree have one label. The minimum cut of this graph, by maximum flow, is
the labelling of least total cost.

Weights and capacities are learned, on a bounded sample of the pages themselves.
Blocks that stand in marked elements (article, nav, class="ad" and the like) are
the examples; each is shown with and without its marks, so what it looks like has
to tell, too. A Gaussian prior around the fixed weights below holds them where
pages say little, and is all there is for an empty table.

Some parts are never text (scripts, styles, controls, hidden parts): they make no
blocks. Malformed markup is read leniently; nothing raises.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import deque
from dataclasses import dataclass
from html import unescape

import numpy as np

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)  # the last form: a quote is never closed
SPACE = re.compile(r"\s+")
HINT = re.compile(r"(?:class|id|role|aria-label|itemprop|hidden|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
MAY_HIDE = re.compile(r"hidden|display", re.I)
NOT_SHOWN = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.I)

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style head title template noscript iframe object svg math canvas audio video select option textarea button datalist map".split())
RAW = frozenset("script style textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"html", "body"}
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_TAG = frozenset("nav footer aside menu form header dialog address fieldset".split())
CONTENT_TAG = frozenset("article main".split())
BOILER_WORD = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments disqus cookie cookies consent copyright footer foot gdpr header masthead menu menubar nav navbar navigation newsletter notice notices notification outbrain pagination pager popup promo promotion recommended related reply replies respond respondents search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola tags toolbar topbar widget widgets login alert modal contentinfo complementary discussion reactions".split()
)
#: Elements that some pages wrap around everything.
WRAPPER_TAG = frozenset("form header fieldset".split())
#: Words that make a class name speak of a state (no-ads, comments-open) and not of what the element is.
STATE_WORD = frozenset("with without no not has have is are enabled disabled enable disable open opened closed on off show shown hide supports support".split())
CONTENT_WORD = frozenset("article articlebody body content entry main maincontent post postbody story text".split())
WORD_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
SENTENCE = re.compile(r"[.!?。]")


#: What an element is by itself: content; neither; boilerplate; the same, but void around the page's content; the same, and void within content.
CONTENT, NEITHER, BOILER, WRAPPER, HEADER = 1, 0, -1, -2, -3


class _Element:
    """An open element: what its blocks inherit. `up` is the element around it, own what it is by itself, mark 1 for content, -1 for
    boilerplate, 0 for neither. prose and articles: characters of sentences inside, and article or main elements that are content."""

    __slots__ = ("name", "number", "up", "depth", "own", "mark", "dropped", "link", "heading", "prose", "articles")

    def __init__(self, name: str, number: int, up: _Element | None, own: int = NEITHER, dropped: bool = False):
        self.name, self.number, self.up, self.own, self.mark, self.dropped = name, number, up, own, 0, dropped
        self.depth = up.depth + 1 if up else 0
        self.link = name == "a" or up is not None and up.link
        self.heading = name in HEADING or up is not None and up.heading
        self.prose, self.articles = 0, int(own == CONTENT and name in CONTENT_TAG)


@dataclass(slots=True)
class Block:
    text: str
    element: _Element
    link_chars: int


def _hidden(attributes: str) -> bool:
    """Whether the attribute hidden, aria-hidden="true" or style="display:none" is there; words in other values hide nothing."""
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and NOT_SHOWN.search(value):
            return True
    return False


def _named(attributes: str) -> int:
    """What an element is by the words of its class, id and the like. Names of states say nothing."""
    words: set[str] = set()
    for m in HINT.finditer(attributes):
        for token in " ".join(v for v in m.groups() if v).split():
            own = {w.lower() for w in WORD_SPLIT.split(token)}
            if not own & STATE_WORD:
                words |= own
    return WRAPPER if words & BOILER_WORD else CONTENT if words & CONTENT_WORD else NEITHER


def _own(name: str, attributes: str, up: _Element) -> tuple[int, bool]:
    """(what an element is by itself, whether it is never text)."""
    own, dropped = NEITHER, up.dropped or name in DROPPED
    if name in CONTENT_TAG:
        own = CONTENT
    elif name in BOILER_TAG:
        own = HEADER if name in ("header", "address") else WRAPPER if name in WRAPPER_TAG else BOILER
    if attributes and "=" in attributes and name not in ("body", "html") and own != BOILER:
        named = _named(attributes)
        own = named if named == WRAPPER or own == NEITHER else own
    if attributes and MAY_HIDE.search(attributes) and _hidden(attributes):
        dropped = True
    return own, dropped


def _mark(elements: list[_Element], blocks: list[Block]) -> None:
    """Set each element's mark, with what it inherits. Boilerplate of the lighter kinds is void around the page's content: where all
    its article and main elements lie inside, or, if there are none, more than half of its prose."""
    for b in blocks:
        if SENTENCE.search(b.text):
            b.element.prose += len(b.text) - b.link_chars
    for e in reversed(elements):  # what lies inside comes later
        if e.up is not None:
            e.up.prose += e.prose
            e.up.articles += e.articles
    root = elements[0]
    for e in elements[1:]:
        own, around = e.own, e.up.mark
        if own <= WRAPPER and (e.articles == root.articles if root.articles else 2 * e.prose > root.prose) or own == HEADER and around == 1:
            own = NEITHER
        e.mark = -1 if own < 0 else around or own


def blocks_of(html: str) -> list[Block]:
    """Text blocks in page order."""
    root = _Element("", 0, None)
    stack, out, parts, link_chars, elements = [root], [], [], 0, [root]
    places: dict[str, list[int]] = {}  # of the open elements of a name
    blocks_open = [0]  # places of the open block elements, after the root's

    def flush() -> None:
        nonlocal parts, link_chars
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = unescape(text)
            text = SPACE.sub(" ", text).strip()
            if text:
                out.append(Block(text, stack[-1], link_chars))
        parts, link_chars = [], 0

    def leave(index: int) -> None:
        for e in stack[index:]:
            places[e.name].pop()
        while blocks_open[-1] >= index:
            blocks_open.pop()
        del stack[index:]

    at, n = 0, len(html)
    while at < n:
        m = TAG.search(html, at)
        if m is None or m.start() > at:
            piece = html[at : m.start() if m else n]
            if not stack[-1].dropped:
                parts.append(piece)
                if stack[-1].link:
                    link_chars += len(piece.strip())
        if m is None:
            break
        at = m.end()
        name = m.group(2) or m.group(5)
        if name is None:
            continue
        name = name.lower()
        if m.group(1) or m.group(4):
            index = places[name][-1] if places.get(name) else 0
            if name in BLOCK:
                flush()
                if index:
                    leave(index)
            elif index > blocks_open[-1]:  # a stray inline end tag does not close blocks
                leave(index)
            continue
        if name in VOID:
            if name in ("br", "wbr", "img"):
                if name == "br" and not stack[-1].dropped:
                    parts.append(" ")
            elif name == "hr":
                flush()
            continue
        if name in BLOCK:
            flush()
            inner = stack[blocks_open[-1]]
            if name in CLOSES_P and inner is not root and (inner.name == "p" or inner.name == name and name in ("li", "dd", "dt", "tr", "td", "th")):
                leave(blocks_open[-1])
        attributes = m.group(3) or m.group(6) or ""
        if attributes.endswith("/") and name not in BLOCK:
            continue
        places.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            blocks_open.append(len(stack))
        stack.append(_Element(name, len(elements), stack[-1], *_own(name, attributes, stack[-1])))
        elements.append(stack[-1])
        if name in RAW:
            end = re.compile(rf"</{name}", re.I).search(html, at)
            at = end.start() if end else n
    flush()
    _mark(elements, out)
    return out


#: A feature of a block and the centre of its weight's prior.
PRIOR = {
    "one": -0.8, "size": 1.0, "links": -5.0, "sentence": 0.5, "heading": 0.8, "copyright": -3.0, "links_before": -0.3, "links_after": -0.3,
    "boilerplate": -8.0, "content": 4.0, "unmarked_on_marked_page": -0.5,
}
MARKS = slice(8, 11)
#: Capacities by closeness (elements apart: at most 2, 3, 5, more) and marks (none, alike, different), as if seen on PRIOR_PAIRS pairs.
CLOSE, FAR = (2, 3, 5), 12
PRIOR_SAME = np.array([[0.9, 0.9, 0.5], [0.8, 0.8, 0.5], [0.7, 0.7, 0.5], [0.6, 0.6, 0.5]])
PRIOR_PAIRS, PRIOR_PRECISION = 20.0, 2.0
SAMPLE_PAGES, SAMPLE_CHARS = 300, 100_000


@dataclass
class Model:
    weights: np.ndarray
    capacity: np.ndarray


def features(blocks: list[Block]) -> np.ndarray:
    links = [min(1.0, b.link_chars / max(len(b.text), 1)) for b in blocks]
    marked = any(b.element.mark == 1 for b in blocks)
    rows = []
    for i, b in enumerate(blocks):
        mark, size = b.element.mark, min(len(b.text), 600) / 150
        copyright_ = b.text[:1] == "©" or b.text[:9].lower() == "copyright"
        rows.append((1.0, size, links[i], SENTENCE.search(b.text) is not None, b.element.heading, copyright_, links[i - 1] if i else 0.0, links[i + 1] if i + 1 < len(blocks) else 0.0, mark == -1, mark == 1, marked and mark == 0))
    return np.array(rows, np.float64).reshape(len(rows), len(PRIOR))


def apart(a: _Element, b: _Element) -> int:
    """Elements to leave and enter from one to the other, FAR at most."""
    steps = 0
    while a is not b and steps < FAR:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        steps += 1
    return steps


def pairs(blocks: list[Block]) -> list[tuple[int, int, int, int]]:
    """(block, later block, closeness, marks) of neighbours and of blocks that follow each other under one element."""
    out, last_of = [], {}
    for i, b in enumerate(blocks):
        before = {i - 1} if i else set()
        for e in (b.element, b.element.up):
            if e is not None:
                before.add(last_of.get(e.number, i))
                last_of[e.number] = i
        for j in before - {i}:
            one, two = blocks[j].element, b.element
            out.append((j, i, bisect_left(CLOSE, apart(one, two)), 2 if one.mark != two.mark else 1 if one.mark else 0))
    return out


def _capacity(same: np.ndarray, seen: np.ndarray) -> np.ndarray:
    share = (same + PRIOR_PAIRS * PRIOR_SAME) / (seen + PRIOR_PAIRS)
    return np.clip(np.log(share / (1 - share + 1e-9)), 0.05, 3.0)


def fit(pages: list[str]) -> Model:
    """Weights and capacities from the marked blocks of pages; the prior's where there are none."""
    centre, same, seen, xs, ys = np.array(list(PRIOR.values())), np.zeros((4, 3)), np.zeros((4, 3)), [], []
    for html in pages:
        blocks = blocks_of(html)
        marks = np.array([b.element.mark for b in blocks], np.int64)
        x = features(blocks)[marks != 0]
        bare = x.copy()
        bare[:, MARKS] = 0
        xs += [x, bare]
        ys += [marks[marks != 0] > 0] * 2
        for i, j, close, kind in pairs(blocks):
            if marks[i] and marks[j]:  # each stands for a pair whose marks are not known, too
                for k in (0, kind):
                    seen[close, k] += 1
                    same[close, k] += marks[i] == marks[j]
    if not xs or not sum(map(len, ys)):
        return Model(centre, _capacity(same, seen))
    x, y, w = np.concatenate(xs), np.concatenate(ys).astype(float), centre.copy()
    precision = PRIOR_PRECISION * max(1.0, len(x) / 400)  # the prior keeps its say when examples are many: marks are examples, not truth
    for _ in range(25):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + precision * (w - centre)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + precision * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
    return Model(w, _capacity(same, seen))


DEFAULT = fit([])


def block_costs(blocks: list[Block], model: Model = DEFAULT) -> list[float]:
    return (features(blocks) @ model.weights).tolist() if blocks else []


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node lies on the source (content) side of a minimum cut.

    Terminal capacities are the costs: of the source edge where positive, of the
    sink edge where negative. Shortest augmenting paths; each saturates an edge.
    """
    n = len(costs)
    source, sink = n, n + 1
    residual: list[dict[int, float]] = [{} for _ in range(n + 2)]
    for i, c in enumerate(costs):
        if c > 0:
            residual[source][i], residual[i][source] = c, 0.0
        elif c < 0:
            residual[i][sink], residual[sink][i] = -c, 0.0
    for i, j, c in edges:
        residual[i][j] = residual[i].get(j, 0.0) + c
        residual[j][i] = residual[j].get(i, 0.0) + c
    while True:
        before = {source: source}
        queue = deque((source,))
        while queue and sink not in before:
            node = queue.popleft()
            for other, left in residual[node].items():
                if left > 1e-9 and other not in before:
                    before[other] = node
                    queue.append(other)
        if sink not in before:
            return [i in before for i in range(n)]
        path, node = [], sink
        while node != source:
            path.append((before[node], node))
            node = before[node]
        flow = min(residual[i][j] for i, j in path)
        for i, j in path:
            residual[i][j] -= flow
            residual[j][i] = residual[j].get(i, 0.0) + flow


def whole_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """`minimum_cut` of the whole graph, part by part.

    A node whose cost exceeds all its edges together lies on its own side in every
    minimum cut. It is taken out, its edges added to its neighbours' costs, which may
    settle them too. The parts that remain have no edge between them.
    """
    costs, side = list(costs), [None] * len(costs)
    near: list[dict[int, float]] = [{} for _ in costs]
    for i, j, c in edges:
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    queue = deque(range(len(costs)))
    while queue:
        i = queue.popleft()
        if side[i] is None and abs(costs[i]) > sum(near[i].values()) + 1e-6:
            side[i] = costs[i] > 0
            for j, c in near[i].items():
                costs[j] += c if side[i] else -c
                del near[j][i]
                queue.append(j)
    for start in range(len(costs)):
        if side[start] is not None:
            continue
        part, number = [start], {start: 0}
        for i in part:
            for j in near[i]:
                if j not in number:
                    number[j] = len(part)
                    part.append(j)
        inner = [(number[i], number[j], c) for i in part for j, c in near[i].items() if i < j]
        for i, content in zip(part, minimum_cut([costs[i] for i in part], inner), strict=True):
            side[i] = content
    return side


def label(blocks: list[Block], model: Model = DEFAULT) -> list[bool]:
    return whole_cut(block_costs(blocks, model), [(i, j, float(model.capacity[close, kind])) for i, j, close, kind in pairs(blocks)])


def main_text(html: str | None, model: Model = DEFAULT) -> str:
    """The blocks labelled content, in page order, two newlines between them; empty for null, empty and textless pages."""
    if not html:
        return ""
    blocks = blocks_of(html)
    return "\n\n".join(b.text for b, content in zip(blocks, label(blocks, model), strict=True) if content)
