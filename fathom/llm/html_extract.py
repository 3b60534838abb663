"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text at block-level tags. A classifier gives each block a cost for either
label, content or boilerplate; the costs are capacities to the two terminals. Smoothness edges join
neighbouring blocks and, through the containers of the page, blocks that are near in the document's tree.
The maximum flow between the terminals gives the labelling of least cost.

The classifier sums two kinds of evidence: what the elements around a block say by their tags, classes and
ids, which is fixed below, and a logistic model of the block's own text. That model is trained on blocks
which stand in elements that say what they are, of a bounded sample of pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements that break a line of text, whose content is no text, that never have content, whose end may be left out.
BLOCKS = frozenset(
    "address article aside blockquote body center caption col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
HIDDEN = RAW - {"xmp"} | frozenset("head template noscript object svg math canvas audio video select datalist button map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = frozenset("ul ol menu dl table select html body".split())
_BUT_P = BLOCKS - {"p"}

#: Elements and words of classes, ids and roles that name content or boilerplate.
CONTENT_TAGS = frozenset({"article", "main"})
BOILERPLATE_TAGS = frozenset("nav footer aside form fieldset menu dialog".split())
CONTENT_WORDS = frozenset("article articlebody post entry story content maincontent main body text".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored sponsors promo promoted promotion banner banners nav navbar navigation menu menubar submenu topbar toolbar sidebar side rail footer foot "
    "bottombar masthead breadcrumb breadcrumbs crumbs pagination pager cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall comment comments commentlist reply replies respond disqus discussion "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login signin search searchbox form widget widgets tags taglist copyright legal disclaimer skip trending popular teaser contentinfo complementary".split()
)
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_NAMED = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?=[\s=/]|$)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}

#: Capacities, in whole numbers: a unit of evidence, an edge between neighbours of one container and of different ones, an edge of a block or container to the container around it, the least difference of a block's two costs.
UNIT, NEAR, FAR, INSIDE, LEAST = 100, 120, 30, 40, 10
#: The weight of an element's own word, in units; of the text model a block gets at most TEXT units to either side.
STRONG, MILD, TEXT = 12.0, 2.0, 3.0
#: Pages and blocks that the text model is trained on, at most.
TRAIN_PAGES, TRAIN_BLOCKS = 1_000, 20_000
FEATURES = ("bias", "words", "long", "links", "sentences", "ends", "capital", "heading", "item", "mark")
#: What the model is drawn towards, and what it is where no page says anything of its elements.
PRIOR = np.array([-0.4, 0.8, 0.8, -4.0, 0.6, 0.8, 0.1, 0.5, -0.6, -2.5])
_MARK = re.compile(r"©|\(c\) ?\d{4}|copyright|all rights reserved|cookie|subscribe|newsletter|sign (?:in|up)|log in|advertis|sponsored|read more|privacy policy|terms of (?:use|service)", re.I)
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)]*(?:\s|$)")


class Block:
    __slots__ = ("text", "linked", "tag", "box", "said")

    def __init__(self, text: str, linked: int, tag: str, box: int, said: float):
        self.text, self.linked, self.tag, self.box, self.said = text, linked, tag, box, said


def _said(tag: str, attributes: str, inside_content: bool) -> tuple[float, bool]:
    """(evidence, hidden) of an element: positive for content, negative for boilerplate."""
    evidence = STRONG if tag in CONTENT_TAGS else -STRONG if tag in BOILERPLATE_TAGS or tag == "header" and not inside_content else 0.0
    hidden = tag in HIDDEN
    if not attributes:
        return evidence, hidden
    for m in _NAMED.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _UNSEEN.search(value):
            hidden = True
        elif name in ("class", "id", "role") and tag not in ("html", "body"):
            words = {w.lower() for w in _NAME.findall(value)}
            if words & BOILERPLATE_WORDS:
                evidence = -STRONG
            elif words & CONTENT_WORDS and evidence == 0:
                evidence = MILD
    return evidence, hidden


class Page:
    """The blocks of a page in order, and for each container the one around it; container 0 is the page."""

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.around = [0]
        # of open elements: tag, container, evidence in force, hidden, whether within an article or main element, block element around the text
        self._open: list[tuple[str, int, float, bool, bool, str]] = [("", 0, 0.0, False, False, "")]
        self._count: Counter[str] = Counter()  # of open elements by tag
        self._text: list[str] = []
        self._linked = self._links = 0
        self._parse(source)

    def _parse(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                self._add(source[at:])
                break
            if lt > at:
                self._add(source[at:lt])
            following = source[lt + 1 : lt + 2]
            if following.isascii() and following.isalpha() or following == "/" and source[lt + 2 : lt + 3].isascii() and source[lt + 2 : lt + 3].isalpha():
                m = _TAG.match(source, lt)
                if m:
                    name, attributes, at = m[2].lower(), m[3], m.end()
                else:  # a quote is not closed: the tag ends at the next bracket
                    end = source.find(">", lt)
                    at = end + 1 if end >= 0 else n
                    name, _, attributes = source[lt + 1 : at - 1].lstrip("/").partition(" ")
                    name = name.lower()
                if following == "/":
                    self._end(name)
                else:
                    self._start(name, attributes)
                    if name in RAW:
                        m = _ENDS[name].search(source, at)
                        at = m.start() if m else n
            elif source.startswith("<!--", lt):
                end = source.find("-->", lt + 2 if source.startswith("<!-->", lt) else lt + 4)
                at = end + 3 if end >= 0 else n
            elif following in ("!", "?", "/") and following:
                end = source.find(">", lt)
                at = end + 1 if end >= 0 else n
            else:
                self._add("<")
                at = lt + 1
        self._flush()

    def _add(self, text: str) -> None:
        if not self._open[-1][3]:
            self._text.append(text)
            if self._links:
                self._linked += sum(map(len, text.split()))

    def _flush(self) -> None:
        if self._text:
            text = " ".join(html.unescape("".join(self._text)).split())
            if text:
                self.blocks.append(Block(text, self._linked, self._open[-1][5], self._open[-1][1], self._open[-1][2]))
            self._text = []
        self._linked = 0

    def _start(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag in BLOCKS:
                self._flush()
            elif tag == "br":
                self._add(" ")
            return
        if tag in BLOCKS:
            self._flush()
            if tag in ENDED_BY:
                self._close(ENDED_BY[tag], SCOPES)
            self._close({"p"}, _BUT_P)
        if tag == "body":
            self._close({"head"}, frozenset())
        if tag == "a":
            self._links += 1
        _, box, said, hidden, inside, block = self._open[-1]
        own, unseen = _said(tag, attributes, inside)
        if own <= -STRONG or own > 0 and said == 0 or own >= STRONG and said > -STRONG:
            said = own
        if tag in BLOCKS and tag != "p":
            self.around.append(box)
            box = len(self.around) - 1
        if not attributes.rstrip().endswith("/") or tag in BLOCKS or tag in RAW:
            self._open.append((tag, box, said, hidden or unseen, inside or tag in CONTENT_TAGS, tag if tag in BLOCKS else block))
            self._count[tag] += 1
        elif tag == "a":
            self._links -= 1

    def _pop(self, k: int) -> None:
        for o in self._open[k:]:
            self._links -= o[0] == "a"
            self._count[o[0]] -= 1
        del self._open[k:]

    def _close(self, tags: set[str], stops: frozenset[str]) -> None:
        """Close the innermost open element of tags, unless one of stops is in between."""
        if not any(self._count[t] for t in tags):
            return
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k][0] in tags:
                self._flush()
                return self._pop(k)
            if self._open[k][0] in stops:
                return

    def _end(self, tag: str) -> None:
        if tag in VOID:
            return
        if tag in BLOCKS:
            self._flush()
        if not self._count[tag]:
            return
        for k in range(len(self._open) - 1, 0, -1):
            open_tag = self._open[k][0]
            if open_tag == tag:
                return self._pop(k)
            if tag not in BLOCKS and open_tag in BLOCKS:  # an inline end tag does not close blocks
                return


def features(blocks: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block: what its text alone shows."""
    out = np.zeros((len(blocks), len(FEATURES)))
    for row, b in zip(out, blocks):
        n = b.text.count(" ") + 1
        letters = max(1, len(b.text) - n + 1)
        row[:] = (
            1, min(np.log2(n), 5) / 5, n >= 20, min(1.0, b.linked / letters), min(3, len(_SENTENCE.findall(b.text[:4096]))) / 3, b.text[-1] in ".!?…:;\"”»。", b.text[0].isupper(),
            b.tag in ("h1", "h2", "h3"), b.tag in ("li", "td", "th", "dt", "option"), bool(_MARK.search(b.text[:4096])) and n < 60,
        )
    return out


class Network:
    """Maximum flow by shortest augmenting paths in layers; capacities are whole numbers."""

    def __init__(self, nodes: int):
        self.edges: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def join(self, a: int, b: int, forth: int, back: int) -> None:
        self.edges[a].append(len(self.to))
        self.edges[b].append(len(self.to) + 1)
        self.to += (b, a)
        self.room += (forth, back)

    def _layers(self, source: int) -> list[int]:
        depth = [-1] * len(self.edges)
        depth[source], queue = 0, deque([source])
        while queue:
            a = queue.popleft()
            for e in self.edges[a]:
                if self.room[e] and depth[self.to[e]] < 0:
                    depth[self.to[e]] = depth[a] + 1
                    queue.append(self.to[e])
        return depth

    def flow(self, source: int, sink: int) -> tuple[int, list[bool]]:
        """(value of the maximum flow, whether each node is on the source's side of the minimum cut nearest to the source)."""
        total, to, room, edges = 0, self.to, self.room, self.edges
        while (depth := self._layers(source))[sink] >= 0:
            tried, path, a = [0] * len(edges), [], source
            while True:
                if a == sink:
                    least = min(room[e] for e in path)
                    total += least
                    cut = -1
                    for k, e in enumerate(path):
                        room[e] -= least
                        room[e ^ 1] += least
                        if cut < 0 and not room[e]:
                            cut = k
                    a = to[path[cut] ^ 1]
                    del path[cut:]
                own = edges[a]
                while tried[a] < len(own) and not (room[own[tried[a]]] and depth[to[own[tried[a]]]] == depth[a] + 1):
                    tried[a] += 1
                if tried[a] < len(own):
                    path.append(own[tried[a]])
                    a = to[path[-1]]
                elif path:
                    a = to[path.pop() ^ 1]
                    tried[a] += 1
                else:
                    break
        return total, [d >= 0 for d in depth]


def costs(blocks: list[Block], weights: np.ndarray) -> list[int]:
    """By how much it costs more to call a block boilerplate than content; never near zero, so that flows stay local."""
    text = np.clip(features(blocks) @ weights, -TEXT, TEXT) if blocks else np.zeros(0)
    whole = np.rint(UNIT * (text + [b.said for b in blocks])).astype(int)
    return np.where(np.abs(whole) < LEAST, np.where(whole < 0, -LEAST, LEAST), whole).tolist()


def smoothness(page: Page) -> list[tuple[int, int, int]]:
    """Edges (a, b, capacity): between neighbouring blocks, and of blocks and containers to the container around them. Container k is node len(blocks) + k."""
    n, out = len(page.blocks), []
    for k, (a, b) in enumerate(zip(page.blocks, page.blocks[1:])):
        out.append((k, k + 1, NEAR if a.box == b.box else FAR))
    used = {b.box for b in page.blocks}
    for box in range(len(page.around) - 1, 0, -1):  # those inside have higher numbers
        if box in used:
            used.add(page.around[box])
    out += [(k, n + b.box, INSIDE) for k, b in enumerate(page.blocks)]
    out += [(n + box, n + page.around[box], INSIDE) for box in sorted(used) if box]
    return out


def label(page: Page, weights: np.ndarray) -> tuple[list[bool], int]:
    """(whether each block is content, cost of the labelling)."""
    n = len(page.blocks)
    net = Network(n + len(page.around) + 2)
    source, sink = n + len(page.around), n + len(page.around) + 1
    for k, c in enumerate(costs(page.blocks, weights)):
        if c > 0:
            net.join(source, k, c, 0)
        else:
            net.join(k, sink, -c, 0)
    for a, b, capacity in smoothness(page):
        net.join(a, b, capacity, capacity)
    value, side = net.flow(source, sink)
    return side[:n], value


def main_text(source: str | None, weights: np.ndarray = PRIOR) -> str:
    """The text of the content blocks of a page, joined by an empty line."""
    page = Page(source or "")
    content, _ = label(page, weights)
    return "\n\n".join(b.text for b, c in zip(page.blocks, content) if c)


def _examples(batches):
    for batch in batches:
        x, y = [], []
        for source in batch.column(0).to_pylist():
            blocks = [b for b in Page(source or "").blocks if abs(b.said) >= STRONG]
            x += features(blocks).tolist()
            y += [b.said > 0 for b in blocks]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.bool_())], ["x", "y"])


def train(pages: DataFrame, pages_at_most: int = TRAIN_PAGES, blocks_at_most: int = TRAIN_BLOCKS) -> np.ndarray:
    """Weights of the text model: logistic regression, drawn towards PRIOR, on blocks whose elements say what they are.

    The sample is a page for each of the pages_at_most least hashes, equal pages being one; of their blocks the
    blocks_at_most of the least hashes reach the driver. Hashes alone are sorted, pages move only if they are chosen.
    """
    hashed = pages.select("html").where("html is not null").withColumn("h", F.xxhash64("html"))
    most = hashed.select("h").distinct().orderBy("h").limit(pages_at_most).agg(F.max("h")).first()[0]
    if most is None:
        return np.round(PRIOR, 6)
    sample = hashed.where(F.col("h") <= most).groupBy("h").agg(F.min("html").alias("html")).select("html")
    found = sample.mapInArrow(_examples, "x array<double>, y boolean")
    found = found.orderBy(F.xxhash64("x", "y"), "x", "y").limit(blocks_at_most).collect()
    w = PRIOR.copy()
    if found:
        x, y = np.array([r["x"] for r in found]), np.array([r["y"] for r in found], float)
        share = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * min(len(y), 1000)
        for _ in range(25):  # Newton steps; either label has half of the weight
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (share * (p - y)) + 20 * (w - PRIOR)
            w -= np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + 20 * np.eye(len(w)), gradient)
    return np.round(w, 6)


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """Per page (page_id, url, text, n_chars) of pages (page_id, url, html): the main text and its code points.

    Blocks are in page order, joined by two line feeds; white space within a block, line breaks of <br>
    included, is one blank; character references are decoded. A page without main text, an empty or null
    html gives ''. Broken markup is read as browsers do: what is not closed ends with what is around it.
    Repeated rows each return, null page_id and url stay null, other columns are ignored. Empty table: no
    rows. One pass without a shuffle; the text model is trained on a bounded sample first, see train().
    """
    w = train(pages) if weights is None else weights
    page_id = dict(pages.dtypes)["page_id"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h.as_py(), w) for h in part.column(2)]
                out = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(out, ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", F.col("url").cast("string").alias("url"), "html").mapInArrow(run, f"page_id {page_id}, url string, text string, n_chars long")
