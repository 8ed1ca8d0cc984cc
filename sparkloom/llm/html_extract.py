"""Main-text extraction from HTML by minimum-cut labelling.

A page becomes a sequence of text blocks in a tree of elements. A classifier gives each block a cost for
being called content and one for being called boilerplate; these are the capacities to the two terminals.
It weighs what the elements around a block say of it (tags, class words) and the block's own text (length,
links, punctuation); the weights of the text are fitted on blocks that their tags settle, from a bounded
sample of the pages. Edges of smoothness join neighbouring blocks, the next of one tag under one parent, and
the next under one grandparent, more strongly the nearer they are in the tree. The maximum flow's cut labels all
blocks of the page at once: the source side is content.

Pages are independent, so Spark deals them out by partition; one page is the largest unit. The work on a
page grows with its length and its number of elements, however deep they nest, but for the cut.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Elements whose text never shows.
HIDDEN = frozenset("script style noscript template head title svg iframe select option textarea datalist canvas audio video annotation".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements within a block; every other element starts and ends one.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i img ins kbd label map mark nobr object picture q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input data".split()) | frozenset(
    "math mi mo mn ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mspace mstyle mtable mtr mtd semantics".split())
#: An opening tag of the key ends an open element of the value.
CLOSES = {
    **dict.fromkeys("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split(), {"p"}),
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
FENCES = frozenset("ul ol dl table article section div main body aside nav header footer form blockquote td th".split())
#: What an element says about its text, by tag and by word of its class, id or role.
TAG_COST = {"nav": 6.0, "header": 3.0, "footer": 6.0, "aside": 6.0, "form": 6.0, "button": 6.0, "menu": 5.0, "dialog": 5.0, "article": -3.0, "main": -2.0, "p": -0.6, "h1": -1.0, "h2": -0.6, "h3": -0.5, "blockquote": -0.5, "pre": -0.6, "figcaption": -0.2, "li": 0.3, "address": 1.0}
WIDGET_WORDS = frozenset("nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar widget ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social trending comment comments comentarios kommentare commentaires disqus reply replies respond reactions pagination pager toolbar".split())
BAD_WORDS = WIDGET_WORDS | frozenset("header masthead footer aside related recommended recommendation recommendations popular discussion copyright legal disclaimer search form skip complementary contentinfo".split())
PLAIN_WORDS = frozenset("list box bar button buttons slot container wrapper wrap unit block area section item items top bottom left right inner outer panel link links thread form site page global".split())
#: Words of reader comments and adverts, of lists of other pages, and of an element's state, which say nothing of its text.
TALK_WORDS = frozenset("comment comments comentarios kommentare commentaires disqus reply replies respond ad ads advert adverts advertisement advertising sponsor sponsored promo promotion".split())
OTHER_PAGES = frozenset("related recommended recommendation recommendations popular trending posts stories articles reading news".split())
STATE_WORDS = frozenset("open closed has no with without count enabled disabled off on allow allowed".split())
GOOD_WORDS = frozenset("article content main post entry story body text".split())
WORD_COST, GOOD_GAIN = 6.0, 0.8
SMOOTH = 0.5
#: Pages that the text weights are fitted on, at most about; and the most that they say for or against a block.
MAX_PAGES, TEXT_MOST = 2_000, 1.5
_PARTS = re.compile(r"[^a-z0-9]+")
_NO_DISPLAY = re.compile(r"display\s*:\s*none")


class Node:
    """An element: what it says of its text, and where it stands."""

    __slots__ = ("parent", "depth", "tag", "words", "tokens", "hidden", "holds", "title", "prose", "inside", "cost", "settled")

    def __init__(self, parent: Node | None, tag: str, words: frozenset, tokens: frozenset, hidden: bool):
        self.parent, self.tag, self.words, self.tokens, self.hidden = parent, tag, words, tokens, hidden
        self.depth = parent.depth + 1 if parent else 0
        self.holds, self.title, self.prose, self.inside, self.cost, self.settled = False, tag == "h1", tag == "p", False, 0.0, 0


class Block:
    """A run of text: its pieces, the nearest block element around it, and how much of it is linked."""

    __slots__ = ("text", "node", "linked")

    def __init__(self, node: Node):
        self.text, self.node, self.linked = [], node, 0


class Blocks(HTMLParser):
    """The text blocks of a page in order and its elements. Unclosed and stray tags are borne, and nothing is raised."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node(None, "", frozenset(), frozenset(), False)
        self.stack, self.nodes, self.counts = [self.root], [self.root], Counter()
        self.blocks, self.open, self.outer = [], None, [self.root]

    def parse_html_declaration(self, i):
        """A marked section of any keyword ends at the next '>', as a comment of no form does."""
        if self.rawdata[i:i + 3] == "<![":
            end = self.rawdata.find(">", i)
            return end + 1 if end >= 0 else -1
        return super().parse_html_declaration(i)

    def close(self):
        """What a tag or comment that never ends has left is dropped."""
        if re.match(r"<[a-zA-Z/!?]", self.rawdata):
            self.rawdata = ""
        super().close()

    def handle_starttag(self, tag, attrs):
        for ended in CLOSES.get(tag, ()):
            if self.counts[ended]:
                self._close(ended, FENCES)
        if tag in VOID:
            if tag == "br" and self.open is not None:
                self.open.text.append(" ")
            elif tag not in INLINE:
                self.open = None
            return
        values, above = dict(attrs), self.stack[-1]
        hidden = above.hidden or tag in HIDDEN or "hidden" in values or values.get("aria-hidden") == "true" or bool(_NO_DISPLAY.search(values.get("style") or ""))
        named = " ".join(filter(None, (values.get("class"), values.get("id"), values.get("role")))).lower()
        node = Node(above, tag, frozenset(_PARTS.split(named)), frozenset(named.split()), hidden) if named else Node(above, tag, frozenset(), frozenset(), hidden)
        self.stack.append(node)
        self.nodes.append(node)
        self.counts[tag] += 1
        if tag not in INLINE:
            self.outer.append(node)
            if not hidden:
                self.open = None

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.counts[tag]:
            self._close(tag, frozenset())
        elif tag not in INLINE and not self.stack[-1].hidden:
            self.open = None

    def _close(self, tag: str, fences: frozenset[str]):
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.stack[k].tag
            if name == tag:
                for node in self.stack[k:]:
                    self.counts[node.tag] -= 1
                    if node.tag not in INLINE:
                        self.outer.pop()
                        if not node.hidden:
                            self.open = None
                del self.stack[k:]
                return
            if name in fences:
                return

    def handle_data(self, data):
        top = self.stack[-1]
        if top.hidden:
            return
        size = len(data.strip())
        if self.open is None:
            if not size:
                return
            self.open = Block(self.outer[-1])
            self.blocks.append(self.open)
        self.open.text.append(data)
        if self.counts["a"]:
            self.open.linked += size


def weighed(nodes: list[Node]) -> None:
    """Sets each element's cost, from the tree as a whole; nodes stand before what is in them.

    A listed word costs, but not on an element that holds an article. Words that may as well name a page's layout
    don't cost either on an element that holds both the title and paragraphs; words of comments and adverts do,
    however much of the page they are. Within an article a name counts if it is made of widgets' words alone, of
    words for lists of other pages, or if one of its words is of comments or adverts and none tells a state, unless
    the element holds the title and paragraphs. What marks boilerplate isn't made good by what stands around it or
    within it. settled: 1 where tags alone say content, -1 where they say boilerplate.
    """
    for n in reversed(nodes):
        if n.parent:
            n.parent.holds |= n.holds or n.tag in ("article", "main")
            n.parent.title |= n.title
            n.parent.prose |= n.prose
    for n in nodes[1:]:
        up = n.parent
        n.inside = up.inside or up.tag in ("article", "main") or bool(up.words & GOOD_WORDS)
        change = TAG_COST.get(n.tag, 0.0)
        if n.tag == "header" and up.inside | (up.tag in ("article", "main")):
            change = 0.0
        if n.words and n.tag not in ("body", "html"):
            good = n.words & GOOD_WORDS
            leads = n.title and n.prose
            names = [parts for parts in (set(_PARTS.split(t)) for t in n.tokens) if not parts & STATE_WORDS]
            if n.holds:
                bad = False
            elif n.inside:
                bad = any(parts & WIDGET_WORDS and parts <= WIDGET_WORDS | PLAIN_WORDS for parts in names)
                bad = bad or not leads and any(parts & TALK_WORDS or parts & OTHER_PAGES and parts <= OTHER_PAGES | WIDGET_WORDS | PLAIN_WORDS and len(parts) > 1 for parts in names)
            else:
                told = set().union(*names) & BAD_WORDS
                bad = bool(told & TALK_WORDS) or bool(told) and not leads and not (good and told == {"header"})
            change += WORD_COST if bad else -GOOD_GAIN if good else 0.0
        above = up.cost
        if change >= 3:
            n.cost = max(above, 0.0) + change
        elif change < 0:
            n.cost = above + change if above < 3 else above
        else:
            n.cost = above + max(change, 0.0)
        n.settled = -1 if n.cost >= 3 else 1 if n.tag == "article" or up.settled == 1 else 0


def blocks_of(page: str | None) -> list[tuple[str, Block]]:
    parser = Blocks()
    if page:
        parser.feed(re.sub(r"<!--(-?)>", "<!---->", page))
        parser.close()
    out = [(" ".join("".join(b.text).split()), b) for b in parser.blocks]
    weighed(parser.nodes)
    return [(t, b) for t, b in out if t]


def text_features(text: str, linked: int) -> list[float]:
    """Length in words, part linked, whether a sentence ends it, commas and digits and capitals a word."""
    words = text.count(" ") + 1
    return [math.log1p(words), min(1.0, linked / len(text)), float(text[-1] in ".!?。！？…:\"”»"), text.count(",") / words, min(1.0, sum(c.isdigit() for c in text) / words), min(2.0, sum(c.isupper() for c in text) / words)]


def costs(text: str, block: Block, weights: list[float] | None = None) -> tuple[float, float]:
    """(cost of calling the block content, cost of calling it boilerplate). weights: of text_features() and a constant."""
    own = 0.25 * min(4.0, math.log1p(text.count(" ") + 1))
    if weights:
        said = weights[-1] + sum(w * x for w, x in zip(weights, text_features(text, block.linked)))
        own = max(-TEXT_MOST, min(TEXT_MOST, said))
    score = 1.0 - block.node.cost - 4.0 * min(1.0, block.linked / len(text)) + own
    if not block.node.inside and block.node.tag not in ("article", "main") and ("©" in text or "all rights reserved" in text.lower()):
        score -= 3.0
    return max(0.0, -score), max(0.0, score)


def apart(a: Node, b: Node, most: int = 16) -> int:
    """Steps in the tree from one element to the other, up to most."""
    steps = 0
    while a is not b and steps < most:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def smooth_edges(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours, between the next of one tag under one parent, and the next under one grandparent."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[tuple, int] = {}
    for k, b in enumerate(blocks):
        if k:
            edges[k - 1, k] = SMOOTH * 0.5 ** max(0, apart(blocks[k - 1].node, b.node) - 2)
        parent = b.node.parent
        above = parent.parent if parent else None
        for key, weight in (((id(parent), b.node.tag), SMOOTH / 2), ((id(above),), SMOOTH / 4)):
            if above or (parent and len(key) > 1):
                if key in last:
                    pair = last[key], k
                    edges[pair] = edges.get(pair, 0.0) + weight
                last[key] = k
    return [(a, b, w) for (a, b), w in edges.items() if w > 1e-3]


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source side of a minimum cut; by shortest augmenting paths in phases."""
    n = len(source)
    s, t = n, n + 1
    to, cap, of = [], [], [[] for _ in range(n + 2)]

    def add(u, v, there, back):
        of[u].append(len(to)); to.append(v); cap.append(there)  # noqa: E702
        of[v].append(len(to)); to.append(u); cap.append(back)  # noqa: E702

    for k in range(n):
        both = min(source[k], sink[k])
        add(s, k, source[k] - both, 0.0)
        add(k, t, sink[k] - both, 0.0)
    for u, v, w in edges:
        add(u, v, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in of[u]:
                if cap[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(n)]
        at, path, u = [0] * (n + 2), [], s
        while True:
            if u == t:
                pushed = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= pushed
                    cap[e ^ 1] += pushed
                path, u = [], s
                continue
            while at[u] < len(of[u]) and not (cap[of[u][at[u]]] > 1e-12 and level[to[of[u][at[u]]]] == level[u] + 1):
                at[u] += 1
            if at[u] < len(of[u]):
                path.append(of[u][at[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                at[u] += 1
            else:
                break


def main_text(page: str | None, weights: list[float] | None = None) -> str:
    """The content blocks of a page, joined by two newlines; empty if there are none."""
    found = blocks_of(page)
    if not found:
        return ""
    cost = [costs(t, b, weights) for t, b in found]
    kept = min_cut([c[1] for c in cost], [c[0] for c in cost], smooth_edges([b for _, b in found]))
    return "\n\n".join(t for (t, _), k in zip(found, kept) if k)


def fit_text_weights(pages: DataFrame, max_pages: int = MAX_PAGES) -> list[float] | None:
    """Weights of text_features() and a constant, by logistic regression on blocks that their tags settle.

    pages: (html). About max_pages of them, chosen by a hash of the page, are read; both kinds of blocks
    weigh alike. None where the sample has one kind alone.
    """
    every = max(1, pages.count() // max_pages)

    def settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(text_features(t, b.linked), float(b.node.settled > 0)) for page in batch["html"] for t, b in blocks_of(page) if b.node.settled]
            yield pd.DataFrame(rows, columns=["x", "label"])

    sample = pages.select("html").where(F.col("html").isNotNull() & (F.pmod(F.xxhash64("html"), F.lit(every)) == 0))
    rows = cut(sample.mapInPandas(settled, "x array<double>, label double"))
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return None
    weight = F.when(F.col("label") == 1, 0.5 / n[1.0]).otherwise(0.5 / n[0.0]) * (n[0.0] + n[1.0])
    model = LogisticRegression(featuresCol="v", labelCol="label", weightCol="weight", regParam=0.05, maxIter=30).fit(rows.select(array_to_vector("x").alias("v"), "label", weight.alias("weight")))
    return [float(w) for w in model.coefficients.toArray()] + [float(model.intercept)]


def extract(pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """pages with ``text`` and ``n_chars`` (code points) added, replacing such columns.

    A null or empty page has empty text. Any text parses: bad markup never fails, tags and comments that
    never end are left out. Deep nesting and long pages are read whole. Repeated rows are extracted alike;
    other columns come through; an empty table gives an empty result.
    """
    weights = fit_text_weights(pages, max_pages)

    @F.pandas_udf("string")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p, weights) for p in batch], dtype=object)

    pages = pages.select(*[c for c in pages.columns if c not in ("text", "n_chars")])
    return pages.withColumn("text", compute(F.col("html"))).withColumn("n_chars", F.length("text").cast("long"))
