"""HTML extraction by minimum-cut labelling.

A page is cut into blocks (runs of text between block-level tags). What a block costs as boilerplate and as content has
two parts. The text's part comes from a logistic classifier over its words, links, punctuation and kind of tag. It is
learned from the pages themselves: blocks inside an article count as content, blocks of menus, footers, adverts and
elements named like them as boilerplate, and the classifier sees neither these tags nor names. It is fitted on
``fit_pages`` pages (expected, by the hash of the page) and from counts of equal feature cells only, whose number is
fixed; where pages do not show both kinds, ``DEFAULT`` stands in. The place's part is fixed evidence: articles, names of
elements, forms, headings. The costs become capacities from the source and to the sink. Blocks that follow each other,
and blocks with the same parent, are tied by smoothness edges, the stronger the more ancestors they share. The minimum
cut labels all blocks of the page at once; those on the source's side, in page order, are the main text.

Some things hold less the more a page speaks against them: text outside the articles is held against by the articles'
share of the page's words; a form is none in this sense if it holds an article or, on a page without one, most words; and weak
names (``WEAK_NAMES``) say nothing where a name of content stands beside them or where most of the articles lie inside.

Defined results: null and empty pages, and pages without content, give an empty text; unclosed and stray tags are borne;
markup that ends in the middle of a tag counts as ended there; pages of any length and depth are read whole; repeated
pages get a row each; empty tables give no rows; further columns are kept, those with the added names replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.shared import ship

#: Tags at which a block begins and ends.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose start ends an open element of one of these, up to the nearest of the others.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Never content, whatever stands in them.
NEVER = frozenset("head title script style noscript template nav footer aside button select textarea option label iframe object svg canvas audio video dialog menu".split())
LANDMARKS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id and role that tell of boilerplate, or of content.
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie cookies copyright dialog disqus footer gdpr header legal login masthead menu menubar modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination popup promo promoted promotion recommended related replies respond search share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe taboola tags toolbar warning widget".split()
)
#: Names that do not tell of boilerplate beside a name of content or around the articles.
WEAK_NAMES = frozenset("header legal notice search share social tags warning widget".split())
#: Beside these a name tells of the whole layout (page-with-sidebar, no-comments), not of the element.
LAYOUT_NAMES = frozenset("container has layout no page with without wrapper".split())
GOOD_NAMES = frozenset("article articlebody body content entry main maincontent page post prose story text".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Cost of a label that is out of the question, and the unit in which costs are counted.
INFINITE, UNIT = 10**9, 100


class Element:
    __slots__ = ("tag", "depth", "parent", "never", "bad", "good", "landmark", "link", "form", "own_bad", "own_good", "weak", "words", "inside", "holds")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Element | None):
        names = [{w.lower() for w in _NAME.findall(name)} for key in ("class", "id", "role") for name in (attrs.get(key) or "").split()]
        bad = set().union(*[n & BAD_NAMES for n in names if not n & LAYOUT_NAMES]) if tag not in ("body", "html") else set()
        good = any(n & GOOD_NAMES and not n & BAD_NAMES for n in names)
        inherit = parent or _ROOT
        self.tag, self.parent, self.depth = tag, parent, inherit.depth + 1 if parent else 0
        self.weak = bool(bad) and bad <= WEAK_NAMES
        self.own_bad = bool(bad) and not (self.weak and good)
        self.own_good = good and not bad and tag in ("div", "section", "td")
        self.landmark = inherit.landmark or (tag in LANDMARKS and not self.own_bad)
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(_HIDDEN.search(attrs.get("style") or ""))
        self.never = inherit.never or tag in NEVER or hidden or (tag == "header" and not inherit.landmark)
        self.link = inherit.link or tag == "a"
        # known when the page is read: words of blocks, of blocks in articles, and whether an article is inside
        self.words, self.inside, self.holds = 0, 0, tag in LANDMARKS and not self.never and not self.own_bad
        self.bad, self.good, self.form = 0, 0, False


class _Root:
    depth, never, bad, good, landmark, link, form, tag = -1, False, 0, 0, False, False, False, ""


_ROOT = _Root()


class Block:
    __slots__ = ("text", "parent", "linked", "size", "words")

    def __init__(self, text: str, parent: Element | None, linked: int, size: int):
        self.text, self.parent, self.linked, self.size = text, parent, linked, size
        self.words = text.count(" ") + 1


class Page(HTMLParser):
    """Cuts a page into blocks, each with the element it lies in."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.stack: list[Element] = []
        self.elements: list[Element] = []
        self.blocks: list[Block] = []
        self.run: list[str] = []
        self.linked, self.size, self.where = 0, 0, None
        self.feed(html)
        self.close()
        self._end()
        self._weigh()

    def _weigh(self) -> None:
        """What elements hold, from the innermost outwards, and then what follows from it, inwards."""
        for b in self.blocks:
            where = b.parent
            if where and not where.never:
                where.words += b.words
                where.inside += b.words * where.landmark
        for e in reversed(self.elements):
            if e.parent:
                e.parent.words += e.words
                e.parent.inside += e.inside
                e.parent.holds |= e.holds
        words = sum(b.words for b in self.blocks if not (b.parent or _ROOT).never)
        inside = sum(e.inside for e in self.elements if e.parent is None)
        own = outside = 0
        for e in self.elements:
            inherit = e.parent or _ROOT
            around = e.weak and inside and 2 * e.inside > inside
            e.bad = inherit.bad + (e.own_bad and not around)
            e.good = inherit.good + e.own_good
            wraps = e.holds or (not inside and e.words >= 30 and 2 * e.words > words)
            e.form = inherit.form or (e.tag == "form" and not wraps)
        for b in self.blocks:
            where = b.parent or _ROOT
            if not (where.never or where.bad or where.form):
                own += b.words * where.landmark
                outside += b.words * (not where.landmark)
        #: The articles' share of the words that nothing else speaks against; 0 without articles.
        self.share = own / (own + outside) if own else 0.0

    def _end(self) -> None:
        text = " ".join("".join(self.run).split())
        if text:
            self.blocks.append(Block(text, self.where, self.linked, self.size))
        self.run, self.linked, self.size, self.where = [], 0, 0, None

    def _pop(self, names: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag in names:
                del self.stack[i:]
                return
            if self.stack[i].tag in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.run.append(" ")
            return
        if tag in BLOCK_TAGS:
            self._end()
            self._pop({"p"}, {"td", "th", "button", "li", "div", "article", "section", "table", "form"})
            if tag in CLOSES:
                self._pop(*CLOSES[tag])
        if tag not in VOID_TAGS:
            self.stack.append(Element(tag, dict(attrs), self.stack[-1] if self.stack else None))
            self.elements.append(self.stack[-1])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self._end()
        self._pop({tag}, frozenset())

    def handle_data(self, data):
        if self.stack and self.stack[-1].tag in ("script", "style"):
            return
        self.run.append(data)
        if data and not data.isspace():
            inner = self.stack[-1] if self.stack else None
            self.size += len(data)
            if inner and inner.link:
                self.linked += len(data)
            if self.where is None:
                # the innermost block-level element: inline ones do not part neighbours
                while inner and inner.tag not in BLOCK_TAGS and not inner.never:
                    inner = inner.parent
                self.where = inner


#: Weights of the classifier where pages cannot teach it: doublings of words, a sentence's end, share of linked
#: characters, commas, paragraph, list item, heading, and the constant.
DEFAULT = (0.7, 1.0, -3.0, 0.2, 0.5, -0.3, 0.3, -2.8)
#: The text's evidence is bounded, in logits, so that no text outweighs its place.
MOST = 3.0
#: Evidence of the place: in an article; outside, at most; by a name of content, of boilerplate; in a form; a heading in an article.
ARTICLE, OUTSIDE, GOOD, BAD, FORM, HEADING = 4.0, 6.0, 2.0, 9.0, 9.0, 2.0


def cell(block: Block) -> tuple[int, int, int, int, int]:
    """A block's features, cut into few values: words, sentence end, links, commas, kind of tag."""
    tag = (block.parent or _ROOT).tag
    kind = 1 if tag in ("p", "blockquote", "pre") else 2 if tag in ("li", "dd", "dt") else 3 if tag in HEADINGS else 0
    end = block.text.rstrip("\"')").endswith((".", "!", "?", ":", "…", "。"))
    return min(7, block.words.bit_length() - 1), int(end), round(4 * block.linked / max(1, block.size)), min(4, block.text.count(",")), kind


def evidence(features: tuple[int, int, int, int, int]) -> tuple[float, ...]:
    words, end, linked, commas, kind = features
    return (float(words), float(end), linked / 4, float(commas), float(kind == 1), float(kind == 2), float(kind == 3), 1.0)


def costs(block: Block, share: float, weights: tuple[float, ...] = DEFAULT) -> tuple[int, int]:
    """(cost of calling it boilerplate, cost of calling it content); share: of the page's words in articles."""
    where = block.parent or _ROOT
    if where.never:
        return 0, INFINITE
    logit = max(-MOST, min(MOST, sum(w * x for w, x in zip(weights, evidence(cell(block)), strict=True))))
    keep, drop = math.log1p(math.exp(logit)), math.log1p(math.exp(-logit))  # minus the logarithms of the two odds
    if where.landmark:
        keep += ARTICLE
        keep += HEADING * (where.tag in HEADINGS)
    else:
        drop += OUTSIDE * min(1.0, 1.5 * share)
    keep += GOOD * min(2, where.good)
    drop += BAD * min(2, where.bad) + FORM * where.form
    return round(keep * UNIT), round(drop * UNIT)


def taught(page: Page) -> list[tuple[tuple[int, int, int, int, int], int]]:
    """Feature cells of blocks that their place tells the label of: 1 in an article, 0 in what is named as boilerplate."""
    out = []
    for b in page.blocks:
        where = b.parent or _ROOT
        if where.landmark and not (where.never or where.bad or where.form):
            out.append((cell(b), 1))
        elif where.bad or where.form or _in_menu(where):
            out.append((cell(b), 0))
    return out


def _in_menu(element) -> bool:
    while element and element is not _ROOT:
        if element.tag in ("nav", "footer", "aside", "menu"):
            return True
        if element.tag in ("head", "script", "style", "template"):
            return False
        element = element.parent
    return False


def logistic(counts: dict[tuple[tuple[int, int, int, int, int], int], int], ridge: float = 1.0) -> tuple[float, ...]:
    """Weights by Newton steps over counted cells, both labels weighing the same; DEFAULT without both."""
    total = [sum(n for (_, y), n in counts.items() if y == label) for label in (0, 1)]
    if not all(total):
        return DEFAULT
    keys = sorted(counts)
    x = np.array([evidence(c) for c, _ in keys])
    y = np.array([label for _, label in keys], float)
    weight = np.array([counts[k] / total[k[1]] for k in keys]) * 500
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + keep * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep), gradient)
        w -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return tuple(round(float(v), 6) for v in w)


def fit(pages: DataFrame, html: str = "html", fit_pages: int = 2000) -> tuple[float, ...]:
    """The classifier's weights, from about fit_pages pages; at most 2 * 8 * 2 * 5 * 5 * 4 rows of counts reach the driver."""
    ship(pages.sparkSession)
    n = pages.count()
    hashes = 1 << 20
    cut = min(hashes, -(-fit_pages * hashes // max(1, n)))
    sample = pages.select(F.col(f"`{html}`").alias("html")).where(F.pmod(F.xxhash64("html", F.lit("cut")), F.lit(hashes)) < cut)

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(taught(Page(text or "")))
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([list(c) for c, _ in keys], pa.list_(pa.int32())), pa.array([y for _, y in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], names=["cell", "label", "n"])

    rows = sample.mapInArrow(count, "cell array<int>, label int, n long").groupBy("cell", "label").agg(F.sum("n").alias("n")).collect()
    return logistic({(tuple(r["cell"]), r["label"]): r["n"] for r in rows})


def proximity(a: Element | None, b: Element | None) -> float:
    """Share of the elements around two blocks that are around both, 1 for siblings; 0 across the border of an article,
    of a form or of what is named or never content."""
    x, y = a or _ROOT, b or _ROOT
    if (x.landmark, x.never, x.bad, x.form) != (y.landmark, y.never, y.bad, y.form):
        return 0.0
    if x.depth <= 0 and y.depth <= 0:
        return 1.0  # nothing is around them
    longest = max(x.depth, y.depth)
    while a and b and a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return min(1.0, (a.depth + 1) / longest) if a and a is b else 0.0


def minimum_cut(sources: list[int], sinks: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut; edges (u, v, capacity) go both ways. Dinic's algorithm."""
    n = len(sources)
    s, t = n, n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(u: int, v: int, forth: int, back: int) -> None:
        out[u].append(len(to))
        to.append(v)
        room.append(forth)
        out[v].append(len(to))
        to.append(u)
        room.append(back)

    for i, (a, b) in enumerate(zip(sources, sinks, strict=True)):
        straight = min(a, b)  # flows through the node without any edge
        if a > straight:
            arc(s, i, a - straight, 0)
        if b > straight:
            arc(i, t, b - straight, 0)
    for u, v, c in edges:
        arc(u, v, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if room[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        tried = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                amount = min(room[e] for e in path)
                for e in path:
                    room[e] -= amount
                    room[e ^ 1] += amount
                path, u = [], s
                continue
            while tried[u] < len(out[u]):
                e = out[u][tried[u]]
                if room[e] > 0 and level[to[e]] == level[u] + 1:
                    break
                tried[u] += 1
            if tried[u] < len(out[u]):
                e = out[u][tried[u]]
                path.append(e)
                u = to[e]
            elif path:
                u = to[path.pop() ^ 1]
                tried[u] += 1
            else:
                break


def label(page: Page, weights: tuple[float, ...] = DEFAULT, smooth: float = 1.5) -> list[bool]:
    """Whether each block of the page is content."""
    blocks = page.blocks
    priced = [costs(b, page.share, weights) for b in blocks]
    edges: list[tuple[int, int, int]] = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i and (c := round(smooth * UNIT * proximity(blocks[i - 1].parent, b.parent))):
            edges.append((i - 1, i, c))
        outer = id(b.parent.parent) if b.parent and b.parent.parent else 0
        before = last.get(outer)
        if before is not None and before != i - 1 and (c := round(0.5 * smooth * UNIT * proximity(blocks[before].parent, b.parent))):
            edges.append((before, i, c))
        last[outer] = i
    return minimum_cut([k for k, _ in priced], [d for _, d in priced], edges)


def main_text(html: str | None, weights: tuple[float, ...] = DEFAULT) -> str:
    page = Page(html or "")
    return "\n\n".join(b.text for b, content in zip(page.blocks, label(page, weights), strict=True) if content)


def extract(pages: DataFrame, html: str = "html", weights: tuple[float, ...] | None = None, fit_pages: int = 2000) -> DataFrame:
    """Adds text and n_chars to every page; weights are those of ``fit``, which is called without them."""
    ship(pages.sparkSession)
    weights = fit(pages, html, fit_pages) if weights is None else weights
    own = [c for c in pages.columns if c not in ("text", "n_chars")]
    kept = pages.select(*[F.col(f"`{c}`") for c in own])
    place = own.index(html)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                texts = [main_text(h, weights) for h in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*own, "text", "n_chars"])

    return kept.mapInArrow(run, T.StructType([*kept.schema, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
