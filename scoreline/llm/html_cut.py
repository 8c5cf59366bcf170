"""Main text of web pages by a minimum cut.

A page is read into blocks: runs of text between block-level tags.  Each block
gets a score from plain features (the elements it stands in, words of their
class, id and role, its length, its share of link text, stock phrases of notices
and imprints); a positive score is its capacity to the source (content), a
negative one to the sink (boilerplate).  Inside a boilerplate element nothing
that stands around or in it speaks for its text, only a ``main`` in it (or an
``article``, if it is a form) starts afresh.  Class words that name a part of a
page (sidebar, comments) say so whatever it holds; words that are topics and
styles as well (legal, alert, notice) count the less the more of the page's
text the element holds, and say nothing of an element that holds it all.

Neighbours in page order are joined by an edge of the size of a plain block's
score that falls with their distance in the element tree, and each block is
joined with the one before it under the same parent.  So a list
item or a short line, which looks like boilerplate by itself, goes with the
paragraphs it stands between.  The minimum cut of that graph is the labelling
with the least sum of overruled scores and parted neighbours; blocks on the
source side are content.

Blocks whose score outweighs all their edges keep its label in every minimum
cut, so they are settled first and the flow runs on what is left.  Pages are
independent: one Arrow pass, no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreline.llm.common import small_batches

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option
p pre search section select summary table tbody td textarea tfoot th thead tr ul""".split())
_SILENT = frozenset("script style template noscript iframe object svg math title canvas audio video map noframes".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}, "optgroup": {"option", "optgroup"}}
_SCOPES = frozenset("table ul ol dl select article section main body html menu td th div".split())

#: element scores: what standing inside of it says
_TAG = {"nav": -8, "footer": -8, "aside": -8, "form": -8, "button": -8, "select": -8, "textarea": -8, "menu": -8, "dialog": -8,
        "search": -8, "fieldset": -6, "option": -8, "header": -5, "article": 4, "main": 3}
_BAD = frozenset("""ad ads adv advert adverts advertisement advertising billboard sponsor sponsored popup modal overlay subscribe paywall
breadcrumb breadcrumbs menu nav navbar navigation sidebar related recommended recommendations comment comments commentlist disqus
reply replies footer foot header masthead topbar toolbar pagination pager hidden outbrain taboola""".split())
#: words that name a part of a page, but also a topic or a style
_DOUBTFUL = frozenset("""banner promo promotion promoted cookie cookies consent gdpr notice notices alert toast subscription newsletter signup
login share sharing social follow side discussion reactions respond widget disclaimer copyright legal search skip teaser tags meta
byline""".split())
#: together they name a part of a page: user-reviews, author-box
_PAIRS = [(frozenset("user users reader readers customer customers guest visitor".split()), frozenset("review reviews opinion opinions feedback".split())),
          (frozenset("author authors".split()), frozenset("box bio info card about profile".split()))]
_GOOD = frozenset("article content entry post story text main body page hentry articlebody".split())
_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar status".split())
#: class names that mention a part of the page without being it: has-sidebar, share-enabled, hidden-xs, article-header,
#: content-sidebar-wrap
_STATES = frozenset("has no with without enabled disabled open closed on off none free collapsed expanded layout".split())
_SIZES = frozenset("xs sm md lg xl xxl print".split())
_WRAPS = frozenset("wrap wrapper container grid row columns".split())
_HEADED = frozenset("article content entry post story page hentry".split())
_WORDS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: what a doubtful class says of an element with next to none of the page's text
_DOUBT = -8.0
#: from here on it governs like a boilerplate element; weaker, it is added to what stands around
_GOVERNS = -4.0
_COOKIES = re.compile(r"\b(we|site|website|page) uses? cookies|accept (all )?cookies|cookie policy", re.I)
_IMPRINT = re.compile(r"^(©|\(c\)|copyright\b)|\ball rights reserved\b", re.I)


class _Element:
    """An element: its tag, depth, parent, own evidence, and what standing in it
    says: ``bad`` of the boilerplate it stands in, else ``good`` of all around it."""

    __slots__ = ("tag", "parent", "depth", "own", "doubtful", "main", "words", "good", "bad", "bar", "in_article")

    def __init__(self, tag: str, parent: _Element | None, own: float, doubtful: bool = False, main: bool = False):
        self.tag, self.parent, self.own, self.doubtful, self.main = tag, parent, own, doubtful, main
        self.depth = parent.depth + 1 if parent else 0
        self.words = 0
        self.in_article = tag in ("article", "main") or (parent is not None and parent.in_article)
        self.weigh(0.0)

    def weigh(self, doubt: float) -> None:
        """Take what stands around from the parent and add the own evidence."""
        parent = self.parent
        self.good, self.bad, self.bar = (parent.good, parent.bad, parent.bar) if parent else (0.0, 0.0, 0)
        score = self.own + (doubt if doubt <= _GOVERNS else 0.0)
        if score < 0:
            self.bad += score
            self.bar = max(self.bar, 3 if score <= -16 else 1 if self.tag == "form" else 2)
        else:
            self.good += score + (doubt if doubt > _GOVERNS else 0.0)
            if self.bar < 3 and self.main or self.bar == 1 and self.tag == "article":
                self.bad, self.bar = 0.0, 0

    @property
    def score(self) -> float:
        return self.bad if self.bar else self.good


def _settle(elements: list[_Element], blocks: list[tuple[str, int, _Element]]) -> None:
    """Weigh doubtful classes by how much of the page's text their elements hold;
    ``elements`` in the order of their opening, so parents come first."""
    if not any(e.doubtful for e in elements):
        return
    for text, _, element in blocks:
        if not element.bar:
            element.words += text.count(" ") + 1
    for e in reversed(elements):
        if e.parent:
            e.parent.words += e.words
    every = max(1, elements[0].words)
    for e in elements:
        e.weigh(_DOUBT * (1 - e.words / every) ** 2 if e.doubtful else 0.0)


class _Reader(HTMLParser):
    """Collects blocks: (text, link characters, innermost element)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, _Element]] = []
        self.path = [_Element("", None, 0.0)]
        self.elements = list(self.path)
        self.open: Counter = Counter()
        self.silent = ""
        self.muted: list[str] = []                     # open elements from a hidden inline one on
        self.muted_in = 0                              # open block elements around it
        self.parts: list[str] = []
        self.in_link = self.link_chars = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((text, self.link_chars, self.path[-1]))
            self.parts, self.link_chars = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.silent:
            return
        if tag in _SILENT:
            self.silent = tag
            return
        if tag == "a":
            self.in_link = 1
        if tag == "br":
            self.parts.append(" ")
            return
        score, doubtful = _element_score(tag, attrs, self.path[-1].in_article) if attrs or tag in _TAG else (0.0, False)
        if tag not in _BLOCK:
            if tag not in _VOID and (self.muted or score <= -16):       # hidden, up to its end or that of the block
                if not self.muted:
                    self.muted_in = len(self.path)
                self.muted.append(tag)
            return
        self.flush()
        if tag in _VOID:
            return
        if "p" in (e.tag for e in self.path[-3:]):     # a block ends an open paragraph
            self._leave("p")
        if tag in _CLOSES:
            for i in range(len(self.path) - 1, 0, -1):
                if self.path[i].tag in _CLOSES[tag]:
                    self._cut(i)
                    break
                if self.path[i].tag in _SCOPES:
                    break
        self.path.append(_Element(tag, self.path[-1], score, doubtful, tag == "main" or ("role", "main") in attrs))
        self.elements.append(self.path[-1])
        self.open[tag] += 1

    def _leave(self, tag: str) -> None:
        if self.open[tag]:
            i = len(self.path) - 1
            while self.path[i].tag != tag:
                i -= 1
            self._cut(i)

    def _cut(self, i: int) -> None:
        self.open.subtract(e.tag for e in self.path[i:])
        del self.path[i:]
        if len(self.path) < self.muted_in:
            self.muted = []

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag == self.silent:
                self.silent = ""
            return
        if tag == "a":
            self.in_link = 0
        if tag in _BLOCK:
            self.flush()
            self._leave(tag)
        elif tag in self.muted:
            del self.muted[len(self.muted) - 1 - self.muted[::-1].index(tag):]

    def handle_data(self, data: str) -> None:
        if not self.silent and not self.muted:
            self.parts.append(data)
            self.link_chars += self.in_link * len(data)


def _names_boilerplate(name: str) -> bool:
    """One class name or id says that the element is boilerplate, not merely that
    the page or the article has some."""
    listed = _WORDS.findall(name)
    words = set(listed)
    if any(words & a and words & b for a, b in _PAIRS):
        return True
    bad = words & _BAD
    if not bad or words & _STATES or (bad == {"hidden"} and words & _SIZES):
        return False
    if bad == {"sidebar"} and words & _GOOD and words & _WRAPS:
        return False
    return not (bad == {"header"} and _heads_article(listed))


def _is_doubtful(name: str) -> bool:
    words = set(_WORDS.findall(name))
    return bool(words & _DOUBTFUL) and not words & _STATES


def _heads_article(words: list[str]) -> bool:
    return any(a in _HEADED and b == "header" for a, b in zip(words, words[1:]))


def _element_score(tag: str, attrs: list, in_article: bool) -> tuple[float, bool]:
    """Evidence of an element's tag and attributes, and whether a class of it is
    doubtful."""
    score, doubtful = 0.0 if tag == "header" and in_article else float(_TAG.get(tag, 0)), False
    for name, value in attrs:
        value = (value or "").lower()
        if name in ("class", "id"):
            words = set(_WORDS.findall(value))
            if tag in ("body", "html", "main", "article") or (tag == "header" and in_article):
                continue
            if any(_names_boilerplate(c) for c in value.split()):
                score -= 8
                continue
            if any(_is_doubtful(c) for c in value.split()):
                doubtful = True
            if tag == "header" and any(_heads_article(_WORDS.findall(c)) for c in value.split()):
                score += 5                             # undoes the tag's
            elif words & _GOOD and not doubtful:
                score += 1.5
        elif name == "role":
            score += -8 if value in _ROLE else 3 if value in ("main", "article") else 0
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
            score -= 20
    return score, doubtful


def read_blocks(html: str) -> list[tuple[str, int, _Element]]:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    _settle(reader.elements, reader.blocks)
    return reader.blocks


def block_score(text: str, link_chars: int, element: _Element) -> float:
    words = text.count(" ") + 1
    score = element.score - 1.0 + min(words, 60) / 20
    if text[-1] in ".!?\"'”:;…":
        score += 0.5
    if element.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre", "li", "dt", "dd"):
        score += 0.7
    if words < 60:
        score -= 8 if _COOKIES.search(text) else 3 if _IMPRINT.search(text) else 0
    return score - 4 * min(1.0, link_chars / len(text))


def page_edges(blocks: list[tuple[str, int, _Element]]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours in page order, weaker the further apart in
    the tree (1.25 between siblings), and the last block before with the same
    parent element."""
    edges, last = [], {}
    for i, (_, _, element) in enumerate(blocks):
        parent = element.parent or element
        if i:
            a, b, steps = blocks[i - 1][2], element, 0
            while a is not b:                          # to the nearest common element
                if a.depth >= b.depth:
                    a = a.parent
                else:
                    b = b.parent
                steps += 1
            edges.append((i - 1, i, 2.5 / max(steps, 2)))
            if last.get(parent, i - 1) != i - 1:
                edges.append((last[parent], i, 0.8))
        last[parent] = i
    return edges


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: source side) of least cost: an overruled block costs its
    score, a parted edge its weight."""
    n = len(scores)
    s = list(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:                                        # settle what outweighs its edges
        i = todo.popleft()
        if label[i] is None and abs(s[i]) >= sum(near[i].values()):
            label[i] = s[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                s[j] += w if label[i] else -w
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        source = _flow(rest, s, near)
        for i in rest:
            label[i] = i in source
    return label


def _flow(rest: list[int], s: list[float], near: list[dict[int, float]]) -> set[int]:
    """Maximum flow by shortest paths in layers; the blocks that the source still
    reaches in the residual graph."""
    room: dict[object, dict[object, float]] = {i: dict(near[i]) for i in rest}
    room["s"], room["t"] = {}, {}
    for i in rest:
        if s[i] > 0:
            room["s"][i], room[i]["s"] = s[i], 0.0
        elif s[i] < 0:
            room[i]["t"], room["t"][i] = -s[i], 0.0
    while True:
        layer, queue = {"s": 0}, deque(["s"])
        while queue:
            x = queue.popleft()
            for y, c in room[x].items():
                if c > 1e-12 and y not in layer:
                    layer[y] = layer[x] + 1
                    queue.append(y)
        if "t" not in layer:
            return {x for x in layer if x != "s"}
        open_edges = {x: iter(list(room[x])) for x in layer}
        path = ["s"]
        while path:
            x = path[-1]
            if x == "t":
                push = min(room[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    room[a][b] -= push
                    room[b][a] = room[b].get(a, 0.0) + push
                cut = next(k for k, (a, b) in enumerate(zip(path, path[1:])) if room[a][b] <= 1e-12)
                open_edges[path[cut]] = iter([y for y in room[path[cut]] if room[path[cut]][y] > 1e-12])
                del path[cut + 1:]
                continue
            for y in open_edges[x]:
                if room[x][y] > 1e-12 and layer.get(y) == layer[x] + 1:
                    path.append(y)
                    break
            else:
                layer[x] = -1                          # a dead end in this layering
                path.pop()


def labelled_blocks(html: str) -> list[tuple[str, float, bool]]:
    """Every block of a page in order: its text, its own score, and whether the
    minimum cut leaves it on the side of content."""
    blocks = read_blocks(html)
    scores = [block_score(*b) for b in blocks]
    return [(b[0], score, label) for b, score, label in zip(blocks, scores, minimum_cut(scores, page_edges(blocks)))]


def main_text(html: str) -> str:
    return "\n".join(text for text, _, content in labelled_blocks(html) if content)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text, n_chars of every row, from its whole html; null html
    or a page without content gives an empty text.  Ids and urls may be null or
    repeat; extra columns are ignored; no rows give none."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    done = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, url string, text string, n_chars bigint")
    return done.withColumnsRenamed({"id": id_col, "url": url_col})
