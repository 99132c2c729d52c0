"""Main-text extraction by tag-path ratios.

Every text node of a page has a path of tags from the root. For each path the
nodes, characters of text and punctuation marks are summed; text per node and
punctuation per node are smoothed over the order in which paths first appear, and fused
by multiplication. What an element is called weighs in: a path's weight is the product
of those of its elements, below one for navigation, adverts, comments and the like, less so for
names that articles have too, and above one for what is marked as an article. A name is never a veto: long
text under a doubtful name outweighs it.

The threshold is a share of the weighted ratio in the middle of the page's text (a median, in which a
path counts by its characters times its ratio, so that neither one very long nor very many short paths move it far). Paths that pass are
the seeds; the content node is the deepest element marked as an article that holds nearly all of
their text, or else the deepest container that does. Under it all paths are kept, short
ones too (lists, tables, code, quotes, captions), but for those below a doubtful name that do not reach
the threshold themselves. Headings of the elements around it come along.

Text nodes join into blocks at block-level tags. Tags of scripts and styles, and
comments, hold no text. Unclosed tags close the way HTML closes them; markup cut
off at the end of the page ends there.

Paths are numbered as nodes of a trie and open elements are found by tag, so time and
memory are in proportion to the page, however deep it nests.

Defined cases: null and empty pages have an empty text; pages without a text node
too; a very long page is one row and is worked on whole; repeated pages give a row each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_MARKS = re.compile(r"[.,;:!?。，、！？；：…¿¡]")
#: Fixed values of HTML: elements without an end, elements whose content is not markup, and elements inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: An opening tag on the left closes an open one on the right.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPES = frozenset("ul ol dl table article section main div body aside nav header footer form blockquote select".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements, and words in class, id or role, that are hardly ever article text, and words that articles have too.
ASIDE = frozenset("head nav header footer aside form button select input dialog menu svg canvas audio video object fieldset".split())
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored cookie cookies consent notice notification alert nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget comment comments "
    "reply replies respond disqus share sharing social newsletter subscribe popup modal login signup search pagination pager toolbar skip copyright legal disclaimer complementary contentinfo".split()
)
DOUBTFUL_WORDS = frozenset("banner promo promotion related recommended".split())
MAIN = frozenset(("article", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MAIN_WORDS = frozenset(("article", "articlebody", "main", "maincontent", "post", "postcontent", "entrycontent", "storybody", "content"))
#: Elements that hold others, in which the content may be all there is.
CONTAINERS = frozenset("html body main article section div center table tbody tr td".split())
#: Weights of names; the share of the middle ratio that a path must reach; the share of the seeds' text that the content node holds.
WEIGHTS, SHARE, HELD = {"-": 0.02, "~": 0.1, "+": 4.0}, 0.1, 0.95
#: A path of whose text this share is in links is doubtful.
MENU = 0.8


def _kind(tag: str, attributes: str) -> str:
    """The names of an element: '-' for what is not article text, '~' for what is doubtful, '+' for what is marked as an article."""
    words = {w for m in _NAMED.finditer(attributes) for w in re.split(r"[^a-z0-9]+", (m[1] or m[2] or m[3] or "").lower())} if attributes else set()
    main = tag in MAIN or (tag in ("div", "section", "td") and bool(words & _MAIN_WORDS))
    return "-" * (tag in ASIDE or bool(words & ASIDE_WORDS)) + "~" * bool(words & DOUBTFUL_WORDS) + "+" * main


class Paths:
    """The tag paths of a page, as nodes of a trie: each path is its last element and the path above."""

    def __init__(self) -> None:
        self.above, self.label = [-1], [""]
        self.weight, self.own, self.marked = [1.0], [1.0], [False]
        #: Of each text node, whether it is in a link.
        self.linked: list[bool] = []
        self.known: dict[tuple[int, str], int] = {}

    def child(self, above: int, tag: str, kind: str) -> int:
        node = self.known.setdefault((above, tag + kind), len(self.label))
        if node == len(self.label):
            own = 1.0
            for k in kind:
                own *= WEIGHTS[k]
            self.above.append(above)
            self.label.append(tag)
            self.own.append(own)
            # Any number of names of one kind, one in the other, are still a weight.
            self.weight.append(min(max(self.weight[above] * own, 1e-9), 1e3))
            self.marked.append("+" in kind and "-" not in kind)
        return node

    def up(self, node: int) -> Iterator[int]:
        while node >= 0:
            yield node
            node = self.above[node]


class _Open:
    """The open elements, with the places of each tag and of those that end tags do not reach out of."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def path(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def reaches(self, place: int) -> bool:
        return place >= 0 and (not self.scopes or self.scopes[-1] < place)

    def push(self, tag: str, path: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append((tag, path))

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            tag, _ = self.stack.pop()
            self.places[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()


def text_nodes(html: str) -> tuple[list[str], list[int], list[int], Paths]:
    """Text nodes; each one's path; the number of its block; the paths."""
    texts: list[str] = []
    path_of: list[int] = []
    block_of: list[int] = []
    paths, open_ = Paths(), _Open()
    block, at = 0, 0

    def add(text: str) -> None:
        texts.append(unescape(text))
        path_of.append(open_.path())
        block_of.append(block)
        paths.linked.append(open_.last(("a",)) >= 0)

    size = len(html)
    while at < size:
        start = html.find("<", at)
        found = _TOKEN.match(html, start) if start >= 0 else None
        while start >= 0 and not found:
            start = html.find("<", start + 1)
            found = _TOKEN.match(html, start) if start >= 0 else None
        if start < 0:
            add(html[at:])
            break
        if start > at:
            add(html[at:start])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            place = open_.last((tag,))
            # An end tag does not reach out of the section it stands in.
            if place >= 0 and (tag in SCOPES or open_.reaches(place)):
                open_.cut(place)
            block += tag not in INLINE
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(html, at)
            at = close.start() if close else size
            if close:
                end = html.find(">", at)
                at = end + 1 if end >= 0 else size
            block += tag not in INLINE
            continue
        if tag not in INLINE:
            if tag == "br":
                add(" ") if texts and block_of[-1] == block else None
                continue
            block += 1
        closes = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        if closes and open_.reaches(place := open_.last(closes)):
            open_.cut(place)
        if tag not in VOID and not found[3].rstrip().endswith("/"):
            kind = _kind(tag, found[3])
            open_.push(tag, paths.child(open_.path(), tag, kind) if tag not in INLINE or kind else open_.path())
    return texts, path_of, block_of, paths


def _smooth(x: np.ndarray) -> np.ndarray:
    """Mean with the neighbours, which weigh half."""
    padded = np.concatenate([x[:1], x, x[-1:]])
    return (padded[:-2] + 2 * padded[1:-1] + padded[2:]) / 4


def _content_node(paths: Paths, order: list[int], mass: np.ndarray) -> int:
    """The deepest marked element, or else the deepest container, that holds nearly all of the mass (of text, by path)."""
    held = np.zeros(len(paths.label))
    np.add.at(held, np.array(order), mass)
    # Nodes come after those above them.
    for node in range(len(held) - 1, 0, -1):
        held[paths.above[node]] += held[node]
    node, marked, children = 0, None, {}
    for child, above in enumerate(paths.above):
        children.setdefault(above, []).append(child)
    while True:
        marked = node if paths.marked[node] else marked
        node_ = max(children.get(node, ()), key=held.__getitem__, default=None)
        if node_ is None or held[node_] < HELD * held[0] or paths.label[node_] not in CONTAINERS:
            return node if marked is None else marked
        node = node_


def chosen_paths(paths: Paths, order: list[int], nodes: np.ndarray, characters: np.ndarray, marks: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Which of the paths in ``order`` hold content. links: characters in links, of which menus are made."""
    menu = links >= MENU * np.maximum(characters, 1)
    weight = np.array([paths.weight[p] for p in order]) * np.where(menu, WEIGHTS["~"], 1.0)
    fused = weight * _smooth(characters / np.maximum(nodes, 1)) * (1 + _smooth(marks / np.maximum(nodes, 1)))
    mass = characters * weight
    if not mass.sum():
        return np.zeros(len(order), bool)
    rank, worth = np.argsort(fused, kind="stable"), characters * fused
    middle = fused[rank[np.searchsorted(np.cumsum(worth[rank]), worth.sum() / 2)]] if worth.sum() else 0.0
    seeds = (fused >= SHARE * middle) & (characters > 0)
    content = _content_node(paths, order, np.where(seeds, mass, 0))
    # Names on the way from the content node to a path. Nodes come after those above them.
    inside, doubt = np.zeros(len(paths.label), bool), np.zeros(len(paths.label), bool)
    inside[content] = True
    for node in range(content + 1, len(inside)):
        inside[node] = inside[paths.above[node]]
        doubt[node] = inside[node] and (doubt[paths.above[node]] or paths.own[node] < 1)
    keep = inside[order] & (seeds | ~(doubt[order] | menu))
    around = set(paths.up(content))
    heads = np.array([paths.label[p] in _HEADINGS and paths.above[p] in around and paths.own[p] >= 1 for p in order], bool)
    # Above the content node, a doubtful name covers the content as well.
    return (keep | heads) & (characters > 0)


def main_text(html: bytes | None) -> str:
    """The article of a page: blocks in page order, one space between them."""
    page = (html or b"").decode("utf-8", "replace")
    texts, path_of, block_of, paths = text_nodes(page)
    if not texts:
        return ""
    # Paths in the order in which they first hold a text node.
    number = {p: i for i, p in enumerate(dict.fromkeys(path_of))}
    ids = np.array([number[p] for p in path_of])
    sizes = np.array([len("".join(t.split())) for t in texts])
    dots = np.array([len(_MARKS.findall(t)) for t in texts])
    n = len(number)
    keep = chosen_paths(paths, list(number), np.bincount(ids, sizes > 0, n), np.bincount(ids, sizes, n), np.bincount(ids, dots, n), np.bincount(ids, sizes * np.array(paths.linked), n))
    blocks: dict[int, list[str]] = {}
    for text, path, block in zip(texts, ids, block_of):
        if keep[path]:
            blocks.setdefault(block, []).append(text)
    joined = (" ".join("".join(b).split()) for b in blocks.values())
    return " ".join(b for b in joined if b)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column("html").cast(pa.large_binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
