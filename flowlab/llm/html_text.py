"""Main text of web pages: flat text blocks, classified by a decision tree on words, links, neighbours and containers.

A page is cut into blocks at every tag that is not an inline one.  A block
has its number of words, the share of them inside links, the same two for
the block before and after it, whether it is a heading, and what its
containers say of it.  A decision tree, fitted on the small labelled table
LABELLED, tells main blocks from the rest.

What containers say: the innermost tag or class that speaks of main text or
of page furniture counts; reader comments, sidebars and footers count
wherever they are open.  Scripts, styles, other embedded content, comments
of the source and tags are never text.

Defined results: null, empty and text-less pages have the empty text and no
characters; white space is what Unicode calls so, no-break spaces included;
a character reference without a known name stays as it is; tags that are not
closed end with their container; an unclosed comment or script goes on to the
end of the page; repeated rows each get their row; columns of the pages
named ``text`` or ``n_chars`` are replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from flowlab.llm.text import quoted, slices

RESULT = ["text", "n_chars"]

# Names of HTML elements and common words in class and id attributes.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
RAW = "script style title noscript template iframe svg math object canvas audio video textarea xmp noembed noframes"
CONTAINERS = frozenset("article main section div nav header footer aside form fieldset button select label menu dialog details figure ul ol dl table blockquote address center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_TAGS = frozenset(["article", "main"])
PLAIN_TAGS = frozenset(["nav", "header", "form", "fieldset", "button", "select", "label", "menu", "dialog", "address"])
STICKY_TAGS = frozenset(["aside", "footer"])
MAIN_WORDS = frozenset("article body content entry main post story text".split())
PLAIN_WORDS = frozenset("""ad ads adsense advert advertisement adverts alert author banner breadcrumb breadcrumbs byline consent cookie cookies copyright disclaimer
    gdpr header hidden login masthead menu meta modal nav navbar navigation newsletter notice pager pagination popup promo promoted promotion search share sharing
    signup skip social sponsor sponsored subscribe tags toc toolbar topbar widget""".split())
STICKY_WORDS = frozenset("aside comment comments discussion disqus footer recommended related replies reply respond responses sidebar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({'|'.join(RAW.split())})\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+>", re.IGNORECASE | re.DOTALL)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

NOTHING, MAIN, PLAIN, STICKY = range(4)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    heading: bool
    says: int      # what the innermost container that says anything says
    sticky: bool   # inside comments, a sidebar or a footer


def says(tag: str, attributes: str) -> int:
    """What one container says of its text."""
    words: set[str] = set()
    if "=" in attributes:
        for groups in _NAMES.findall(attributes):
            words.update(w.lower() for w in _WORD.findall(" ".join(groups)))
    if tag in STICKY_TAGS or words & STICKY_WORDS:
        return STICKY
    if tag in PLAIN_TAGS or words & PLAIN_WORDS or (attributes and _HIDDEN.search(attributes)):
        return PLAIN
    return MAIN if tag in MAIN_TAGS or words & MAIN_WORDS else NOTHING


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page, in page order."""
    found: list[Block] = []
    stack: list[tuple[str, int]] = []
    pieces: list[str] = []
    linked: list[str] = []
    in_link = heading = False
    inner, own, sticky, at = NOTHING, NOTHING, False, 0  # own: what the block's own tag says

    def close_block() -> None:
        if pieces:
            words = html.unescape("".join(pieces)).split()
            if words:
                n = min(len(words), len(html.unescape(" ".join(linked)).split())) if linked else 0
                found.append(Block(" ".join(words), len(words), n, heading, own or inner, sticky or own == STICKY))
            pieces.clear()
            linked.clear()

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            pieces.append(page[at:m.start()])
            if in_link:
                linked.append(pieces[-1])
        at = m.end()
        name = m[3] or m[6]
        if name is None:
            if m[1]:
                pieces.append(" ")
            continue
        tag, ends = name.lower(), bool(m[2] or m[5])
        if tag in INLINE:
            if tag == "a":
                in_link = not ends
            elif tag == "br":
                pieces.append(" ")
            continue
        close_block()
        heading = tag in HEADINGS and not ends
        if tag not in CONTAINERS:
            own = NOTHING if ends else says(tag, m[4] or m[7] or "")
            continue
        own = NOTHING
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        else:
            stack.append((tag, says(tag, m[4] or m[7] or "")))
            in_link = False
        inner = next((s for _, s in reversed(stack) if s != NOTHING), NOTHING)
        sticky = any(s == STICKY for _, s in stack)
    pieces.append(page[at:])
    if in_link:
        linked.append(pieces[-1])
    close_block()
    return found


FEATURES = ["words", "density", "words_before", "density_before", "words_after", "density_after", "heading", "in_main", "in_plain", "in_sticky", "page_has_main"]


def features(words: np.ndarray, linked: np.ndarray, heading: np.ndarray, inner: np.ndarray, sticky: np.ndarray, first: np.ndarray) -> np.ndarray:
    """FEATURES of the blocks of several pages; ``first``: index of each page's first block, and one entry more."""
    n = len(words)
    density = linked / np.maximum(words, 1)
    page = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.zeros((n, len(FEATURES)))
    if not n:
        return out
    same = page[1:] == page[:-1]
    for j, column in enumerate((words, density)):
        out[:, j] = column
        out[1:, 2 + j] = np.where(same, column[:-1], 0)
        out[:-1, 4 + j] = np.where(same, column[1:], 0)
    main = (inner == MAIN) & ~sticky
    out[:, 6], out[:, 7], out[:, 8], out[:, 9] = heading, main, inner == PLAIN, sticky
    out[:, 10] = np.bincount(page, weights=main, minlength=len(first) - 1)[page] > 0
    return out


@dataclass(frozen=True)
class Tree:
    """A binary decision tree: rows with a feature above the threshold go to the right child; leaves have feature -1."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    label: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        while (go := self.feature[at] >= 0).any():
            f = np.maximum(self.feature[at], 0)
            at = np.where(go, np.where(x[rows, f] > self.threshold[at], self.right[at], self.left[at]), at)
        return self.label[at]


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1) -> Tree:
    """Gini splits at midpoints; the lesser feature, then the lesser threshold, wins a tie."""
    nodes: list[list[float]] = []

    def best_split(rows: np.ndarray) -> tuple[float, int, float] | None:
        best = None
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, t = x[order, f], np.cumsum(y[order])
            cuts = np.flatnonzero(v[1:] > v[:-1])
            cuts = cuts[(cuts + 1 >= least) & (len(rows) - cuts - 1 >= least)]
            if len(cuts):
                nl, pl = cuts + 1.0, t[cuts]
                nr, pr = len(rows) - nl, t[-1] - pl
                impurity = 2 * pl * (1 - pl / nl) + 2 * pr * (1 - pr / nr)
                i = int(np.argmin(impurity))
                if best is None or impurity[i] < best[0] - 1e-12:
                    best = (float(impurity[i]), f, float(v[cuts[i]] + v[cuts[i] + 1]) / 2)
        return best

    def grow(rows: np.ndarray, left: int) -> int:
        me = len(nodes)
        positive = int(y[rows].sum())
        nodes.append([-1, 0.0, -1, -1, int(2 * positive >= len(rows))])
        if left and 0 < positive < len(rows) and (split := best_split(rows)):
            _, f, threshold = split
            above = x[rows, f] > threshold
            nodes[me][:2] = [f, threshold]
            nodes[me][2] = grow(rows[~above], left - 1)
            nodes[me][3] = grow(rows[above], left - 1)
        return me

    grow(np.arange(len(y)), depth)
    columns = list(zip(*nodes, strict=True))
    return Tree(*(np.array(c, dtype=np.float64 if i == 1 else np.int64) for i, c in enumerate(columns)))


#: The labelled table: pages as (what the containers say, words, linked words, heading, label); the label is 1 for main text.
_A, _N, _P, _S = MAIN, NOTHING, PLAIN, STICKY
LABELLED: list[list[tuple[int, int, int, int, int]]] = [
    # an article among menu, advert and footer
    [(_P, 1, 1, 0, 0), (_P, 2, 2, 0, 0), (_P, 1, 1, 0, 0), (_P, 9, 0, 0, 0), (_A, 8, 0, 1, 1), (_A, 60, 2, 0, 1), (_A, 2, 0, 0, 1), (_A, 34, 0, 0, 1), (_A, 1, 0, 0, 1), (_N, 30, 0, 0, 0), (_S, 12, 0, 0, 0)],
    # adverts and sharing between paragraphs; text outside the article is none of it
    [(_N, 14, 0, 0, 0), (_P, 6, 6, 0, 0), (_A, 5, 0, 1, 1), (_A, 80, 0, 0, 1), (_P, 25, 0, 0, 0), (_A, 3, 3, 0, 1), (_P, 4, 4, 0, 0), (_A, 44, 6, 0, 1), (_N, 40, 0, 0, 0), (_N, 5, 0, 1, 0)],
    # long reader comments, headings in furniture
    [(_P, 4, 0, 1, 0), (_P, 30, 0, 0, 0), (_A, 12, 0, 1, 1), (_A, 120, 9, 0, 1), (_A, 7, 0, 1, 1), (_A, 20, 20, 0, 1), (_S, 2, 0, 1, 0), (_S, 50, 0, 0, 0), (_S, 90, 1, 0, 0), (_S, 7, 7, 0, 0)],
    # only furniture
    [(_P, 3, 3, 0, 0), (_P, 20, 0, 0, 0), (_S, 16, 0, 0, 0), (_S, 3, 3, 0, 0)],
    # no container says main: prose among link lists
    [(_N, 2, 2, 0, 0), (_N, 3, 3, 0, 0), (_N, 1, 1, 0, 0), (_N, 7, 0, 1, 1), (_N, 70, 2, 0, 1), (_N, 6, 0, 0, 1), (_N, 45, 0, 0, 1), (_N, 18, 0, 0, 1), (_N, 4, 4, 0, 0), (_N, 3, 3, 0, 0), (_N, 6, 1, 0, 0)],
    [(_N, 12, 12, 0, 0), (_N, 9, 0, 1, 1), (_N, 33, 0, 0, 1), (_N, 52, 3, 0, 1), (_N, 10, 0, 0, 1), (_N, 28, 4, 0, 1), (_S, 30, 0, 0, 0), (_N, 5, 3, 0, 0), (_N, 4, 0, 0, 0)],
    # furniture with long texts where no container says main
    [(_P, 45, 0, 0, 0), (_P, 2, 2, 0, 0), (_N, 4, 0, 1, 1), (_N, 90, 0, 0, 1), (_N, 60, 0, 0, 1), (_S, 60, 0, 0, 0), (_S, 20, 0, 0, 0)],
    # link lists only
    [(_N, 4, 4, 0, 0), (_N, 20, 18, 0, 0), (_N, 6, 6, 0, 0), (_N, 30, 30, 0, 0), (_N, 2, 0, 1, 0), (_N, 3, 3, 0, 0)],
    # a page of plain paragraphs, one of a single paragraph, one of a short one
    [(_N, 24, 0, 0, 1), (_N, 3, 0, 0, 1), (_N, 31, 0, 0, 1), (_N, 1, 0, 0, 1), (_N, 2, 0, 0, 1), (_N, 35, 0, 0, 1)],
    [(_N, 40, 0, 0, 1)],
    [(_N, 6, 0, 0, 1)],
    # the same kinds once more, in other sizes and orders
    [(_N, 35, 0, 0, 0), (_N, 3, 0, 1, 0), (_A, 6, 0, 1, 1), (_A, 22, 0, 0, 1), (_P, 8, 0, 1, 0), (_A, 9, 9, 0, 1), (_N, 8, 2, 0, 0), (_S, 3, 0, 1, 0), (_S, 70, 0, 0, 0)],
    [(_P, 50, 0, 0, 0), (_P, 5, 0, 1, 0), (_A, 2, 0, 1, 1), (_A, 15, 0, 0, 1), (_A, 200, 30, 0, 1), (_N, 25, 0, 0, 0), (_S, 40, 2, 0, 0), (_P, 3, 0, 0, 0)],
    [(_S, 28, 0, 0, 0), (_S, 5, 0, 1, 0), (_P, 33, 0, 0, 0), (_P, 4, 0, 1, 0)],
    [(_N, 3, 3, 0, 0), (_N, 2, 2, 0, 0), (_N, 8, 0, 1, 1), (_N, 26, 0, 0, 1), (_N, 90, 8, 0, 1), (_N, 12, 0, 0, 1), (_N, 19, 0, 0, 1), (_N, 5, 5, 0, 0), (_N, 6, 3, 0, 0), (_N, 8, 1, 0, 0)],
    [(_N, 9, 9, 0, 0), (_N, 20, 0, 0, 1), (_N, 22, 0, 0, 1), (_N, 1, 0, 0, 1), (_N, 29, 0, 0, 1), (_N, 35, 6, 0, 1), (_N, 7, 6, 0, 0), (_N, 5, 0, 0, 0)],
    [(_N, 2, 2, 0, 0), (_N, 3, 0, 1, 0), (_N, 4, 4, 0, 0), (_N, 5, 0, 0, 0), (_N, 6, 6, 0, 0), (_N, 10, 9, 0, 0), (_N, 4, 0, 0, 0)],
    [(_N, 30, 0, 0, 1), (_N, 2, 0, 0, 1), (_N, 1, 0, 0, 1), (_N, 25, 2, 0, 1), (_N, 38, 0, 0, 1)],
    [(_P, 24, 0, 0, 0), (_N, 5, 0, 1, 1), (_N, 34, 0, 0, 1), (_N, 2, 0, 0, 1), (_N, 27, 0, 0, 1), (_P, 40, 0, 0, 0), (_S, 31, 0, 0, 0)],
    # articles of one and of few words
    [(_P, 2, 2, 0, 0), (_A, 1, 0, 1, 1), (_S, 8, 0, 0, 0)],
    [(_A, 2, 2, 0, 1), (_P, 15, 0, 0, 0)],
]


def labelled_tree(pages: list[list[tuple[int, int, int, int, int]]] = LABELLED) -> Tree:
    """The tree fitted on labelled pages."""
    t = np.array([row for page in pages for row in page], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum([len(p) for p in pages])])
    x = features(t[:, 1], t[:, 2], t[:, 3] > 0, t[:, 0], t[:, 0] == STICKY, first)
    return fit_tree(x, t[:, 4])


def main_texts(pages: list[str | None], tree: Tree) -> list[str]:
    """The main text of each page: its main blocks, one a line."""
    found = [blocks_of(p) if p else [] for p in pages]
    flat = [b for page in found for b in page]
    first = np.concatenate([[0], np.cumsum([len(p) for p in found])]).astype(np.int64)
    columns = [np.array([getattr(b, name) for b in flat]) for name in ("words", "linked", "heading", "says", "sticky")]
    if not flat:
        return [""] * len(pages)
    keep = tree.predict(features(*columns, first)) > 0
    return ["\n".join(flat[i].text for i in range(first[k], first[k + 1]) if keep[i]) for k in range(len(pages))]


def extract_text(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """``pages`` (needs ``html``) without it, with ``text`` and ``n_chars`` (its code points)."""
    tree = tree or labelled_tree()
    rest = [c for c in pages.columns if c.lower() not in ("html", *RESULT)]
    packed = pages.select(F.struct(*quoted(rest)).alias("rest"), "html")  # mapInArrow takes no column names with dots
    schema = StructType([packed.schema["rest"], StructField("text", StringType()), StructField("n_chars", LongType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = main_texts(part.column("html").to_pylist(), tree)
                yield pa.RecordBatch.from_arrays(
                    [part.column("rest"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["rest", *RESULT])

    return packed.mapInArrow(kernel, schema).select("rest.*", *RESULT)
