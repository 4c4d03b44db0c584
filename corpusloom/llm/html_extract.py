"""Main text of web pages by tag-path ratios.

A page is read as a stream of tags with HTML's implied ends. Text gathers in blocks; each has the tag path of its open block
elements (tag, id and class, digits left out). Over each path the lengths, punctuation marks and linked lengths of its
blocks (with what parts two links) are summed and divided by the number of blocks. The length and punctuation ratios are smoothed along the page and
fused by a geometric mean, times the share of text outside links, times a prior of the path's names: low for elements
and names that mark menus, headers, footers, sidebars, notices, adverts, forms and comments, double inside ``article`` and ``main``.
A name counts if it consists of such words; inside an article words like notice, share or search mark nothing, and the ratios decide.

Two thresholds select content nodes. Paths whose score exceeds a share of the deviation are strong; the deepest element
that holds ``share`` of the strong weight is the content node. Inside it paths above a tenth of the threshold stay, so short
paragraphs and headings do, while low paths (comments, adverts, lists of links) go; outside it only paths of at least half the
mean score of its strong text stay, and headings just above what stays. Where that node is the whole page, or holds several articles, it is narrowed to its
children with strong text and to headings beside them.

The work is linear in the page: an element holds its parent's number, a path is interned, and sums run from children to parents.

Null or empty html, or a page without text: empty text. Unclosed tags, unclosed comments and a cut-off end are read as far as they go.
Very long pages are read whole, however deep. Elements of equal weight: the deepest, then the first. Repeated rows each get a
row; null page_id and url stay null; an empty table gives an empty one. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, rows

#: Share of the strong weight that the content node holds; share of the deviation that a strong path exceeds; share of that for the others;
#: share of the content node's mean score for paths outside it.
SHARE, DEVIATION, WEAK, OUTSIDE = 0.8, 0.3, 0.1, 0.5
#: Priors of a path with a set-apart element, and of one inside an article.
APART, INSIDE = 0.001, 2.0
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""\b(id|class|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose text is not shown as text, and elements of the page around an article.
_UNSEEN = frozenset("head script style noscript template iframe svg canvas object embed audio video map title button select textarea option".split())
_APART = frozenset("nav footer aside form menu dialog search fieldset".split())
#: Words of an id, class or role that mark such parts wherever they stand; words that mark them outside an article, and that inside one may
#: as well name what its text is about; words that say nothing beside them.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements adslot adsense sponsor sponsors sponsored promo promos promotion promotions cookie cookies consent gdpr popup popups modal overlay newsletter subscribe subscription signup login"
    " nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars comment comments commentlist disqus replies respond footer footers masthead toolbar contentinfo complementary".split()
)
_OUTER_MARKS = frozenset("aside banner banners notice notices alert alerts modals overlays widget widgets related recommended recommendations share sharing social foot skip copyright hidden search".split())
_PLAIN = frozenset("area bar block body bottom box buttons container content form global icons inner items left links list main news page post posts primary right secondary section site slot sticky stories top unit wrap wrapper".split())


def _marked(names: list[str], inside: bool) -> bool:
    """Whether one of the names consists of marks, and of words that say nothing, alone: ``related-posts`` does, ``related-work`` does not."""
    marks = _MARKS if inside else _MARKS | _OUTER_MARKS
    for name in " ".join(names).split():
        words = [w for w in re.split(r"[_-]+", name) if w and w not in _PLAIN]
        if words and marks.issuperset(words):
            return True
    return False


_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？¿¡\"“”«»()]")


def _closed_by(tag: str) -> frozenset:
    """Open elements that the start of ``tag`` ends."""
    if tag == "li":
        return frozenset({"li", "p"})
    if tag in ("dd", "dt"):
        return frozenset({"dd", "dt", "p"})
    if tag in ("td", "th"):
        return frozenset({"td", "th", "p"})
    if tag == "tr":
        return frozenset({"tr", "td", "th", "p"})
    if tag == "option":
        return frozenset({"option"})
    return frozenset({"p"}) if tag in _BLOCK else frozenset()


#: Open elements beyond which an implied end does not reach.
_FENCE = frozenset("html body div article section main table ul ol dl td th aside nav header footer form blockquote".split())


#: Elements that no content node is: its parent also holds the headings and the other paragraphs.
_LEAVES = frozenset({"p", "li", "ul", "ol", "blockquote", "pre", *_HEADING})
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Page:
    """Blocks in page order, and the elements that hold them.

    An element has a parent, a tag, a path (interned: names from the root) and flags that its children inherit; number 0 is the page.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.path, self.prior = [-1], [""], [0], [1.0]
        self.unseen, self.inside, self.header, self.heading = [False], [False], [False], [False]
        self.paths: dict[tuple[int, str], int] = {}
        self.text: list[str] = []
        self.linked: list[int] = []
        self.element: list[int] = []
        self._read(source)

    def _open(self, above: int, tag: str, attributes: str) -> int:
        names, hidden = [], False
        for key, value in _NAMES.findall(attributes) if attributes else ():
            key, value = key.lower(), value.strip("\"'")
            if key in ("id", "class", "role"):
                names.append(re.sub(r"\d+", "", value).lower())
            hidden = hidden or key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _HIDDEN.search(value) is not None)
        framed = tag in ("article", "main")
        apart = tag in _APART or (tag not in ("html", "body") and not framed and _marked(names, self.inside[above]))
        self.parent.append(above)
        self.tag.append(tag)
        block = tag in _BLOCK or apart
        self.path.append(self.paths.setdefault((self.path[above], ".".join([tag, *names])), len(self.paths) + 1) if block else self.path[above])
        self.unseen.append(self.unseen[above] or hidden or tag in _UNSEEN)
        self.inside.append(self.inside[above] or framed)
        self.header.append(self.header[above] or tag == "header")
        self.heading.append(self.heading[above] or tag in _HEADING)
        self.prior.append(self.prior[above] * (APART if apart else 1.0) * (INSIDE if framed and not self.inside[above] else 1.0))
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        stack, parts, linked = [0], [], 0
        # tags that are open, and tags that are open since each fence
        opened: Counter = Counter()
        scopes: list[Counter] = [Counter()]

        def flush():
            nonlocal linked
            text = " ".join("".join(parts).split())
            if text and not self.unseen[stack[-1]]:
                self.text.append(text)
                self.linked.append(min(linked, len(text)))
                self.element.append(stack[-1])
            parts.clear()
            linked = 0

        def close_through(tags) -> None:
            while True:
                tag = self.tag[stack.pop()]
                opened[tag] -= 1
                scopes[-1][tag] -= 1
                if tag in _FENCE:
                    scopes.pop()
                if tag in tags:
                    return

        at, end = 0, len(source)
        while at < end:
            m = _TOKEN.search(source, at)
            chunk = source[at : m.start()] if m else source[at:]
            if chunk:
                text = html.unescape(chunk)
                parts.append(text)
                if opened["a"] > 0:
                    linked += len(text.strip())
                elif linked and not any(map(str.isalnum, text)):  # what parts two links
                    linked += len(text.strip()) + 1
            if not m:
                break
            at = m.end()
            close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if tag == "br":
                parts.append(" ")
                continue
            if tag in _BLOCK:
                flush()
            if close:
                # the end of an inline element does not reach beyond a fence
                if (opened if tag in _BLOCK else scopes[-1])[tag] > 0:
                    close_through((tag,))
                continue
            ends = _closed_by(tag)
            if any(scopes[-1][t] > 0 for t in ends):
                close_through(ends)
            if tag in _RAW:
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = stop.end() if stop else end
                continue
            if tag in _VOID or attributes.rstrip().endswith("/") and tag not in _BLOCK:
                continue
            stack.append(self._open(stack[-1], tag, attributes))
            opened[tag] += 1
            if tag in _FENCE:
                scopes.append(Counter())
            scopes[-1][tag] += 1
        flush()

    def low(self, block: int) -> float:
        """The prior of a block's path; a header inside an article gives its headings only."""
        e = self.element[block]
        return self.prior[e] * (APART if self.header[e] and not (self.inside[e] and self.heading[e]) else 1.0)


def path_ratios(path: list[int], length: list[int], marks: list[int], linked: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each block its path's text ratio, punctuation ratio and share outside links."""
    _, at, count = np.unique(path, return_inverse=True, return_counts=True)
    total = [np.bincount(at, weights=x) for x in (length, marks, linked)]
    return total[0][at] / count[at], total[1][at] / count[at], 1 - total[2][at] / total[0][at]


def path_scores(page: Page) -> np.ndarray:
    """Fused, smoothed ratio of each block's path, times its prior."""
    path = [page.path[e] for e in page.element]
    text, mark, plain = path_ratios(path, [len(t) for t in page.text], [len(_PUNCTUATION.findall(t)) for t in page.text], page.linked)
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    smooth = lambda x: np.convolve(np.pad(x, 2, mode="edge"), kernel / kernel.sum(), mode="valid")
    return np.sqrt(smooth(text) * (smooth(mark) + 0.1)) * plain * [page.low(b) for b in range(len(path))]


def main_text(source: str | None) -> str:
    page = Page(source or "")
    n = len(page.text)
    if not n:
        return ""
    score = path_scores(page)
    least = min(DEVIATION * score.std(), score.max())
    if not score.max() >= APART * INSIDE:  # only text that is set apart
        return ""
    strong = (score >= least) & (score > 0)
    weight = np.where(strong, score * [len(t) for t in page.text], 0.0)
    inside = np.zeros(len(page.tag))
    np.add.at(inside, page.element, weight)
    for e in range(len(page.tag) - 1, 0, -1):  # children come after their parents
        inside[page.parent[e]] += inside[e]
    depth = [0] * len(page.tag)
    for e in range(1, len(page.tag)):
        depth[e] = depth[page.parent[e]] + 1
    root = max((e for e in range(len(page.tag)) if inside[e] >= SHARE * inside[0]), key=lambda e: (depth[e], -e))
    while root and (page.tag[root] in _LEAVES or page.tag[root] not in _BLOCK):
        root = page.parent[root]
    # what lies in the root, and which of its children holds it
    child = [0] * len(page.tag)
    for e in range(1, len(page.tag)):
        up = page.parent[e]
        child[e] = e if up == root else child[up]
    several = any(page.tag[e] in ("article", "main") and child[e] and inside[e] > 0 for e in range(len(page.tag)))
    narrow = (page.tag[root] in ("", "html", "body") or several) and not page.inside[root]

    held = np.array([e == root or child[e] > 0 for e in page.element])
    outer = OUTSIDE * np.average(score[held & strong], weights=weight[held & strong])

    def stays(b: int) -> bool:
        e = page.element[b]
        if not held[b]:
            return bool(score[b] >= max(least, outer))
        if score[b] < WEAK * least:
            return False
        return bool(not narrow or page.heading[e] or (inside[child[e]] > 0 if child[e] else strong[b]))

    kept = [stays(b) for b in range(n)]
    for b in range(n - 2, -1, -1):  # a heading just above what stays
        if kept[b + 1] and not kept[b] and page.heading[page.element[b]]:
            kept[b] = bool(score[b] >= WEAK * least)
    return "\n".join(t for b, t in enumerate(page.text) if kept[b])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each page."""

    def make(batches):
        for page_id, url, source in rows(batches, "page_id", "url", "html"):
            text = main_text(source)
            yield page_id, url, text, len(text)

    return map_rows(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), make, "page_id long, url string, text string, n_chars long", 512)


def query(pages: DataFrame) -> DataFrame:
    return extract(pages)
