"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from math import sqrt
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import bounded_batches, pieces

#: Elements that begin and end a block of text; others are part of the text around them.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot"
    " th thead title tr ul".split()
)
#: Elements whose content is not text of the article, whatever its ratios.
LEFT_OUT = frozenset(
    "aside audio button canvas dialog footer form frameset head iframe menu nav noembed noframes noscript object script select style svg"
    " template textarea title video".split()
)
#: Elements whose content has no markup.
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that often name what an article page carries beside the article; a prior of a path's ratios.
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs byline captcha comment comments"
    " complementary consent contentinfo cookie cookies disclaimer disqus footer form gdpr header login masthead menu menubar modal nav navbar"
    " navigation newsletter notice notices notification outbrain overlay pager pagination popup privacy promo promoted promotion recommended"
    " related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toc"
    " toolbar topbar widget widgets".split()
)
#: Words that may stand before and after those in a name that means the same.
_BEFORE = frozenset("site page main top bottom left right global primary secondary user".split())
_AFTER = frozenset("area bar block body box container content count feed group holder inner item items left link links list panel right section slot thread unit wrap wrapper".split())
#: First and last words of a name that tells how a page is laid out, and not what the element is.
_LAYOUT_FIRST, _LAYOUT_LAST = frozenset("has have with without no not hide is".split()), frozenset("free none off hidden disabled open".split())
#: A path with such a name counts this much of its ratio.
PRIOR = 1 / 8
#: Elements that often hold the article, and in which a header belongs to it.
OF_ARTICLE = frozenset("article main".split())
#: A path within one counts so much more, and the article is the innermost element with this share of the page's ratios.
ARTICLE_PRIOR = 8
MOST_OF_PAGE = 0.9
#: A block straight within the article, or within a part of it that has text at the threshold, stays from this share of it on.
OF_THRESHOLD = 1 / 6
#: An element of the key is ended by the start of one of the value, unless one of the last lies between.
_ENDED_BY = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr tbody thead tfoot".split()), frozenset(["table"])),
    "td": (frozenset("td th tr tbody thead tfoot".split()), frozenset(["table"])),
    "th": (frozenset("td th tr tbody thead tfoot".split()), frozenset(["table"])),
    "option": (frozenset("option optgroup".split()), frozenset(["select"])),
}
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
_token = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)>?", re.S)
_attribute = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_heading = re.compile(r"h[1-6]$")
_name_words = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Elements that may hold a whole article.
_CONTAINERS = frozenset("article main html body div section center td blockquote".split())
#: Elements that hold blocks of several kinds; lists and tables do not.
_ENCLOSING = frozenset("address article body center details div fieldset hgroup html legend main section".split())
#: Elements of lists, tables and captions, which stay with the text around them.
_PARTS = frozenset("li dt dd td th caption figcaption pre blockquote summary".split())


def _named_beside(attributes: str) -> bool:
    """If a class, id or role is named by words of BESIDE, with nothing but words that don't change the meaning."""
    for value in " ".join(a or b or c for _, a, b, c in _attribute.findall(attributes)).split():
        named = [word.lower() for word in _name_words.findall(value)]
        at = [i for i, word in enumerate(named) if word in BESIDE]
        if at and _BEFORE.issuperset(named[: at[0]]) and all(word in BESIDE or word in _AFTER for word in named[at[0] :]):
            if named[0] not in _LAYOUT_FIRST and named[-1] not in _LAYOUT_LAST:
                return True
    return False


class Block(NamedTuple):
    """A block of text: its tag path, its innermost element, and how many of its characters are in links."""

    path: int
    element: int
    text: str
    linked: int


class Page:
    """The blocks of a page outside what is left out, in page order, with their tag paths and elements.

    Paths are nodes of a trie (block elements from the root down, with their classes) and elements a tree, both by
    number in the order of their first tags, so a parent comes before its children; number 0 is the page itself.
    Tags may be unclosed: a paragraph ends where a block begins, an item where the next begins, and an end tag
    ends what is open within.
    """

    def __init__(self, markup: str) -> None:
        self.blocks: list[Block] = []
        self.above, self.named, self.of_article = [-1], [False], [False]  # of each path: its parent, and if its last element is named as beside, or the first of OF_ARTICLE
        self.parent, self.tag, self.path_of, self.last = [-1], [""], [0], [0]  # of each element; last is its last descendant
        self._paths: dict[tuple[int, str], int] = {}
        self._open, self._of_tag, self._hidden, self._articles = [0], defaultdict(int), [], 0
        self._parts: list[str] = []
        self._linked = 0
        self._read(markup)
        self._flush()
        self._end(1)
        self.last[0] = len(self.parent) - 1

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                element = next(e for e in reversed(self._open) if e == 0 or self.tag[e] in BLOCKS)
                self.blocks.append(Block(self.path_of[element], element, text, self._linked))
            self._parts.clear()
        self._linked = 0

    def _begin(self, tag: str, attributes: str, left_out: bool) -> None:
        values = {name.lower(): a or b or c for name, a, b, c in _attribute.findall(attributes)} if attributes else {}
        beside = bool(values) and tag not in ("html", "body", *OF_ARTICLE) and _named_beside(attributes)
        step = (self.path_of[self._open[-1]], f"{tag}.{values.get('class', '')}{'#' * beside}")
        path = self._paths.get(step)
        if path is None:
            path = self._paths[step] = len(self.above)
            self.above.append(step[0])
            self.named.append(beside)
            self.of_article.append(tag in OF_ARTICLE and not self._articles)
        element = len(self.parent)
        self.parent.append(self._open[-1])
        self.tag.append(tag)
        self.path_of.append(path)
        self.last.append(element)
        self._open.append(element)
        self._of_tag[tag] += 1
        self._articles += tag in OF_ARTICLE
        if left_out:
            self._hidden.append(element)

    def _end(self, depth: int) -> None:
        """End the open elements from this depth on."""
        if any(self.tag[element] in BLOCKS for element in self._open[depth:]):
            self._flush()
        newest = len(self.parent) - 1
        for element in self._open[depth:]:
            self.last[element] = newest
            self._of_tag[self.tag[element]] -= 1
            self._articles -= self.tag[element] in OF_ARTICLE
        while self._hidden and depth < len(self._open) and self._hidden[-1] >= self._open[depth]:
            self._hidden.pop()
        del self._open[depth:]

    def _close(self, tag: str, barrier: frozenset[str] = frozenset()) -> None:
        if self._of_tag[tag]:
            for depth in range(len(self._open) - 1, 0, -1):
                found = self.tag[self._open[depth]]
                if found == tag:
                    return self._end(depth)
                if found in barrier:
                    return None
        return None

    def _read(self, markup: str) -> None:
        at, size, in_link = 0, len(markup), False
        while at < size:
            match = _token.search(markup, at)
            stop = match.start() if match else size
            if stop > at and not self._hidden:
                text = html.unescape(markup[at:stop])
                self._parts.append(text)
                self._linked += len(text) * in_link
            if not match:
                break
            at = match.end()
            tag = (match[2] or "").lower()
            if match[1]:
                if tag in BLOCKS or tag in LEFT_OUT:
                    self._close(tag)
                in_link = in_link and tag != "a"
            elif tag:
                in_link = in_link or tag == "a"
                self._start(tag, match[3])
            if tag == "br":
                self._parts.append(" ")
            if tag in RAW and not match[1] and not match[3].endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(markup, at)
                if tag in LEFT_OUT:
                    self._close(tag)
                at = end.end() if end else size

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._flush()
            self._close("p", frozenset(["table", "td", "th", "button"]))
            for inner, (starts, barrier) in _ENDED_BY.items():
                if tag in starts:
                    self._close(inner, barrier)
            if tag != "hr":
                self._begin(tag, attributes, tag in LEFT_OUT or (tag == "header" and not self._articles))
        elif tag in LEFT_OUT and tag not in VOID:
            self._begin(tag, "", True)

    def within(self, element: int, outer: int) -> bool:
        return outer <= element <= self.last[outer]


def _smoothed(page: Page, sums: list[float], counts: list[int]) -> list[float]:
    """A ratio of each path, smoothed along the trie: its own mean, then those of all below it and below each of its
    ancestors, each with half the weight of the one before. Linear in the number of paths."""
    below, n = list(sums), list(counts)
    for path in range(len(sums) - 1, 0, -1):
        below[page.above[path]] += below[path]
        n[page.above[path]] += n[path]
    found, around, weight = [0.0] * len(sums), [0.0] * len(sums), [0.0] * len(sums)
    for path in range(len(sums)):
        mean = below[path] / max(1, n[path])
        above = page.above[path]
        around[path] = mean + (around[above] / 2 if path else 0.0)
        weight[path] = 1 + (weight[above] / 2 if path else 0.0)
        found[path] = (sums[path] / max(1, counts[path]) + around[path] / 2) / (1 + weight[path] / 2)
    return found


def ratios(page: Page) -> tuple[list[float], float]:
    """The fused ratio of each path, and the threshold of the page.

    A path's text ratio is its characters outside links for each block, its punctuation ratio the marks for each
    block. Both are smoothed over the tree of paths and fused as text x (1 + punctuation), times PRIOR for each
    element on the path that is named as beside the article, and ARTICLE_PRIOR within one of OF_ARTICLE. The threshold is
    the standard deviation of the fused ratios of all paths with text, at most their mean.
    """
    n = len(page.above)
    length, marks, count = [0.0] * n, [0.0] * n, [0] * n
    for block in page.blocks:
        length[block.path] += max(0, len(block.text) - block.linked)
        marks[block.path] += len(_PUNCTUATION.findall(block.text))
        count[block.path] += 1
    prior = [1.0] * n
    for path in range(1, n):
        prior[path] = prior[page.above[path]] * (PRIOR if page.named[path] else 1.0) * (ARTICLE_PRIOR if page.of_article[path] else 1)
    fused = [text * (1 + mark) * p for text, mark, p in zip(_smoothed(page, length, count), _smoothed(page, marks, count), prior)]
    present = [v for v, c in zip(fused, count) if c]
    mean = sum(present) / max(1, len(present))
    return fused, min(sqrt(sum((v - mean) ** 2 for v in present) / max(1, len(present))), mean)


def content_root(page: Page, fused: list[float]) -> int:
    """The element of the article: by the fused ratios of its blocks, which elements add up from the inside out.

    It is the innermost element that has MOST_OF_PAGE of all, or the outermost ``article``, or else ``main``, around that one; the
    page itself if there is none.
    """
    mass = [0.0] * len(page.parent)
    for block in page.blocks:
        mass[block.element] += fused[block.path]
    for element in range(len(mass) - 1, 0, -1):
        mass[page.parent[element]] += mass[element]
    root = 0
    for element in range(1, len(mass)):
        if page.tag[element] in _CONTAINERS and page.within(element, root) and mass[element] >= MOST_OF_PAGE * mass[0] > 0:
            root = element
    for tag in ("article", "main"):
        around = [element for element in range(1, root + 1) if page.tag[element] == tag and page.within(root, element)]
        if around:
            return around[0]
    return root


def main_text(markup: str | None) -> str:
    """The article of a whole page: the kept blocks in page order, joined by line feeds.

    Kept is what lies in the content root and on a path whose ratio reaches the threshold. Of the other paths the short blocks of the
    article stay: those straight within the root or within an element of it that has a kept path, if they reach
    OF_THRESHOLD of the threshold; and lists, tables and captions there, but not if most of a path are links. An element
    all of whose paths are below the threshold goes with what it holds. If the page itself or its body is the root, only kept
    paths and lists, tables and captions stay. A heading stays if the text that it stands above, beside it or one
    element further out, is kept. Empty for null, an empty page, or one with nothing but what is left out. Linear in the
    length of the page and its number of paths.
    """
    page = Page(markup or "")
    fused, threshold = ratios(page)
    root = content_root(page, fused)
    is_page = page.tag[root] in ("", "html", "body")
    n = len(page.above)
    length, linked = [0] * n, [0] * n
    most = [0.0] * len(page.tag)  # of each element: the greatest ratio of a block in it
    for block in page.blocks:
        length[block.path] += len(block.text)
        linked[block.path] += block.linked
        most[block.element] = max(most[block.element], fused[block.path])
    for element in range(len(most) - 1, 0, -1):
        most[page.parent[element]] = max(most[page.parent[element]], most[element])
    low, part = [False] * len(page.tag), [False] * len(page.tag)
    for element in range(1, len(page.tag)):  # what lies between the root and an element
        inner, above = element != root and page.within(element, root), page.parent[element]
        low[element] = inner and (low[above] or (page.tag[element] in _ENCLOSING and most[element] < threshold))
        part[element] = page.tag[element] in _PARTS or part[above]

    def stays(block: Block) -> bool:
        path, element = block.path, block.element
        if not page.within(element, root):
            return False
        if fused[path] >= threshold:
            return True
        around = element if block.element == root or part[element] else page.parent[element]
        if (low[around] and around != root) or 2 * linked[path] > length[path]:
            return False
        return part[element] or (not is_page and fused[path] >= OF_THRESHOLD * threshold)

    kept, following, taken_before = [], 0, False  # the element of the last block behind that is no heading, and if it stays
    for block in reversed(page.blocks):
        taken = stays(block)
        if _heading.match(page.tag[block.element]):
            outer = page.parent[page.parent[block.element]] if page.parent[block.element] > 0 else 0
            taken = taken_before and page.within(following, outer) or (taken and fused[block.path] >= threshold)
        else:
            following, taken_before = block.element, taken
        if taken:
            kept.append(block.text)
    return "\n".join(reversed(kept))


def extract(pages: DataFrame, markup: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """Add ``text`` (empty if there is none) and its length in code points, ``n_chars`` (long).

    Pages are independent, so nothing is shuffled. Other columns and repeated rows stay; existing columns of
    the two names are replaced.
    """

    @F.arrow_udf("string")
    def article(column: pa.Array) -> pa.Array:
        return pa.array([main_text(page) for part in pieces(column) for page in part], pa.string())

    return bounded_batches(pages).withColumn(text, article(F.col(markup))).withColumn(n_chars, F.length(text).cast("long"))
