"""Main text of web pages: flat blocks, judged by a decision tree on their own and their neighbours' shape.

A page is cut into blocks of text at the tags that start a new line in a browser. Each block is described
by its word count and link density, by those of the blocks before and after, by those of the boxes that it
stands in, and by signs of the elements around it: tags, roles, parts of names. A sign is weighed by how much of the
page's text its element holds, so that a wrapper of nearly everything says little, whatever it is called. A decision
tree, trained here on the labelled pages of ``labelled_pages``, says which blocks belong to the article.

Cutting takes time in proportion to the page, however broken it is: nothing is looked for twice from one place on.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled_pages import PAGES

#: Elements that do not interrupt a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without content or end tag.
VOID = frozenset("area base basefont br col embed frame hr img input keygen link meta param source track wbr".split())
#: Elements whose content is no text of the page; it ends at the end tag of the same name only.
RAW = frozenset("script style textarea title template iframe noembed noframes xmp svg math canvas select".split())
#: Those of them that take all the rest of the page if they are not ended.
ENDLESS = frozenset("script style textarea title".split())
_CELLS = ["td", "th", "tr", "tbody", "thead", "tfoot"]
#: An end tag is implied by these: the open element ends where one of the others starts.
IMPLIED = {
    "p": frozenset("address article aside blockquote center div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dt dd".split() + _CELLS),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]), "td": frozenset(_CELLS), "th": frozenset(_CELLS), "tbody": frozenset(_CELLS[3:]), "thead": frozenset(_CELLS[3:]),
}
#: Elements that such an end does not reach through.
FENCES = frozenset("table ul ol dl div article section aside body blockquote".split())
#: Elements that hold text without being a part of the page of their own.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre figure figcaption tr tbody thead tfoot table caption html".split())

CONTENT_TAGS = frozenset(["article", "main"])
SIDE_TAGS = frozenset("nav aside header footer form menu dialog button fieldset address".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar form dialog alert alertdialog".split())
#: Parts of class and id names, split at anything but letters.
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside rail widget widgets header masthead topbar footer foot "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login form search share sharing social related recommended trending popular pagination pager toolbar copyright legal disclaimer".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies discussion responses".split())
CONTENT_WORDS = frozenset("article content main post entry story body text prose".split())
SIGNS = ["content", "side", "comment", "side_name", "content_name", "hidden"]

NAME = re.compile(r"[A-Za-z][^\s/>]*")
#: A step inside a tag: blanks and strokes, a name, and how a value starts, if one follows.
STEP = re.compile(r"""[\s/]*(?:([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*(["']|[^\s>"'][^\s>]*)?)?)?""")
LETTERS = re.compile("[a-z]+")
LONG_NUMBER = re.compile("&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")


def decoded(text: str) -> str:
    """Character references decoded; numbers beyond all characters as browsers do."""
    if "&" not in text:
        return text

    def short(m: re.Match) -> str:
        is_hex = m[0][2] in "xX"
        digits = m[0][3 if is_hex else 2 :].rstrip(";").lstrip("0")
        return "\ufffd" if len(digits) > 7 else f"&#{'x' if is_hex else ''}{digits or '0'};"

    return html.unescape(LONG_NUMBER.sub(short, text))


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    links: int
    tag: str
    #: For each of SIGNS the number of the innermost element that bears it, or -1.
    signs: tuple[int, ...]
    #: Numbers of the innermost two elements that are parts of the page.
    boxes: tuple[int, int]
    label: int = -1


@dataclass
class Page:
    blocks: list[Block]
    #: For each element the first of its blocks, and the one after its last.
    spans: list[list[int]]


def _signs(name: str, attributes: dict[str, str]) -> set[str]:
    """What an element says of its content."""
    out = set()
    if name in CONTENT_TAGS:
        out.add("content")
    if name in SIDE_TAGS:
        out.add("side")
    for key, value in attributes.items():
        value = value.lower()
        if key in ("class", "id"):
            parts = set(LETTERS.findall(value))
            out.update(n for n, w in (("side_name", SIDE_WORDS), ("comment", COMMENT_WORDS), ("content_name", CONTENT_WORDS)) if parts & w)
        elif key == "role" and value in SIDE_ROLES:
            out.add("side")
        elif key == "role" and value in ("main", "article"):
            out.add("content")
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            out.add("hidden")
    return out


class _Scanner:
    """Finds strings in a page; what was not found from one place on is not looked for from a later one."""

    def __init__(self, page: str):
        self.page = page
        self.missing: set[str] = set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def end_tag(self, name: str, at: int) -> int:
        """The place behind the end tag of ``name``, or -1."""
        if name in self.missing:
            return -1
        m = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(self.page, at)
        if m is None:
            self.missing.add(name)
            return -1
        return m.end()

    def attributes(self, at: int) -> tuple[dict[str, str], int, bool]:
        """(attributes, end, closed) of the tag whose name ends at ``at``; end is -1 if it has none. A quote that is
        never closed is none. closed: whether the tag ends itself."""
        page, out = self.page, {}
        while True:
            m = STEP.match(page, at)
            at = m.end()
            key, value = (m[1] or "").lower(), m[2] or ""
            if value and value in "\"'":
                stop = self.find(value, at)
                if stop >= 0:
                    value, at = page[at:stop], stop + 1
                else:
                    value = ""
            if key:
                out.setdefault(key, value)
            if at >= len(page):
                return out, -1, False
            if page[at] == ">":
                return out, at + 1, page[at - 1] == "/"
            if not m[0]:
                at += 1


def cut(page: str) -> Page:
    """The page's blocks of text in order, character references decoded, white space runs as one blank.

    Unclosed and misplaced tags are borne with as browsers do; text outside of any element is a block too.
    """
    out: list[Block] = []
    spans: list[list[int]] = [[0, 0]]
    scanner = _Scanner(page)
    # What is open: name, number, signs, boxes, label; and where in the stack each name, block element and stop stands.
    stack: list[tuple[str, int, tuple[int, ...], tuple[int, int], int]] = [("", 0, (-1,) * len(SIGNS), (0, 0), -1)]
    places: dict[str, list[int]] = defaultdict(list)
    outer: list[int] = [0]
    stops: list[int] = []
    dead: set[int] = set()  # inline elements that ended while a block inside them stays open
    run: list[str] = []
    linked: list[str] = []
    owner: list[tuple] = []  # the element in which the run's first word stands

    def flush() -> None:
        words = "".join(run).split()
        if words:
            _, _, signs, boxes, label = owner[0]
            out.append(Block(" ".join(words), len(words), min(len("".join(linked).split()), len(words)), linked.count("\n"), stack[outer[-1]][0], signs, boxes, label))
        run.clear()
        linked.clear()
        owner.clear()

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            name, number, *_ = stack.pop()
            spans[number][1] = len(out)
            d = len(stack)
            if d in dead:
                dead.remove(d)
            else:
                places[name].pop()
            if outer[-1] == d:
                outer.pop()
            if stops and stops[-1] == d:
                stops.pop()

    def add(text: str) -> None:
        run.append(text)
        if not owner and text and not text.isspace():
            owner.append(stack[-1])
        if places["a"]:
            linked.append(text.replace("\n", " ") if text != "\n" else " ")

    at, text_from = 0, 0
    while True:
        start = scanner.find("<", at)
        if start < 0 or start + 1 >= len(page):
            add(decoded(page[text_from:]))
            break
        ahead = page[start + 1]
        if ahead in "!?":
            if page.startswith("<!--", start):
                stop = scanner.find("-->", start + 2)
                end = stop + 3 if stop >= 0 else len(page)
            elif page.startswith("<![CDATA[", start) and (stop := scanner.find("]]>", start)) >= 0:
                add(decoded(page[text_from:start]) + page[start + 9 : stop])
                at = text_from = stop + 3
                continue
            else:
                stop = scanner.find(">", start)
                end = stop + 1 if stop >= 0 else len(page)
            add(decoded(page[text_from:start]))
            at = text_from = end
            continue
        is_end = ahead == "/"
        m = None if scanner.find(">", start) < 0 else NAME.match(page, start + 1 + is_end)
        if m is None or scanner.find(">", m.end()) < 0:
            at = start + 1
            continue
        attributes, end, closed = scanner.attributes(m.end())
        if end < 0:  # the tag runs to the end of the page
            end = scanner.find(">", m.end()) + 1
            attributes = {}
        add(decoded(page[text_from:start]))
        at = text_from = end
        name = m[0].lower()
        if is_end:
            where = places[name][-1] if places[name] else -1
            if name not in INLINE:
                flush()
                if where >= 0:
                    close_to(where)
            elif where >= 0 and outer[-1] < where:
                close_to(where)
            elif where >= 0:
                places[name].pop()
                dead.add(where)
            continue
        if name in RAW:
            behind = scanner.end_tag(name, at)
            if behind >= 0 or name in ENDLESS:
                at = text_from = behind if behind >= 0 else len(page)
            flush()
            continue
        if name not in INLINE:
            flush()
        while stops and name in IMPLIED.get(stack[stops[-1]][0], ()):
            close_to(stops[-1])
        if name in VOID or closed and name in INLINE:
            continue
        _, _, signs, boxes, label = stack[-1]
        number = len(spans)
        spans.append([len(out), len(page)])
        if name not in ("html", "body"):  # their classes tell of the page, not of its text
            own = _signs(name, attributes)
            # A wrapper named after a side part may hold the article too.
            signs = tuple(number if s in own else -1 if s == "side_name" and name in CONTENT_TAGS else n for s, n in zip(SIGNS, signs, strict=True)) if own or name in CONTENT_TAGS else signs
        if name not in INLINE and name not in LEAVES:
            boxes = (number, boxes[0])
        d = len(stack)
        stack.append((name, number, signs, boxes, LABELS.get(attributes.get("data-label"), label)))
        places[name].append(d)
        if name == "a":
            linked.append("\n")  # one for each link
        if name not in INLINE:
            outer.append(d)
        if name in IMPLIED or name in FENCES:
            stops.append(d)
    flush()
    close_to(1)
    spans[0][1] = len(out)
    return Page(out, [[a, min(b, len(out))] for a, b in spans])


#: Marks of labelled pages; any other value of the attribute says nothing.
LABELS = {"0": 0, "1": 1}
FEATURES = ["words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "box_share", "box_density", "outer_share", *SIGNS, "heading", "outside", "links"]
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def features(page: Page) -> np.ndarray:
    """FEATURES of each block of a page, by column.

    Shares are parts of the page's words outside of links. A sign for an article has the share of its element,
    any other what its element leaves out; 0 stands for no sign.
    """
    n = len(page.blocks)
    out = np.zeros((n, len(FEATURES)))
    if not n:
        return out
    words = np.array([b.words for b in page.blocks], float)
    links = np.array([b.link_words for b in page.blocks], float)
    density = links / words
    out[:, 0], out[:, 1] = words, density
    out[1:, 2], out[1:, 3] = words[:-1], density[:-1]
    out[:-1, 4], out[:-1, 5] = words[1:], density[1:]
    spans = np.array(page.spans)
    every, linked = np.concatenate([[0], np.cumsum(words)]), np.concatenate([[0], np.cumsum(links)])
    held = every[spans[:, 1]] - every[spans[:, 0]]
    of_links = linked[spans[:, 1]] - linked[spans[:, 0]]
    share = (held - of_links) / max(every[-1] - linked[-1], 1)
    boxes = np.array([b.boxes for b in page.blocks])
    out[:, 6] = share[boxes[:, 0]]
    out[:, 7] = of_links[boxes[:, 0]] / np.maximum(held[boxes[:, 0]], 1)
    out[:, 8] = share[boxes[:, 1]]
    signs = np.array([b.signs for b in page.blocks])
    for j, sign in enumerate(SIGNS):
        own = share[signs[:, j]]
        out[:, 9 + j] = np.where(signs[:, j] < 0, 0, np.maximum(own if "content" in sign else 1 - own, 0.001))
    out[:, 15] = [b.tag in HEADINGS for b in page.blocks]
    # Outside of what the page itself marks as its article: the share of that.
    articles = np.where((signs[:, 0] >= 0) & (signs[:, 2] < 0) & (signs[:, 5] < 0), out[:, 9], 0)
    out[:, 16] = np.where(articles > 0, 0, articles.max())
    out[:, 17] = [b.links for b in page.blocks]
    return out


@dataclass(frozen=True)
class Leaf:
    share: float


@dataclass(frozen=True)
class Split:
    feature: int
    cut: float
    below: Leaf | Split
    above: Leaf | Split


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 6) -> Leaf | Split:
    """A binary tree by Gini impurity; of equal splits the first feature and the lowest cut win."""
    share = float(y.mean()) if len(y) else 0.0
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return Leaf(share)
    best, where = 2 * share * (1 - share) * len(y) - 1e-9, None
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, s = x[order, j], np.cumsum(y[order])
        i = np.flatnonzero(v[1:] > v[:-1]) + 1
        i = i[(i >= least) & (i <= len(y) - least)]
        if len(i):
            a = s[i - 1]
            b = s[-1] - a
            cost = 2 * a * (1 - a / i) + 2 * b * (1 - b / (len(y) - i))
            k = int(np.argmin(cost))
            if cost[k] < best - 1e-9:
                best, where = float(cost[k]), (j, float(v[i[k] - 1] + v[i[k]]) / 2)
    if where is None:
        return Leaf(share)
    below = x[:, where[0]] < where[1]
    return Split(*where, grow(x[below], y[below], depth - 1, least), grow(x[~below], y[~below], depth - 1, least))


def keeps(tree: Leaf | Split, x: np.ndarray) -> np.ndarray:
    """For each row whether its leaf holds article blocks for the greater part."""
    if isinstance(tree, Leaf):
        return np.full(len(x), tree.share > 0.5)
    below = x[:, tree.feature] < tree.cut
    out = np.zeros(len(x), bool)
    out[below] = keeps(tree.below, x[below])
    out[~below] = keeps(tree.above, x[~below])
    return out


def training_table() -> tuple[np.ndarray, np.ndarray]:
    pages = [cut(p) for p in PAGES]
    x, y = np.concatenate([features(p) for p in pages]), np.array([b.label for p in pages for b in p.blocks], float)
    return x[y >= 0], y[y >= 0]


@lru_cache(1)
def trained_tree() -> Leaf | Split:
    return grow(*training_table())


def main_text(page: str | None, tree: Leaf | Split | None = None) -> str:
    found = cut(page or "")
    kept = keeps(tree or trained_tree(), features(found))
    return " ".join(b.text for b, k in zip(found.blocks, kept.tolist(), strict=True) if k)


def extracted(page: Column) -> Column:
    """The main text of each whole page; the tree is trained once on the driver and sent along."""
    tree = trained_tree()

    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p, tree) for p in pages], dtype=object)

    return F.pandas_udf(extract, "string")(page)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with the column ``main_text``: the article of each page, never null.

    Null and empty pages give the empty text, as do pages without article blocks. Pages are judged row by
    row: repeated rows give equal texts, very long pages cost in proportion to their length. A column of pages
    named main_text is replaced.
    """
    return pages.withColumn("main_text", extracted(F.col(html_col)))
