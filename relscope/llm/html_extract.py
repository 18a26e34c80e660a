"""Main text of web pages: flat text blocks classified by a decision tree (operator 1).

A page becomes a flat list of text blocks, each with its word count and link density, those of the blocks before and
after it, and where it stands: inside an article, outside of the page's article, in a heading, and whether an element
around it names itself a menu, advert, form, comment or the like. Such names are a hint, not a verdict: what wraps the
page's own title, menus or article is a wrapper whatever its name. A CART tree, grown in numpy on the small labelled table
below, says which blocks are main text.
"""

from __future__ import annotations

import html as charrefs
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relscope.llm.common import read

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

# Element names of HTML by their role.
RAW = set("script style textarea title xmp iframe noembed noframes".split())
SILENT = RAW | set("head template noscript object select svg canvas audio video datalist".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"body", "html", "head", "option", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend"}
# Elements, roles and words of class names and ids that hint at something else than main text.
ASIDE = set("nav footer aside menu dialog button label fieldset search dir".split())
MAIN = {"article", "main"}
LANDMARKS = set("main h1 nav header footer".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
ASIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar note status".split())
HINT_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login signin register paywall sidebar sidebars widget widgets related recommended recommendations share sharing social comment comments commentlist reply replies respond disqus nav navbar navigation menu menus breadcrumb breadcrumbs footer foot masthead topbar toolbar pagination pager tagcloud search skip copyright disclaimer legal".split()
)
# Words that a name can have beside a hint; any other word ("has-sidebar", "social-science") takes the hint away.
PLAIN_WORDS = set("a box list block wrap wrapper container section area bar top bottom left right inner outer item items site page global primary secondary fixed sticky js is link links button buttons icon icons form title text body header main content post posts article articles reader user news google slot unit row col column panel group the our".split())
NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")

FEATURES = ("words", "links", "prev_words", "prev_links", "next_words", "next_links", "main", "outside", "heading", "hint")
#: A leaf holds this many labelled blocks at least.
LEAST_LEAF = 2
#: The labelled table. A line is a page, a block is words/link density/flags/label with the flags m (inside an article or
#: main element), h (heading) and b (a hint); label 1 is main text. Neighbours follow from the order, and a block without m
#: is outside if its page has one with m.
TABLE = """
1/1/b/0 1/1/b/0 2/1/b/0 1/1/b/0 14/0/b/0 9/0/mh/1 120/0/m/1 45/.05/m/1 80/0/m/1 6/0/b/0
2/1/b/0 1/1/b/0 2/1/b/0 7/0/mh/1 3/0/m/1 60/0/m/1 2/0/m/1 35/.1/m/1 8/.2/b/0 60/0/b/0
3/0//0 2/1//0 5/0/mh/1 70/0/m/1 1/0/m/1 66/0/m/1 9/1/m/1 44/0/m/1 30/0//0 4/1//0
6/0/mh/1 90/.02/m/1 7/0/mh/1 55/0/m/1 4/1/m/1 6/1/m/1 5/1/m/1 8/1/m/1 50/0/m/1 12/0//0
8/0/mh/1 40/0/m/1 30/0/mb/0 65/0/m/1 1/1/m/0 1/1/m/0 1/1/m/0 2/1/m/0 9/0//0
5/0/mh/1 100/0/m/1 80/.1/m/1 1/1/m/0 2/1/m/0 1/1/m/0 40/0/mb/0 25/0/mb/0 110/0/mb/0
4/0/mh/1 25/0/m/1 15/.4/m/1 30/0/m/1 12/.9/m/1 22/0/m/1 3/0/mbh/0 5/0/mb/0 90/.02/mb/0 3/1/mb/0
2/0/m/1 4/0/m/1 3/0/m/1 2/0/m/1 5/0/m/1
3/1/m/1 60/0/m/1 6/.5/m/1 61/0/m/1 2/0/mb/0 2/0/b/0
12/0/m/1
4/0/m/1 7/1/m/1 4/0/m/1
75/0//0 6/0/mh/1 200/.02/m/1 9/.3/m/1 80/0/m/1 150/0//0 14/.8//0 7/0/h/0
1/1//0 1/1//0 2/1//0 1/1//0 7/0/h/1 110/0//1 70/0//1 50/.04//1 6/0/h/1 44/0//1 4/.5/b/0 3/1//0 2/1//0
2/1//0 2/1//0 3/1//0 9/0/h/1 25/0//1 30/0//1 28/.1//1 16/0//1 60/0//1 35/0//1 5/1//0 6/1//0 4/1//0
1/1/b/0 2/1/b/0 5/0/h/1 18/0//1 12/.2//1 40/0//1 3/0//1 50/0//1 22/0/b/0 75/0/b/0
2/0//0 3/1//0 2/1//0 4/1//0 12/0//1 90/0//1 5/0//1 64/0//1 3/0/h/1 80/0//1 2/0//0 2/1//0 3/1//0
5/0/h/1 60/.05//1 2/0//1 44/0//1 39/0//1 7/.1//1 24/0//1 33/0//1 8/0//1 4/0//0 3/1//0 4/1//0
6/0/b/0 3/1//0 70/0//1 8/1//0 55/0//1 48/0//1 20/.7//0 12/.9//0 8/1//0
1/1//0 1/1//0 1/0/h/0 2/1//0 2/1//0 3/0/h/0 3/1//0 2/1//0 9/0/h/1 40/.05//1 52/0//1
14/0//1
14/0/h/1 35/0//1
4/0/h/1 26/0//1 11/0//1 9/0//1 10/0//1 13/.1//1 31/0//1 30/.9//0 9/.8//0 10/.6//0 5/1//0
3/0//0 4/1//0 6/1//0 5/0/h/0 4/1//0 2/1//0 5/1//0
60/0//1 85/0//1 72/0/b/0 15/0/b/0 95/0/b/0 5/.5/b/0
3/0//0 2/0//0 5/0//0 8/0/h/1 120/0//1 4/0//1 60/0//1 3/0//0 4/0//0 2/0//0
2/0//0 6/0//0 3/0//0 55/0//1 5/0//1 62/0//1 4/0//1 70/0//1 4/0//0 5/0//0 3/0//0
9/0/h/1 40/0//1 4/0//1 35/0//1 3/0//1 70/0//1 4/0//0 3/0//0
7/0/mh/1 50/0/m/1 2/1/m/1 70/0/m/1 1/1/m/1 44/0/m/1 1/1/m/0 2/1/m/0 1/1/m/0 2/1/m/0 1/1/m/0
4/0/mh/1 30/0/m/1 2/1/m/1 33/0/m/1 1/1/m/1 28/0/m/1
1/1//0 2/1//0 4/0//0 60/0//1 3/0//1 50/0//1
2/1//0 3/1//0 3/0//0 45/0//1 4/0//1 80/0//1
2/1//0 5/0//0 70/0//1 6/0/h/1 20/0//1
"""


@cache
def labelled() -> tuple[np.ndarray, np.ndarray]:
    """The blocks of TABLE with their features, and their labels."""
    rows, labels = [], []
    for line in TABLE.strip().split("\n"):
        page = [(int(w), float(d), "m" in flags, "b" in flags, "h" in flags, int(label)) for w, d, flags, label in (b.split("/") for b in line.split())]
        rows += described([b[:5] for b in page])
        labels += [b[5] for b in page]
    return np.array(rows, float), np.array(labels)


def described(page: list[tuple[int, float, bool, bool, bool]]) -> list[tuple[float, ...]]:
    """The FEATURES of the blocks (words, link density, main, hint, heading) of a page."""
    has_main = any(b[2] for b in page)
    none = (0, 0.0)
    out = []
    for i, (words, links, main, hint, heading) in enumerate(page):
        before = page[i - 1][:2] if i else none
        after = page[i + 1][:2] if i + 1 < len(page) else none
        out.append((words, links, *before, *after, main, has_main and not main, heading, hint))
    return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = LEAST_LEAF) -> tuple:
    """A CART tree by Gini impurity: ("leaf", label) or (feature, cut, tree if value <= cut, tree otherwise).

    Ties go to the first feature and the lowest cut.
    """
    if depth == 0 or len(set(y)) == 1:
        return ("leaf", int(y.mean() >= 0.5))
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) < least:
                continue
            cost = sum(m.sum() * y[m].mean() * (1 - y[m].mean()) for m in (left, ~left))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(cut), left)
    if best is None:
        return ("leaf", int(y.mean() >= 0.5))
    _, f, cut, left = best
    low, high = grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least)
    return low if low == high else (f, cut, low, high)


@cache
def tree() -> tuple:
    """The tree grown on TABLE."""
    return grow(*labelled())


def used(node: tuple) -> set[str]:
    """The features that a tree asks for."""
    return set() if node[0] == "leaf" else {FEATURES[node[0]]} | used(node[2]) | used(node[3])


def says(node: tuple, row: tuple[float, ...]) -> bool:
    while node[0] != "leaf":
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return bool(node[1])


def _hinted(value: str) -> bool:
    """Whether one name of a class or id attribute hints at something else than main text."""
    for name in value.split():
        parts = [p.lower() for p in NAME_PART.findall(name)]
        if any(p in HINT_WORDS for p in parts) and all(p in HINT_WORDS or p in PLAIN_WORDS or len(p) == 1 for p in parts):
            return True
    return False


def hint_of(name: str, attributes: str, in_main: bool) -> int:
    """2 if an element stands aside by what it is, 1 if its name only hints at it, 0 otherwise."""
    if name in ASIDE or name == "header" and not in_main:
        return 2
    hint = int(name == "form")
    for m in ATTRIBUTE.finditer(attributes) if attributes.strip() else ():
        key, value = m[1].lower(), charrefs.unescape((m[2] or "").strip("\"'"))
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 2
        if key == "role" and value.strip().lower() in ASIDE_ROLES:
            hint = 1
        if key in ("class", "id") and name not in ("html", "body", "main") and _hinted(value):
            hint = 1
    return hint


class Element:
    """An open element: its name, whether it stands in a main element, its hint, and what is found inside."""

    __slots__ = ("heading", "hint", "landmark", "main", "name", "outer", "words")

    def __init__(self, name: str, outer: Element | None, main: bool, hint: int):
        self.name, self.outer, self.main, self.hint = name, outer, main, hint
        self.words, self.landmark = 0, False
        self.heading = name in HEADINGS or outer is not None and outer.heading


def blocks(page: str | None) -> list[tuple[str, int, int, bool, bool, bool]]:
    """(text, words, words in links, in main, hint, heading) of each block with text, in page order."""
    if not page:
        return []
    found: list[tuple[str, int, int, Element | None]] = []
    every: list[Element] = []  # elements with a hint, and articles
    stack: list[Element] = []
    parts: list[str] = []
    linked: list[str] = []
    links = silent = 0
    open_now: Counter[str] = Counter()  # so that a stray end tag costs no search
    where: Element | None = None

    def close() -> None:
        nonlocal where
        if parts:
            words = "".join(parts).split()
            if words:
                found.append((" ".join(words), len(words), min(len(words), len("".join(linked).split())), where))
            parts.clear()
            linked.clear()
        where = stack[-1] if stack else None

    def say(text: str) -> None:
        if text and not silent:
            text = charrefs.unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                linked.append(text)

    def pop(to: int) -> None:
        nonlocal links, silent
        for e in stack[to:]:
            open_now[e.name] -= 1
            links -= e.name == "a"
            silent -= e.name in SILENT
        del stack[to:]

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                say(charrefs.escape(m[0][9:-3]))
            continue
        name = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1) if open_now[name] > 0 else ():
                if stack[i].name == name:
                    inside = any(s.name in BLOCKS for s in stack[i + 1 :])
                    if name in BLOCKS or inside:
                        close()
                    if name in BLOCKS or not inside:
                        pop(i)
                    else:  # a block stands inside: only this inline element ends
                        links -= name == "a"
                        open_now[name] -= 1
                        del stack[i]
                    break
                if stack[i].name in MAIN and name not in MAIN | {"body", "html"}:
                    break
            if name in BLOCKS:
                close()
            continue
        if name in BLOCKS:
            close()
            if name in CLOSES_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name == "p":
                        pop(i)
                        break
                    if stack[i].name in BLOCKS:
                        break
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name and name in ("li", "dd", "dt", "option", "tr", "td", "th"):
                    pop(i)
                    break
                if stack[i].name in BLOCKS:
                    break
        elif name in ("br", "img", "input"):
            say(" ")
        if name not in VOID and not (m[3].endswith("/") and name not in BLOCKS | RAW | {"a", "b", "i", "span"}):
            outer = stack[-1] if stack else None
            in_main = outer is not None and outer.main or name in MAIN
            e = Element(name, outer, in_main, hint_of(name, m[3], in_main))
            open_now[name] += 1
            stack.append(e)
            if e.hint or name == "article":
                every.append(e)
            if name in LANDMARKS:
                for s in reversed(stack[:-1]):
                    if s.landmark:
                        break
                    s.landmark = True
            links += name == "a"
            silent += name in SILENT
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
                pop(len(stack) - 1)
        if name in BLOCKS:
            where = stack[-1] if stack else None
    close()
    return _placed(found, every)


def _placed(found: list[tuple[str, int, int, Element | None]], every: list[Element]) -> list[tuple[str, int, int, bool, bool, bool]]:
    """The blocks with their flags, once it is known what each hinted element holds."""
    total = sum(b[1] for b in found)
    # words of every element, from the inside out; runs of blocks in the same element cost one walk
    at, words = None, 0
    for _, n, _, e in [*found, ("", 0, 0, None)]:
        if e is not at:
            while at is not None:
                at.words += words
                at = at.outer
            at, words = e, 0
        words += n

    # what wraps the page's title, menus, most of its words or the article that holds them is no aside
    around = set()
    for e in every:
        if e.name == "article" and e.hint != 1 and 2 * e.words >= total:
            s = e.outer
            while s is not None and id(s) not in around:
                around.add(id(s))
                s = s.outer
    aside = {id(e) for e in every if e.hint == 2 or e.hint == 1 and not (e.landmark or id(e) in around or 10 * e.words >= 9 * total)}
    known: dict[int, bool] = {}

    def hint(e: Element | None) -> bool:
        path = []
        while e is not None and id(e) not in known:
            path.append(id(e))
            if id(e) in aside:
                break
            e = e.outer
        out = e is not None and (known.get(id(e), False) or id(e) in aside)
        known.update(dict.fromkeys(path, out))
        return out

    return [(text, n, linked, e is not None and e.main, hint(e), e is not None and e.heading) for text, n, linked, e in found]


def main_text(page: str | None) -> str:
    """The main text of a page; "" for null, empty and textless pages."""
    found = blocks(page)
    rows = described([(n, linked / n, main and not hint, hint, heading) for _, n, linked, main, hint, heading in found])
    top = tree()
    return "\n".join(b[0] for b, row in zip(found, rows, strict=True) if says(top, row))


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    Null and empty html gives an empty text with 0 characters, as does a page without main text. Repeated rows, null ids
    and null urls each come back as they are; other columns are not read. An empty table gives an empty result.
    """

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p) for p in batch], dtype=object)

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), of(F.col(html)).alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read(spark, sf_dir, "pages"))
