"""Main-text extraction by line-block distribution.

Markup is stripped to lines, one per block of the page, and each line gets a weight: the characters outside links. Weights are summed over
sliding windows of WINDOW lines. The text surges where a window reaches the threshold and dives where no window does any more; the lines
between are a hump. Humps with less than SHARE of the heaviest hump's weight are no article. Each hump then takes in what belongs to it:
the lines of its container, the innermost grouping element that holds all of its heavy lines; so titles, bylines and short closing lines
stay, while a line that merely stands before or after the container goes. A hump right under the page's body has no container of its
own and takes in only lines beside it, up to a main heading, a line of links, boilerplate or another element. Between two humps of
different containers nothing is kept.

What the markup says only weighs lines. Menus, headers, footers, sidebars, notices, adverts, forms and reader comments, by element or by a
role, class or id made wholly of such words (`share-price` is not), weigh nothing; where no other line has a weight and the page
marks no article, classes and ids are not believed. Of a page with `article` elements, else `main` ones, that hold at least SHARE of the weight,
all other lines weigh nothing, links inside count in full, and the marked element is the container. In other containers, WINDOW or more
lines of nothing but links in a row before or after the heavy lines are a menu.

A form is boilerplate, unless the page stands in it: it holds a marked article, or most characters of the page with more of them than
THRESHOLD for each of its controls. A header that belongs to the content (`content-header`) is no boilerplate, and a main heading stays though
it stands in a header within an article. Link lines between two heavy lines of a container are part of its text.

Character references are decoded, white space inside a block (a <br> too) becomes one space, blocks are trimmed and joined in page order
by one newline. Null or empty pages, and pages without text, give an empty text. Repeated rows are read alike, one row each; columns
beside those asked for are not read, whatever their names. Broken and very long pages are read whole, in time linear in their length.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from itertools import accumulate, groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing

#: Lines per window, characters that a window must reach, and the part of the heaviest hump's weight that a hump must have.
WINDOW, THRESHOLD, SHARE = 3, 86, 0.1

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math textarea select title object".split())
BOILERPLATE = frozenset("nav header footer aside button dialog menu".split())
CONTROLS = frozenset("input textarea select button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Blocks that hold lines but group no text of their own.
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd ul ol dl blockquote pre figure figcaption table thead tbody tfoot tr td th caption address details summary center".split())
#: Elements that end the one before them.
AGAIN = frozenset("li dt dd tr td th option".split())
ROOT = frozenset(("", "html", "body"))
#: Words of a class, id or role that mark boilerplate, and words that may stand beside them.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs toc header masthead footer sidebar aside complementary "
    "contentinfo cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search form share sharing social related recommended comment comments discussion disqus replies widget pagination pager toolbar".split()
)
BESIDE = frozenset("area bar block body bottom box btn button buttons container content fixed global group holder icon icons inner item items left links list main media message outer page panel primary reader readers right secondary section site slot sticky thread title top unit user users wrap wrapper".split())

#: Words that make a header one of the content.
CONTENT = frozenset("content main title".split())

_OPEN = re.compile(r"<!--|<!\[CDATA\[|<[!?]|</?([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP, _PLAIN = re.compile(r"""[<>"']"""), re.compile("[<>]")
_NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLOSE = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in RAW} | {"head": re.compile(r"</head\s*>|<body[\s>]", re.I)}


def named(attributes: str) -> tuple[bool, bool]:
    """Whether a class, id or role is made of boilerplate words, and whether the role is main."""
    boiler = main = False
    for key, value in _NAMED.findall(attributes):
        for name in value.strip("\"'").split():
            parts = [w.lower() for w in _PART.findall(name)]
            own = "header" in parts and not CONTENT.isdisjoint(parts)
            boiler |= not own and any(w in WORDS for w in parts) and all(w in WORDS or w in BESIDE for w in parts)
            main |= key.lower() == "role" and name.lower() == "main"
    return boiler, main


class Line(NamedTuple):
    """A block's text: characters outside links, the element that holds it, whether it stands in boilerplate by element or by name, in an article, in a main element, and the number of the form around it or 0."""

    text: str
    own: int
    element: int
    hard: bool
    named: bool
    article: bool
    main: bool
    form: int


class Element:
    """A block element: its name, the one around it, the innermost grouping one at or around it, and its lines (first and end)."""

    __slots__ = ("end", "first", "group", "name", "parent")

    def __init__(self, name: str, parent: int, group: int, first: int):
        self.name, self.parent, self.group, self.first, self.end = name, parent, group, first, -1


class Page:
    """A page's lines and block elements, read in one pass; element 0 is the page itself."""

    def __init__(self, page: str):
        self.page, self.lines, self.elements = page, [], [Element("", -1, 0, 0)]
        self.marked = False  # the page has article or main elements, be they empty
        self._stack: list[tuple] = []  # name, place of the innermost block at or below, element, and what it counts for: hard, named, article, main, link
        self._open: dict[str, list[int]] = {}  # places of the open elements of a name
        self._counts = [0] * 5
        self._headers = 0  # open header elements
        self._parts: list[str] = []
        self._linked = 0
        self._headed = True  # the end of a head may still follow
        self._forms, self._form = [[0, False]], 0  # of each form: its controls, and whether it holds a marked article; the one that is open
        self._read()
        self._pop(0)
        self._judge_forms()
        for e in self.elements:
            if e.end < 0:
                e.end = len(self.lines)

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                hard, name, article, main, _ = (n > 0 for n in self._counts)
                hard &= not (article and self.elements[self._block()].name == "h1" and self._counts[0] == self._headers)
                self.lines.append(Line(text, max(0, len(text) - self._linked), self._block(), hard, name, article, main, self._form))
            self._parts.clear()
        self._linked = 0

    def _judge_forms(self) -> None:
        """Lines of forms that are not around the page's text count as boilerplate."""
        own = [0 if x.hard or x.named else x.own for x in self.lines]
        mass = [0] * len(self._forms)
        for x, w in zip(self.lines, own, strict=True):
            mass[x.form] += w
        around = [k > 0 and (marked or 2 * mass[k] > sum(own) and mass[k] > THRESHOLD * controls) for k, (controls, marked) in enumerate(self._forms)]
        self.lines = [x._replace(hard=True) if x.form and not around[x.form] else x for x in self.lines]

    def _block(self) -> int:
        """The innermost open block element."""
        at = self._stack[-1][1] if self._stack else -1
        return self._stack[at][2] if at >= 0 else 0

    def _pop(self, to: int) -> None:
        while len(self._stack) > to:
            name, _, element, flags = self._stack.pop()
            self._open[name].pop()
            if element:
                self.elements[element].end = len(self.lines)
            for k, f in enumerate(flags):
                self._counts[k] -= f
            if name == "header":
                self._headers -= 1
            elif name == "form":
                self._form = 0

    def _push(self, name: str, flags: tuple[bool, ...]) -> None:
        element, below = 0, self._stack[-1][1] if self._stack else -1
        if name not in INLINE:
            around, element, below = self._block(), len(self.elements), len(self._stack)
            self.elements.append(Element(name, around, self.elements[around].group if name in LEAF else element, len(self.lines)))
        self._stack.append((name, below, element, flags))
        self._open.setdefault(name, []).append(len(self._stack) - 1)
        if name == "header":
            self._headers += 1
        elif name == "form":
            self._forms.append([0, False])
            self._form = len(self._forms) - 1
        for k, f in enumerate(flags):
            self._counts[k] += f

    def _said(self, text: str) -> None:
        text = entities.unescape(text)
        self._parts.append(text)
        if self._counts[4]:
            self._linked += len(" ".join(text.split()))

    def _read(self) -> None:
        page, size = self.page, len(self.page)
        at = said = wasted = 0  # wasted: characters read in vain for the end of a tag; quotes are ignored when they come to be many
        while (m := _OPEN.search(page, at)) is not None:
            start, name = m.start(), m[1]
            if name is None:
                mark, close = next((k, c) for k, c in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")) if m[0].startswith(k))
                self._said(page[said:start])
                end = page.find(close, m.end())
                if mark == "<![CDATA[":
                    self._said(page[m.end() : end if end >= 0 else size])
                at = said = size if end < 0 else end + len(close)
                continue
            end = at = m.end()
            quotes = wasted <= 4 * size
            while (s := (_STOP if quotes else _PLAIN).search(page, end)) is not None and s[0] in "\"'":
                end = page.find(s[0], s.end()) + 1
                if not end:
                    s = None
                    break
            if s is None or s[0] == "<":  # no tag
                wasted += (size if s is None else s.start()) - start
                continue
            if start > said:
                self._said(page[said:start])
            at = said = s.end()
            at = said = self._tag(name.lower(), page[start + 1] == "/", page[m.end() : s.start()], at)
        self._said(page[said:])
        self._flush()

    def _tag(self, name: str, ends: bool, attributes: str, at: int) -> int:
        """Takes in a tag that ends at `at`; returns where reading goes on."""
        if name == "br":
            self._parts.append(" ")
            return at
        if ends:
            self._ended(name)
            return at
        closed = attributes.endswith("/")
        if name in CONTROLS and self._form and "hidden" not in attributes:
            self._forms[self._form][0] += 1
        if name in RAW:
            if closed:
                return at
            end = _CLOSE[name].search(self.page, at)
            return len(self.page) if end is None else end.start()
        if name == "head":
            end = _CLOSE["head"].search(self.page, at) if self._headed else None
            self._headed = end is not None
            return at if end is None else end.start()
        boiler, role_main = named(attributes) if "=" in attributes else (False, False)
        article, main = name == "article", name == "main" or role_main
        self.marked |= article or main
        self._forms[self._form][1] |= article or main
        if name == "form" and self._form:
            return at  # forms don't nest
        keeps = article or main or name in ROOT  # never boilerplate by name
        flags = (name in BOILERPLATE, boiler and not keeps, article, main, name == "a")
        if name not in INLINE:
            self._flush()
            while self._stack:  # a block ends an open paragraph, an item the item before it
                top = self._stack[-1][1]
                if top < 0 or not (self._stack[top][0] == "p" or self._stack[top][0] == name and name in AGAIN):
                    break
                self._pop(top)
        elif flags[1]:
            self._flush()
        if name not in VOID and not closed:
            self._push(name, flags)
        return at

    def _ended(self, name: str) -> None:
        if name in RAW or name in VOID:
            return
        places = self._open.get(name)
        found = places[-1] if places else None
        if found is not None and name in INLINE and self._stack[-1][1] > found:
            found = None  # an inline end never closes a block
        if name not in INLINE or found is not None and self._stack[found][3][1]:
            self._flush()
        if found is not None:
            self._pop(found)


def weights(page: Page) -> tuple[list[int], str]:
    """Each line's weight, and the kind of element that marks the text (`article`, `main`, or none)."""
    boiler = [x.hard or x.named for x in page.lines]
    own = [0 if b else x.own for x, b in zip(page.lines, boiler, strict=True)]
    if not page.marked and not any(own):
        own = [0 if x.hard else x.own for x in page.lines]
    for kind in ("article", "main"):
        inside = [len(x.text) if getattr(x, kind) and not b else 0 for x, b in zip(page.lines, boiler, strict=True)]
        outside = sum(w for x, w in zip(page.lines, own, strict=True) if not getattr(x, kind))
        if any(inside) and sum(inside) >= SHARE * (sum(inside) + outside):
            return inside, kind
    return own, ""


def humps(weight: list[int], window: int = WINDOW, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Runs (first line and end) of lines in windows that reach the threshold, or the highest sum where none does."""
    total = [0, *accumulate(weight)]
    sums = [total[min(i + window, len(weight))] - total[i] for i in range(len(weight))]
    threshold = min(threshold, max(sums, default=0))
    out: list[tuple[int, int]] = []
    for i, s in enumerate(sums):
        if s >= threshold > 0:
            end = min(i + window, len(weight))
            if out and i <= out[-1][1]:
                out[-1] = (out[-1][0], end)
            else:
                out.append((i, end))
    mass = [total[b] - total[a] for a, b in out]
    return [h for h, m in zip(out, mass, strict=True) if m >= SHARE * max(mass)]


def _around(page: Page, line: int, end: int) -> int:
    """The innermost grouping element of the lines `line` to `end`."""
    at = page.lines[line].element
    while at > 0 and page.elements[at].end < end:
        at = page.elements[at].parent
    return page.elements[at].group


def _taken(page: Page, kind: str, first: int, end: int, plain: list[bool]) -> tuple[int, int]:
    """The lines that the heavy ones, `first` to `end`, bring with them: those of their marked element or container, or those beside them."""
    lines, last = page.lines, len(page.lines)
    if kind:
        while first > 0 and getattr(lines[first - 1], kind):
            first -= 1
        while end < last and getattr(lines[end], kind):
            end += 1
        return first, end
    box = _around(page, first, end)
    if page.elements[box].name not in ROOT:
        return page.elements[box].first, page.elements[box].end
    beside = lambda i: plain[i] and lines[i].own and _around(page, i, i + 1) == box
    while first > 0 and page.elements[lines[first].element].name != "h1" and beside(first - 1):
        first -= 1
    while end < last and beside(end):
        end += 1
    return first, end


def main_text(html: str, window: int = WINDOW, threshold: int = THRESHOLD) -> str:
    """The article's text."""
    page = Page(html)
    lines = page.lines
    weight, kind = weights(page)
    believed = page.marked or any(w and not x.named for x, w in zip(lines, weight, strict=True))
    plain = [not (x.hard or believed and x.named) and (not kind or getattr(x, kind)) for x in lines]
    linked: set[int] = set()
    if not kind:
        at = 0
        for links, row in groupby(lines, key=lambda x: x.own == 0):
            many = len(list(row))
            if links and many >= window:  # a menu, unless the text goes on behind it
                plain[at : at + many] = [False] * many
                linked.update(range(at, at + many))
            at += many
    out, covered = [], 0
    for first, end in humps(weight, window, threshold):
        heavy = min(threshold, max(weight[first:end]))
        strong = [i for i in range(first, end) if weight[i] >= heavy]
        if strong[-1] >= covered:
            plain[strong[0] : strong[-1]] = [p or k in linked and not (lines[k].hard or lines[k].named) for k, p in enumerate(plain[strong[0] : strong[-1]], strong[0])]
            first, end = _taken(page, kind, strong[0], strong[-1] + 1, plain)
            out += [lines[i].text for i in range(max(first, covered), end) if plain[i]]
            covered = max(covered, end)
    return "\n".join(out)


def extracted(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The `keep` columns with text and n_chars (code points)."""
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(html), F.lit("")).alias("__html"))
    schema = rows.drop("__html").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema.names)

    return rows.mapInArrow(releasing(run), schema)
