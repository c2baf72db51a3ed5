"""Main text of web pages by composite text density.

A page becomes a tree of elements (a tolerant parser: void elements, implied ends
of p, li, cells and options, stray and missing end tags).  Elements that hold no page
text by what they are - scripts, styles, menus (nav), forms, frames, footers, asides,
by tag or role, or hidden - are taken out.  Names of classes and ids are never read.
Every other element gets the composite text density of Sun, Song and Liao (2011), its
characters per tag, adjusted for links:

    C/T * log(C/LC * T/LT) / log(ln(C * LC/NLC + C * LCb/Cb + e))

with characters C, tags T, link characters LC and link tags LT, characters outside
links NLC, and b for the body; what is counted as none counts as one.  The element
with the largest sum of its block children's densities is the core of the main text;
single lines in containers don't count beside children that have blocks.  The
least density on the path from the body to it is the threshold for what is around the
core and in it:

- The core is widened to its parent, and so on, while everything else there is text of
  the article too: headings, or elements of the threshold's density that are text
  elements (p, lists, tables, quotes) or of the same tag as the part at hand and, like
  it, made of blocks.
- Within it, containers (div, section and the like; lists and tables if most of their
  characters are links) below the threshold go, unless they hold the h1, or most of
  the core's text stands right in elements of their own tag.

Its text is given block by block, one line each, white space in a block made one
space.  Defined results: a null, empty or textless page gives an empty string;
pages without tags are one block; nothing is capped; each row is treated by itself,
whatever its id.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")}
_BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_ENDS_P = _BLOCKS - {"option", "caption", "body", "html"}
#: An opening tag ends an open element of these, unless one of the second stands between.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
_GONE = frozenset("head script style noscript template nav aside footer form button select textarea input iframe object embed svg canvas audio video map dialog menu title link meta label fieldset xmp noembed noframes".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup hr header".split())
_TEXT = frozenset("p ul ol dl table blockquote pre figure".split())
_LISTS = frozenset("ul ol dl table".split())
_CONTAINERS = frozenset("div section article details center address".split())


class Tree:
    """Elements in page order: tag, parent, and pieces (texts and element numbers) of each."""

    def __init__(self, page: str):
        self.tags, self.parents, self.pieces, self.gone = ["#root"], [-1], [[]], [False]
        self._open = [0]
        self._parse(page)

    def _parse(self, page: str) -> None:
        at = 0
        while True:
            m = _TOKEN.search(page, at)
            self._text(page[at : m.start()] if m else page[at:])
            if not m:
                return
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            if m[1] or m[4]:
                self._close(name)
                continue
            attrs = m[3] if m[2] else m[6]
            self._start(name, attrs)
            if name in _RAW and self.tags[self._open[-1]] == name:
                end = _RAW[name].search(page, at)
                at = end.start() if end else len(page)

    def _text(self, text: str) -> None:
        if text:
            self.pieces[self._open[-1]].append(html.unescape(text) if "&" in text else text)

    def _end_until(self, names, stop) -> None:
        for k in range(len(self._open) - 1, 0, -1):
            tag = self.tags[self._open[k]]
            if tag in names:
                del self._open[k:]
                return
            if tag in stop:
                return

    def _start(self, name: str, attrs: str) -> None:
        if name in _ENDS_P:
            self._end_until({"p"}, {"button", "td", "th", "caption", "object", "table"} | ({"li", "div", "article", "section"} if name != "p" else {"div", "article", "section", "li", "blockquote"}))
        if name in _IMPLIED:
            self._end_until(*_IMPLIED[name])
        number = len(self.tags)
        self.tags.append(name)
        self.parents.append(self._open[-1])
        self.pieces.append([])
        self.gone.append(name in _GONE or bool(attrs) and hidden(attrs))
        self.pieces[self._open[-1]].append(number)
        if name not in _VOID and not (attrs.endswith("/") and name not in _BLOCKS and name not in _RAW):
            self._open.append(number)

    def _close(self, name: str) -> None:
        for k in range(len(self._open) - 1, 0, -1):
            if self.tags[self._open[k]] == name:
                del self._open[k:]
                return


def hidden(attrs: str) -> bool:
    """Whether the element isn't shown, or its role is none of text."""
    for m in _ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "role" and value.lower() in _ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def density(c: int, t: int, lc: int, lt: int, body_c: int, body_lc: int) -> float:
    if not c:
        return 0.0
    c_, t_, lc_, lt_, nlc = c, max(t, 1), max(lc, 1), max(lt, 1), max(c - lc, 1)
    base = math.log(c * lc / nlc + c * body_lc / max(body_c, 1) + math.e)
    inner = c_ / lc_ * t_ / lt_
    return c_ / t_ * (math.log(inner) if inner > 1 else 0.0) / max(math.log(base), 1.0) if base > 1 else c_ / t_ * (math.log(inner) if inner > 1 else 0.0)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    tree = Tree(page)
    tags, parents, n = tree.tags, tree.parents, len(tree.tags)
    gone = tree.gone
    in_article, in_link, own = [False] * n, [False] * n, [0] * n
    has_title = [False] * n
    for i in range(n - 1, 0, -1):
        if tags[i] == "h1" or has_title[i]:
            has_title[parents[i]] = True
    for i in range(1, n):
        p = parents[i]
        in_article[i] = in_article[p] or tags[i] in ("article", "main")
        in_link[i] = in_link[p] or tags[i] == "a"
        if tags[i] == "header" and not (in_article[p] and has_title[i]):
            gone[i] = True
        gone[i] = gone[i] or gone[p]
    chars, marks, link_chars, link_marks = [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        if gone[i]:
            continue
        own[i] = sum(len("".join(x.split())) for x in tree.pieces[i] if x.__class__ is str)
        chars[i] += own[i]
        link_chars[i] += own[i] if in_link[i] else 0
        if i:
            p = parents[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            marks[p] += marks[i] + 1
            link_marks[p] += link_marks[i] + (tags[i] == "a")
    body = next((i for i in range(1, n) if tags[i] == "body" and not gone[i]), 0)
    dense = [0.0 if gone[i] else density(chars[i], marks[i], link_chars[i], link_marks[i], chars[body], link_chars[body]) for i in range(n)]
    total, lines, bears = [0.0] * n, [0.0] * n, [False] * n
    for i in range(n - 1, -1, -1):
        if not bears[i]:
            total[i] += lines[i]
        if i and not gone[i] and tags[i] in _BLOCKS:  # marks inside a line make no part of a page
            p = parents[i]
            bears[p] = bears[p] or total[i] > 0
            if tags[i] in _CONTAINERS and not total[i]:
                lines[p] += dense[i]  # a line in no text element counts where it isn't beside parts of blocks
            else:
                total[p] += dense[i]
    core = max(range(body, n), key=lambda i: (total[i], -i))
    path = [core]
    while path[-1] not in (body, 0):
        path.append(parents[path[-1]])
    threshold = min(dense[i] for i in path)

    def fits(k: int, below: int) -> bool:
        """Whether k, beside `below`, is text of the article too."""
        if tags[k] in _HEADINGS:
            return True
        alike = tags[k] == tags[below] and (total[k] > 0) == (total[below] > 0)
        return dense[k] >= threshold and (tags[k] in _TEXT or alike)

    top = core
    for i in path[1:]:
        others = [k for k in tree.pieces[i] if k.__class__ is int and k != top and not gone[k] and chars[k]]
        if not all(fits(k, top) for k in others):
            break
        top = i
    inside, block, held = [False] * n, [0] * n, Counter()
    inside[top], block[top] = True, top
    for i in range(top, n):
        if i != top:
            inside[i] = inside[parents[i]] and not gone[i]
            block[i] = i if tags[i] in _BLOCKS else block[parents[i]]
        if inside[i]:
            held[tags[block[i]]] += own[i]
    bearing = max(held, key=lambda t: held[t])
    for i in range(top + 1, n):
        gone[i] = gone[i] or gone[parents[i]]
        if inside[i] and not gone[i] and chars[i] and dense[i] < threshold and not has_title[i]:
            links = 2 * link_chars[i] > chars[i]
            gone[i] = tags[i] in _CONTAINERS and (links or tags[i] != bearing) or tags[i] in _LISTS and links
    return "\n".join(blocks(tree, top, gone))


def blocks(tree: Tree, top: int, gone: list[bool]) -> Iterator[str]:
    held: list[str] = []
    stack: list = [(top, iter(tree.pieces[top]))]
    while stack:
        number, pieces = stack[-1]
        for x in pieces:
            if x.__class__ is str:
                held.append(x)
            elif tree.tags[x] == "br":
                held.append(" ")
            elif not gone[x]:
                if tree.tags[x] in _BLOCKS:
                    if line := " ".join("".join(held).split()):
                        yield line
                    held = []
                stack.append((x, iter(tree.pieces[x])))
                break
        else:
            stack.pop()
            if tree.tags[number] in _BLOCKS or not stack:
                if line := " ".join("".join(held).split()):
                    yield line
                held = []


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    schema = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            texts = [main_text(v.as_py()) for v in x.column(2)]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(texts, pa.string()), pa.array([len(s) for s in texts], pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)
