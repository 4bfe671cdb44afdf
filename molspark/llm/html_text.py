"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one per block element; a dropped element leaves a gap
of empty lines, unless the lines before it in the same parent have surged: then what
follows there, however short, is judged together with them. Text lengths are summed over windows of three lines. The text runs
from a surge, a window of enough text, to the dive, a window without any; lines
between them are kept, so short paragraphs inside the text stay and lone menu or
notice lines do not. Lines whose text is mostly links weigh nothing.

If the page marks its article (``article``, ``main``, the role or item property) and
the windows surge inside, all lines there are the text, the shortest too.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

from pyspark.sql import DataFrame, functions as F

from molspark.llm.text import per_text

WINDOW, SURGE = 3, 86
# Element and class names by what they mean on a page.
DROPPED = frozenset(
    "head title script style noscript template iframe object svg canvas nav header footer aside form button select textarea "
    "dialog menu audio video map datalist".split()
)
RAW = frozenset("script style title textarea iframe noscript template svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
COMMENTS = frozenset("comment comments disqus discussion reply replies respond".split())
BOILERPLATE = COMMENTS | frozenset(
    "ad ads adslot advert advertisement adverts advertising banner breadcrumb breadcrumbs captcha consent cookie cookies copyright dialog footer "
    "gdpr header login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted promotion "
    "recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
HARMLESS = frozenset("has with no without content main body article text enabled disabled open closed wrapper container layout".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PARTS = re.compile(r"[a-z0-9]+")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(text)} if text.strip() else {}


def _is_boilerplate(name: str, attributes: dict[str, str]) -> bool:
    if name in DROPPED:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    if attributes.get("role") in ROLES:
        return True
    names = COMMENTS if name == "article" else BOILERPLATE
    for label in (attributes.get("class", "") + " " + attributes.get("id", "")).split():
        parts = set(_PARTS.findall(label))
        if parts & names and not parts & HARMLESS:
            return True
    return False


def _is_main(name: str, attributes: dict[str, str]) -> bool:
    return name in ("article", "main") or attributes.get("role") in ("main", "article") or attributes.get("itemprop") == "articlebody"


def _weight(line: tuple[str, int, bool]) -> int:
    return 0 if 2 * line[1] > len(line[0]) else len(line[0])


class _Block:
    """An open block element: whether a window of its lines and of its children's has surged."""

    def __init__(self, depth: int) -> None:
        self.depth, self.surged = depth, False
        self._last = (0,) * WINDOW

    def add(self, weight: int) -> None:
        self._last = (*self._last[1:], weight)
        self.surged = self.surged or sum(self._last) >= SURGE


class _Lines:
    """Lines of a page: text, characters of it in links, whether inside the marked article; None is a gap."""

    def __init__(self) -> None:
        self.lines: list[tuple[str, int, bool] | None] = []
        self.blocks = [_Block(0)]  # the page and the open block elements
        self._parts: list[str] = []
        self._links = 0

    def add(self, text: str, in_link: bool) -> None:
        text = unescape(text)
        self._parts.append(text)
        if in_link:
            self._links += len(text)

    def end(self, in_main: bool) -> None:
        text = " ".join("".join(self._parts).split())
        if text:
            self.lines.append((text, self._links, in_main))
            for block in self.blocks[-2:]:  # the block of the line and its parent
                block.add(_weight(self.lines[-1]))
        self._parts, self._links = [], 0

    def gap(self, in_main: bool) -> None:
        self.end(in_main)
        if not self.blocks[-1].surged:
            self.lines.append(None)

    def opened(self, depth: int) -> None:
        self.blocks.append(_Block(depth))

    def closed(self, depth: int) -> None:
        while self.blocks[-1].depth > depth:
            self.blocks.pop()


def lines_of(html: str) -> list[tuple[str, int, bool] | None]:
    """The lines of a page. Elements that are never closed end with the page or an enclosing element."""
    out, stack, opened = _Lines(), [], Counter()
    dropped = mains = links = at = 0
    link = -1  # place of the open link, of which there is one at most
    while at < len(html):
        tag = _TAG.search(html, at)
        if not dropped:
            out.add(html[at : tag.start() if tag else len(html)], links > 0)
        if not tag:
            break
        at = tag.end()
        if not tag[2]:
            continue
        name, closing = tag[2].lower(), bool(tag[1])
        if name == "br" and not dropped:
            out.add(" ", False)
        if name in VOID or (closing and not opened[name]):
            if name == "hr" and not dropped:
                out.end(mains > 0)
            continue
        if name in BLOCKS and not dropped:
            out.end(mains > 0)
        if closing:
            while True:
                last, drops, main = stack.pop()
                opened[last] -= 1
                dropped, mains, links = dropped - drops, mains - main, links - (last == "a")
                link = -1 if last == "a" else link
                if last == name:
                    break
            out.closed(len(stack))
            continue
        attributes = _attributes(tag[3])
        drops, main = _is_boilerplate(name, attributes), _is_main(name, attributes)
        if drops and not dropped:
            out.gap(mains > 0)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif not tag[3].endswith("/") or name in BLOCKS or name in DROPPED:
            if name == "a":
                if link >= 0:  # links do not nest: a new one ends the last
                    links -= 1
                    stack[link] = ("", *stack[link][1:])
                    opened["a"] -= 1
                link = len(stack)
            stack.append((name, drops, main))
            opened[name] += 1
            dropped, mains, links = dropped + drops, mains + main, links + (name == "a")
            if name in BLOCKS:
                out.opened(len(stack))
    out.end(mains > 0)
    return out.lines


def _between(lines: list[tuple[str, int, bool] | None]) -> list[str]:
    """The lines between surges and dives."""
    rows: list[tuple[str, int]] = []
    for line in lines:
        if line is None:
            rows += [("", 0)] * WINDOW
        else:
            rows.append((line[0], _weight(line)))
    sums = [sum(size for _, size in rows[i : i + WINDOW]) for i in range(len(rows))]
    out, inside = [], False
    for (text, _), total in zip(rows, sums):
        inside = total > 0 and (inside or total >= SURGE)
        if inside and text:
            out.append(text)
    return out


def main_text(html: str | None) -> str:
    """The page's text, its blocks joined by blank lines; empty if there is none.

    Character references are decoded and white space inside a block becomes one
    space. If no window surges anywhere, the marked article's lines are the text,
    and without one the lines that are not links, if they are all the page has.
    """
    lines = lines_of(html or "")
    main = [line for line in lines if line is None or line[2]]
    marked = [line[0] for line in main if line]
    if marked and _between(main):
        return "\n\n".join(marked)
    return "\n\n".join(_between(lines) or marked or [line[0] for line in lines if line and 2 * line[1] <= len(line[0])])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text, n_chars`` of every row of ``pages``, from the whole page.

    A null or empty page has an empty text. Null ids and urls stay, repeated rows
    repeat, other columns are not read, and an empty table gives an empty one.
    """
    found = per_text(
        pages, html_col, [id_col, url_col], lambda pages: {"text": [main_text(p.decode() if p else "") for p in pages]}, {"text": "string"}
    )
    return found.select(F.col("_0").alias(id_col), F.col("_1").alias(url_col), "text", F.char_length("text").cast("bigint").alias("n_chars"))
