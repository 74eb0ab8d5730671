"""A page as text lines: one row's helper, tolerant of broken markup.

A line is the text between two block boundaries, its character references decoded and its white space made single.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</(?![a-zA-Z])[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: What a start tag closes first, and where the search for it ends.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: What an open paragraph outside of them is not closed from.
_HOLDS_P = {"article", "main", "section", "div", "td", "th", "li", "blockquote", "table", "body", "button", "object"}
_ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "noscript", "template", "svg", "math", "object", "canvas", "audio", "video", "head", "search"}
_ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
_ASIDE_NAME = re.compile(
    r"(?:.*[-_])?(?:nav|navbar|navigation|menu|masthead|footer|sidebar|aside|ad|ads|advert\w*|adsense|adslot|promo\w*|sponsor\w*|banner|cookies?|consent|gdpr|"
    r"notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|share|sharing|social|related|recommend\w*|comments?|commentlist|respond|replies|"
    r"disqus|breadcrumbs?|pagination|pager|widgets?|login|search|skip|toolbar|legal|copyright)(?:[-_].*)?", re.I,
)
_HEADER_NAME = re.compile(r"(?:(?:site|page|top|main|global)[-_])?header(?:[-_](?:bar|top|wrap|wrapper))?|topbar", re.I)
_COMMENT_NAME = re.compile(r"(?:.*[-_])?comments?|replies|reply|related|teaser|ad|ads|advert\w*|promo\w*", re.I)
_CONTENT_NAME = re.compile(r"(?:main|page|post|entry|article|story)[-_]?(?:content|body|text)|content|article|story|main", re.I)

ARTICLE, MAIN, CONTENT = 4, 2, 1


@dataclass(slots=True)
class Line:
    text: str
    #: Where it stands: ARTICLE, MAIN and CONTENT, added up.
    place: int
    #: Whether it is in a menu, footer, advert or the like.
    aside: bool


def _start(name: str, attributes: str, place: int, aside: bool) -> tuple[int, bool]:
    known = {}
    if attributes.strip(" /"):
        known = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    names = (known.get("class", "") + " " + known.get("id", "")).split()
    role = known.get("role", "").lower()
    if name in ("article", "main"):
        aside = aside or any(map(_COMMENT_NAME.fullmatch, names))
    elif name not in ("html", "body"):
        aside = aside or name in _ASIDE or role in _ASIDE_ROLES or "hidden" in known or known.get("aria-hidden", "").lower() == "true"
        aside = aside or any(map(_ASIDE_NAME.fullmatch, names)) or place < MAIN and (name == "header" or any(map(_HEADER_NAME.fullmatch, names)))
    if name == "article":
        place |= ARTICLE
    elif name == "main" or role == "main":
        place |= MAIN
    elif known.get("itemprop") == "articleBody" or name not in ("html", "body") and any(map(_CONTENT_NAME.fullmatch, names)):
        place |= CONTENT
    return place, aside


def lines(html: str | None) -> list[Line]:
    """The text lines of a page, in page order."""
    html = html or ""
    out: list[Line] = []
    stack: list[tuple[str, int, bool]] = []
    #: Where on the stack each name is open, ascending, so that no tag searches the stack; blocks under "".
    opened: dict[str, list[int]] = {"": []}
    held: list[str] = []
    at, size = 0, len(html)
    place, aside = 0, False

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.append(Line(text, place, aside))

    def text(piece: str) -> None:
        if piece:
            held.append(unescape(piece) if "&" in piece else piece)

    def last(names: Iterable[str]) -> int:
        return max((opened[n][-1] for n in names if opened.get(n)), default=-1)

    def pop(to: int) -> None:
        nonlocal place, aside
        if last(("",)) >= to or any(x[2] for x in stack[to:]) != aside:
            flush()
        while len(stack) > to or stack and not stack[-1][0]:
            name = stack.pop()[0]
            for n in (name, "") if name in _BLOCK else (name,) if name else ():
                opened[n].pop()
        now = stack[-1] if stack else ("", 0, False)
        if (now[1], now[2]) != (place, aside):
            flush()
        place, aside = now[1], now[2]

    while at < size:
        m = _TAG.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at: m.start()])
        at = m.end()
        if m[2] is None:
            continue
        close = html.find(">", at)
        if close < 0:  # a tag that the page's end cuts off
            break
        attributes, at = m[3] + html[at:close], close + 1
        name = m[2].lower()
        if m[1]:
            k = last((name,))
            if k >= 0 and (name in _BLOCK or last(("",)) < k):
                pop(k)
            elif k >= 0 and not stack[k][2]:  # closed across a block: its place on the stack is left empty
                stack[k] = ("", *stack[k][1:])
                opened[name].pop()
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(html, at)
            at = size if end is None else (html.find(">", end.end()) + 1 or size)
            continue
        if name in _BLOCK:
            flush()
            k = last("p")
            if k > last(_HOLDS_P):
                pop(k)
        elif name in ("br", "img"):
            held.append(" ")
        if name in _CLOSES:
            closes, ends = _CLOSES[name]
            k = last(closes)
            if k > last(ends):
                pop(k)
        if name in _VOID or attributes.endswith("/") and name not in _BLOCK:
            continue
        now = _start(name, attributes, place, aside)
        if now != (place, aside):
            flush()
        place, aside = now
        for n in (name, "") if name in _BLOCK else (name,):
            opened.setdefault(n, []).append(len(stack))
        stack.append((name, place, aside))
    flush()
    return out


def main_place(found: list[Line]) -> int:
    """The strictest place that has text: ARTICLE, MAIN, CONTENT, or 0 for a page without any of them."""
    return next((p for p in (ARTICLE, MAIN, CONTENT) if any(x.place & p and not x.aside for x in found)), 0)


#: Bits of a table of rows that is kept whole.
_TABLE = 1 << 25
#: A line that stands at more places than this has its bits kept.
_OFTEN = 64


def common_lines(a: list[str], b: list[str]) -> list[int]:
    """Indices of ``a`` in a longest common subsequence of ``a`` and ``b``.

    Common ends are taken off. A row of the table is one integer, a bit for each line of ``b``; where the rows would be
    large, ``a`` is halved at the place of ``b`` that its best alignment passes, so only two rows are held.
    """
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append(a0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append(a1)
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1 or (a1 - a0) * (b1 - b0) <= _TABLE:
            found += [a0 + i for i in _in_table(a[a0:a1], b[b0:b1])]
            continue
        middle = (a0 + a1) // 2
        upper = _prefix_lengths(a[a0:middle], b[b0:b1])
        lower = _prefix_lengths(a[middle:a1][::-1], b[b0:b1][::-1])[::-1]
        cut = b0 + int(np.argmax(upper + lower))
        todo += [(a0, middle, b0, cut), (middle, a1, cut, b1)]
    return sorted(found)


def _rows(a: list[str], b: list[str]) -> Iterator[int]:
    """For each line of ``a`` the row after it: a zero bit where the longest common subsequence with ``b`` grows."""
    at: dict[str, list[int]] = {}
    for j, line in enumerate(b):
        at.setdefault(line, []).append(j)
    kept: dict[str, int] = {}
    row = full = (1 << len(b)) - 1
    for line in a:
        bits = kept.get(line, 0)
        if not bits and line in at:
            if len(at[line]) > _OFTEN:
                flags = np.zeros(len(b), np.uint8)
                flags[at[line]] = 1
                bits = kept[line] = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
            else:
                for j in at[line]:
                    bits |= 1 << j
        hit = row & bits
        row = ((row + hit) | (row - hit)) & full
        yield row


def _prefix_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` with each beginning of ``b``."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def _in_table(a: list[str], b: list[str]) -> list[int]:
    rows = [(1 << len(b)) - 1, *_rows(a, b)]
    found, i, j = [], len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if rows[i] >> (j - 1) & 1:  # the step at j is new in this row: a match
            found.append(i)
            j -= 1
    return found
