"""Text blocks of a page, with where they stand."""

from __future__ import annotations

import re
from typing import NamedTuple

# Elements by their role in a page's markup.
DROPPED = ("script", "style", "head")
INLINE = ("a", "b", "i", "em", "strong", "code", "span", "small")
SECTIONS = ("div", "section", "article", "main", "nav", "aside", "header", "footer", "td", "th", "table", "body", "ul", "ol", "form", "blockquote")
SEMANTIC = ("article", "main", "nav", "aside", "header", "footer")
WITHIN = "\x1f"  # between the sections of a place
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_DROP = re.compile(rf"<({'|'.join(DROPPED)})(?:\s[^>]*)?>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TOKEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s[^>]*|/)?)>|<[^>]*>")
_NAME = re.compile(r"(?:^|\s)(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_NUMBERS = re.compile(r"\d[\d./:,\-]*")
_WORDS = re.compile(r"[^\W\d_]+")


class Block(NamedTuple):
    text: str
    tag: str  # the nearest enclosing element
    place: str  # the sections around it that have a name or a meaning, outermost first
    free: int  # characters outside links


def page_blocks(html: str) -> list[Block]:
    """The blocks of a page in order: text between two tags, inline tags removed without trace."""
    html = _DROP.sub("", _COMMENT.sub("", html))
    out: list[Block] = []
    sections: list[tuple[str, str]] = []  # open sections: tag and place
    tag, text, free, links, at = "", [], 0, 0, 0

    def flush() -> None:
        nonlocal text, free
        whole = _SPACE.sub(" ", "".join(text)).strip()
        if whole:
            out.append(Block(whole, tag, sections[-1][1] if sections else "", min(free, len(whole))))
        text, free = [], 0

    def add(piece: str) -> None:
        nonlocal free
        text.append(piece)
        if not links:
            free += len(piece.strip())

    for m in _TOKEN.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if name in INLINE:
            if name == "a":
                links = max(0, links + (-1 if m[1] else 1))
            continue
        flush()
        links = 0
        if m[1]:
            tag = ""
            for i in range(len(sections) - 1, -1, -1):
                if sections[i][0] == name:
                    del sections[i:]
                    break
            continue
        tag = name
        if name in SECTIONS:
            if name in ("td", "th"):  # an end tag may be missing
                for i in range(len(sections) - 1, -1, -1):
                    if sections[i][0] == "table":
                        break
                    if sections[i][0] in ("td", "th"):
                        del sections[i:]
                        break
            named = _NAME.search(m[3] or "")
            around = sections[-1][1] if sections else ""
            own = f"{name}.{next(x for x in named.groups() if x is not None)}" if named else name if name in SEMANTIC else ""
            sections.append((name, f"{around}{WITHIN}{own}" if around and own else around or own))
        elif name == "tr":
            for i in range(len(sections) - 1, -1, -1):
                if sections[i][0] == "table":
                    break
                if sections[i][0] in ("td", "th"):
                    del sections[i:]
                    break
    add(html[at:])
    flush()
    return out


def site_pattern(host: str) -> re.Pattern[str] | None:
    """A pattern of the site's name in running text, from its host; its letters may be set apart."""
    labels = host.split(".")[:-1] or host.split(".")
    name = max((re.match(r"[^\W\d_]*", x)[0] for x in labels), key=len, default="")
    return re.compile(r"\s?".join(map(re.escape, name)), re.I) if len(name) >= 4 else None


def block_key(text: str, name: re.Pattern[str] | None) -> str:
    """The text in lower case, the site's name, numbers and dates masked."""
    masked = name.sub("@", text) if name else text
    return _NUMBERS.sub("0", _SPACE.sub(" ", masked.lower()).strip())


def n_words(text: str) -> int:
    return len(_WORDS.findall(text))


def common_subsequence(a: list, b: list) -> list[tuple[int, int]]:
    """Positions (in a, in b) of a longest common subsequence.

    A row of the table of lengths is one integer of a bit per element of b: whether the length
    grows there. Every k-th row is kept and those between are worked out again on the way back, so
    memory is a few rows, and time is len(a) * len(b) / 64 steps of a processor's word.
    """
    low, high = 0, 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    ends = [(i, i) for i in range(low)], [(len(a) - high + i, len(b) - high + i) for i in range(high)]
    mid_a, mid_b = range(low, len(a) - high), range(low, len(b) - high)
    shared = {a[i] for i in mid_a} & {b[j] for j in mid_b}
    pa = [i for i in mid_a if a[i] in shared]
    pb = [j for j in mid_b if b[j] in shared]
    places: dict = {}
    for j, at in enumerate(pb):
        places.setdefault(b[at], []).append(j)
    masks = {x: _bits(js, len(pb)) for x, js in places.items()}
    full = (1 << len(pb)) - 1

    def rows(first: int, row: int, upto: int) -> list[int]:
        out = [row]
        for i in range(first, upto):
            grown = row & masks[a[pa[i]]]
            row = ((row + grown) | (row - grown)) & full
            out.append(row)
        return out

    step = max(1, int(len(pa) ** 0.5))
    kept = [full]
    for first in range(0, len(pa), step):
        kept.append(rows(first, kept[-1], min(first + step, len(pa)))[-1])
    middle, col = [], len(pb)
    for part in range(len(kept) - 2, -1, -1):
        first = part * step
        own = rows(first, kept[part], min(first + step, len(pa)))
        for i in range(len(own) - 1, 0, -1):
            while col and own[i] >> (col - 1) & 1:
                col -= 1
            if not col:
                break
            if own[i - 1] >> (col - 1) & 1:  # the length grows here with this row: a match
                col -= 1
                middle.append((pa[first + i - 1], pb[col]))
        if not col:
            break
    return [*ends[0], *reversed(middle), *ends[1]]


def _bits(positions: list[int], size: int) -> int:
    """An integer with the given bits set, in time linear in its size."""
    data = bytearray(size // 8 + 1)
    for p in positions:
        data[p >> 3] |= 1 << (p & 7)
    return int.from_bytes(data, "little")
