"""Tokenization: a code point class and a case fold, both as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code point ranges of token characters, inclusive.
TOKEN_RANGES = (
    (0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A),
    (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0xFF), (0x100, 0x2FF),
    (0x370, 0x3FF), (0x400, 0x4FF), (0x590, 0x5FF), (0x600, 0x6FF), (0x900, 0xDFF), (0x1F00, 0x1FFF),
    (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF),
)

TOKEN_CLASS = "[" + "".join(rf"\x{{{a:04X}}}-\x{{{b:04X}}}" for a, b in TOKEN_RANGES) + "]"
TOKEN_PATTERN = f"({TOKEN_CLASS}+)"


def _fold_pairs() -> tuple[str, str]:
    """The fold as two strings for translate(): code points that change, and what they become."""
    steps = (
        (range(0x41, 0x5B), 32),
        ([c for c in range(0xC0, 0xDF) if c != 0xD7], 32),
        (range(0x100, 0x180, 2), 1),
        ([c for c in range(0x180, 0x250, 2) if not 0x1C4 <= c <= 0x1CC], 1),
        ([c for c in range(0x391, 0x3AA) if c != 0x3A2], 32),
        (range(0x410, 0x430), 32),
    )
    pairs: dict[int, int] = {}
    for points, shift in steps:
        for c in points:
            pairs.setdefault(c, c + shift)
    return "".join(map(chr, pairs)), "".join(map(chr, pairs.values()))


FOLD_FROM, FOLD_TO = _fold_pairs()


def fold(text: Column | str) -> Column:
    """Case fold by the fixed table; unlike lower() it leaves code points outside the table alone."""
    return F.translate(F.col(text) if isinstance(text, str) else text, FOLD_FROM, FOLD_TO)


def tokenize(text: Column | str) -> Column:
    """array<string> of folded tokens in order, repeats kept; null text gives an empty array."""
    folded = fold(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return F.regexp_extract_all(folded, F.lit(TOKEN_PATTERN), F.lit(1))


def tokenize_bytes(data: Column | str) -> Column:
    """tokenize() for binary input: malformed sequences become U+FFFD, which separates tokens."""
    col = F.col(data) if isinstance(data, str) else data
    return tokenize(F.make_valid_utf8(col.cast("string")))


def query_terms(text: Column | str) -> Column:
    """Distinct tokens in byte order."""
    return F.array_sort(F.array_distinct(tokenize(text)))


def _python_class() -> str:
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in TOKEN_RANGES) + "]+"


def tokenize_local(text: str | None) -> list[str]:
    """The same tokens for a short query string on the driver."""
    import re

    return re.findall(_python_class(), (text or "").translate(dict(zip(map(ord, FOLD_FROM), FOLD_TO, strict=True))))
