"""Site of a url, lines of a text: the pieces that several problems share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def site(url: Column | str) -> Column:
    """Host of a url in lower case, without user and port; null for null, '' where there is none."""
    col = F.col(url) if isinstance(url, str) else url
    authority = F.regexp_extract(col, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))


def lines(text: Column | str) -> Column:
    """The text split at \\n; null gives an empty array."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.split(col, "\n", -1), F.array().cast("array<string>"))


def line_key(line: Column) -> Column:
    """Lower case, each run of digits one 0, white space collapsed and trimmed."""
    digits = F.regexp_replace(F.lower(line), r"(?U)\d+", "0")
    return F.trim(F.regexp_replace(digits, r"(?U)[\s\x1c-\x1f]+", " "))
