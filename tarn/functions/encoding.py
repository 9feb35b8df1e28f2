"""Escapes and encodings of the serving surface."""

from __future__ import annotations

import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters with an entity of their own, & first.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def escape_html(text: Column | str) -> Column:
    out = _c(text)
    for char, entity in ENTITIES:
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def url_decode(text: Column | str) -> Column:
    """+ to space and %XX decoded; null where malformed."""
    return F.try_url_decode(_c(text))


def query_param(query: Column | str, name: str) -> Column:
    """Raw value of the first name= pair of a query string; '' if none."""
    return F.regexp_extract(_c(query), rf"(?:^|[?&]){name}=([^&#]*)", 1)


def to_base64url(data: Column | str) -> Column:
    """URL-safe base64 without padding, of binary or string."""
    return F.translate(F.regexp_replace(F.base64(_c(data).cast("binary")), r"[=\r\n]", ""), "+/", "-_")


def from_base64url(text: Column | str) -> Column:
    """Binary; both alphabets, characters outside them skipped."""
    plain = F.regexp_replace(F.translate(_c(text), "-_", "+/"), r"[^A-Za-z0-9+/]", "")
    n = F.length(plain)
    kept = F.substring(plain, F.lit(1), n - F.when(n % 4 == 1, 1).otherwise(0))
    pad = F.when(F.length(kept) % 4 == 0, "").when(F.length(kept) % 4 == 2, "==").otherwise("=")
    return F.unbase64(F.concat(kept, pad))


def random_bytes(n: int) -> bytes:
    return secrets.token_bytes(n)


def random_hex(n: int) -> str:
    """n random bytes in lower-case hex."""
    return secrets.token_hex(n)


def to_base32(data: bytes) -> str:
    """Lower-case base32 without padding, as in the names of hidden services."""
    import base64

    return base64.b32encode(data).decode().rstrip("=").lower()


def from_base32(text: str) -> bytes:
    """Bytes of to_base32(), either case; ValueError for other characters."""
    import base64

    return base64.b32decode(text.upper() + "=" * (-len(text) % 8))


def passphrase(n: int = 16) -> str:
    """A random passphrase of n characters, 8 at least."""
    alphabet = "abcdefghijkmnpqrstuvwxyz23456789"
    return "".join(secrets.choice(alphabet) for _ in range(max(8, n)))
