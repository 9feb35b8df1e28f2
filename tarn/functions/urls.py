"""Parts and classes of urls, as the crawler sees them: raw strings, nothing normalised."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that hold in Java's and RE2's syntax alike.
AFTER_SCHEME = r"^[\s\S]*?://([\s\S]*)$"
DOMAIN = r"^(?:[\s\S]*?://)?([^/?#]*)"
ORIGIN = r"^([\s\S]*?)://([^/?#]+)"
PATH = r"^[\s\S]*?://[^/?#]*(/[^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def domain_of(url: Column | str) -> Column:
    """Between :// and the first of / ? #, case and port kept; from the start where there is no ://."""
    return F.when(_c(url).contains("://"), F.regexp_extract(_c(url), DOMAIN, 1)).otherwise(_c(url))


def origin_of(url: Column | str) -> Column:
    """scheme://host:port, the host in ASCII lower case; '' without scheme or host."""
    scheme, host = F.regexp_extract(_c(url), ORIGIN, 1), F.regexp_extract(_c(url), ORIGIN, 2)
    return F.when((scheme != "") & (host != ""), F.concat(scheme, F.lit("://"), F.translate(host, UPPER, LOWER))).otherwise(F.when(_c(url).isNotNull(), ""))


def path_of(url: Column | str) -> Column:
    """From the first / after :// to ? or #; '/' where there is none."""
    path = F.regexp_extract(_c(url), PATH, 1)
    return F.when(path == "", "/").otherwise(path)


def is_robots_url(url: Column | str) -> Column:
    return _c(url).contains("robots.txt")


def is_onion(url: Column | str) -> Column:
    """.onion anywhere: the routing test."""
    return _c(url).contains(".onion")


def source_of(url: Column | str) -> Column:
    """onion where .onion occurs after ://, path included; else clearweb."""
    return F.when(F.coalesce(F.regexp_extract(_c(url), AFTER_SCHEME, 1), F.lit("")).contains(".onion"), "onion").otherwise("clearweb")


def normalize_url(text: Column | str) -> Column:
    """Trimmed; http:// in front unless it starts with http:// or https:// (as spelled); '' if blank."""
    t = F.regexp_replace(_c(text), r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")
    return F.when(t == "", "").when(t.startswith("http://") | t.startswith("https://"), t).otherwise(F.concat(F.lit("http://"), t))
