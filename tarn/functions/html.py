"""Title, description, text and links of a page, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.urls import source_of

# Elements that go with their contents.
BLOCKS = ("script", "style", "noscript", "template", "svg", "head", "nav", "footer", "header", "aside")


def _block(name: str) -> str:
    return rf"<\/?{name}(?:[ \t\n](?:[^>]*[^\/>])?|\/[^>]*[^\/>])?(?:>(?:[\s\S]*?(?:<\/{name}(?:[ \t\n\/][^>]*)?(?:>|\z)|\z))|\z)"


TAG = r"<[^>]*(?:>|\z)"
BLOCK = "|".join(map(_block, BLOCKS))
COMMENT_OR_MARKUP = rf"(?i)<!--[\s\S]*?(?:-->|\z)|({BLOCK}|{TAG})"
MARKUP = rf"(?i)(?:{BLOCK}|{TAG})"
MARK = "￾"  # a noncharacter that stands for one piece of markup
SPACE_PUNCTUATION = r" ([!-/:-@\[-`{-~])"
SPACES = r"[ \t\n\x0B\f\r]+"
TITLE = r"(?i)<title[^>]*>([\s\S]*?)</title>"
META = r"(?i)<meta[^>]*>"
META_NAME = r"(?i)name=(\"description\"|'description')"
ANCHOR = r"(?i)<a ([^>]*)>"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _attribute(name: str) -> str:
    """The value after name= : whatever character follows delimits it."""
    return rf"^(?:(?!(?i:{name}=))[\s\S])*?(?i:{name}=)([\s\S])([\s\S]*?)\1"


def collapse(text: Column | str) -> Column:
    """Runs of ASCII white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(_c(text), SPACES, " "))


def title(html: Column | str) -> Column:
    """First title, collapsed, references left as written; '' if none."""
    return collapse(F.regexp_extract(_c(html), TITLE, 1))


def description(html: Column | str) -> Column:
    """Content of the first meta named description that has any; '' if none."""
    metas = F.filter(F.regexp_extract_all(_c(html), F.lit(META), F.lit(0)), lambda m: m.rlike(META_NAME) & m.rlike("(?i)content="))
    return F.coalesce(collapse(F.regexp_extract(F.try_element_at(metas, F.lit(1)), _attribute("content"), 2)), F.lit(""))


def strip_tags(html: Column | str) -> Column:
    """Text of a page: comments vanish, markup and the BLOCKS with contents become one space, one
    space before ASCII punctuation goes, white space collapses."""
    bare = F.regexp_replace(_c(html), COMMENT_OR_MARKUP, "$1")
    marked = F.regexp_replace(F.regexp_replace(bare, MARKUP, MARK), f" ?{MARK}+", " ")
    return collapse(F.regexp_replace(marked, SPACE_PUNCTUATION, "$1"))


def resolve(link: Column, base: Column) -> Column:
    """A link as an absolute url, null where it is dropped. No folding of .., no fragment removal."""
    scheme = F.regexp_extract(base, r"^(https?)://", 1)
    origin = F.regexp_extract(base, r"^(https?://[^/?#]*)", 1)
    directory = F.regexp_extract(base, r"^https?://[^/?#]*(/(?:[^?#]*/)?)", 1)
    return (
        F.when(link.startswith("http://") | link.startswith("https://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.contains(":"), F.lit(None).cast("string"))
        .when(link.startswith("/"), F.concat(origin, link))
        .otherwise(F.concat(origin, F.when(directory == "", "/").otherwise(directory), link))
    )


def links(html: Column | str, base: Column | str) -> Column:
    """array<string> of the resolved links in order, repeats kept; [] unless the base is http(s)."""
    b = _c(base)
    raw = F.transform(F.regexp_extract_all(_c(html), F.lit(ANCHOR), F.lit(1)), lambda x: F.regexp_extract(F.concat(F.lit(" "), x), _attribute("href"), 2))
    resolved = F.filter(F.transform(F.filter(raw, lambda x: x != ""), lambda x: resolve(x, b)), lambda x: x.isNotNull())
    return F.when(b.startswith("http://") | b.startswith("https://"), resolved).otherwise(F.array().cast("array<string>"))


def documents_of(pages: DataFrame, url: str = "url", html: str = "html", depth: str | None = None) -> DataFrame:
    """url, title (the url where it is empty), snippet, content, source, depth of fetched pages.

    Rows with a null url or null html are left out."""
    rows = pages.where(F.col(url).isNotNull() & F.col(html).isNotNull())
    own = title(html)
    return rows.select(
        F.col(url).alias("url"),
        F.when(own == "", F.col(url)).otherwise(own).alias("title"),
        description(html).alias("snippet"),
        strip_tags(html).alias("content"),
        source_of(url).alias("source"),
        (F.col(depth) if depth else F.lit(0)).cast("int").alias("depth"),
    )
