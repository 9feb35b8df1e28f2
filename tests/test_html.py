import random

import pytest
from pyspark.sql import functions as F

from tarn.functions import html, urls
from tarn.functions.html import BLOCKS, description, links, strip_tags, title


def one(spark, expression):
    return spark.range(1).select(expression).first()[0]


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<p>Hello <b>world</b>!</p><p>Second .</p>", "Hello world! Second."),
        ("a<!-- x -->b", "ab"),
        ("x<script>var a = 1 < 2;</script>y", "x y"),
        ("x<script>never ends", "x"),
        ("<nav>menu</nav>body<footer>f</footer>", "body"),
        ("x</nav>lost<nav>", "x"),
        ("a<svg/>b", "a b"),
        ("<SCRIPT>a</script >b", "b"),
        ("a < b", "a"),
        ("&amp; <i>x</i>", "& x".replace("&", "&amp;")),
        ("", ""),
        ("<template>t</template><aside>s</aside><style>c</style><head><title>t</title></head>z", "z"),
    ],
)
def test_strip(spark, page, expected):
    assert one(spark, strip_tags(F.lit(page))) == expected


def test_script_with_return_is_no_block(spark):
    assert one(spark, strip_tags(F.lit("<script\r>a</script>b"))) == "a"


def test_title_and_description(spark):
    page = '<TITLE id=1> A &amp;\n B </title><title>C</title><meta name="description"><meta content="x" name="other"><META NAME=\'description\' content="  two  words ">'
    assert one(spark, title(F.lit(page))) == "A &amp; B"
    assert one(spark, title(F.lit("<p>none</p>"))) == ""
    page = page.replace("NAME=", "name=")
    assert one(spark, description(F.lit(page))) == "two words"
    assert one(spark, description(F.lit("<meta name='description'>"))) == ""


def test_links(spark):
    page = '<a href="/a">1</a><a href="b?x=1">2</a><A class=c HREF=\'http://o/z\'>3</A><a href="//h/p">4</a><a href="mailto:x@y">5</a><a name="n">6</a><ahref="/no">7</a><a href="">8</a>'
    got = one(spark, links(F.lit(page), F.lit("https://host.example/dir/page?q")))
    assert got == ["https://host.example/a", "https://host.example/dir/b?x=1", "http://o/z", "https://h/p"]
    assert one(spark, links(F.lit('<a href="x">'), F.lit("http://host"))) == ["http://host/x"]
    assert one(spark, links(F.lit('<a href="/x">'), F.lit("ftp://host"))) == []


def test_documents_of(spark):
    pages = spark.createDataFrame([("http://a.onion/x", "<title></title>text"), ("http://h/x.onion", "<title>T</title>"), ("http://h/", None), (None, "x")], "url string, html string")
    got = {r.url: (r.title, r.content, r.source) for r in html.documents_of(pages).collect()}
    assert got == {"http://a.onion/x": ("http://a.onion/x", "text", "onion"), "http://h/x.onion": ("T", "T", "onion")}


def test_very_long_page(spark):
    page = "<div>" * 20_000 + "x" * 500_000 + "</div>" * 20_000
    df = spark.createDataFrame([(page,)], "h string")
    assert df.select(F.length(strip_tags("h"))).first()[0] == 500_000


def test_url_functions(spark):
    cases = {
        "HTTP://Host.EX:80/P?q": ("Host.EX:80", "HTTP://host.ex:80", "/P"),
        "http://h": ("h", "http://h", "/"),
        "http://h?x/y": ("h", "http://h", "/"),
        "nohost/x": ("nohost/x", "", "/"),
        "": ("", "", "/"),
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    got = {r[0]: tuple(r[1:]) for r in df.select("u", urls.domain_of("u"), urls.origin_of("u"), urls.path_of("u")).collect()}
    assert got == cases
    for text, expected in (("  a.b ", "http://a.b"), ("https://x", "https://x"), ("HTTP://x", "http://HTTP://x"), (" \t", "")):
        assert one(spark, urls.normalize_url(F.lit(text))) == expected


def test_strip_fuzz_against_a_scanner(spark):
    """A scanner written from the rules, on short random pages of markup pieces."""

    def scan(page):
        out, i, low = [], 0, page.lower()
        while i < len(page):
            if page[i] != "<":
                out.append(page[i])
                i += 1
                continue
            if page.startswith("<!--", i):
                end = page.find("-->", i + 4)
                i = len(page) if end < 0 else end + 3
                continue
            close = page.find(">", i)
            end = len(page) if close < 0 else close + 1
            at = i + 1 + (low.startswith("/", i + 1))
            stop = at
            while stop < len(page) and page[stop] not in " \t\n>/":
                stop += 1
            name = low[at:stop]
            whole = page[i:end]
            if name in BLOCKS and not (whole.endswith("/>") and close >= 0):
                j = end
                while True:
                    j = low.find(f"</{name}", j)
                    if j < 0:
                        end = len(page)
                        break
                    after = j + 2 + len(name)
                    if after >= len(page) or page[after] in " >/\t\n":
                        close = page.find(">", after)
                        end = len(page) if close < 0 else close + 1
                        break
                    j = after
            out.append("\x00")
            i = end
        text = "".join(out)
        import re

        text = re.sub(" ?\x00+", " ", text)
        text = re.sub(r" ([!-/:-@\[-`{-~])", r"\1", text)
        return re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ")

    random.seed(11)
    pieces = ["a", "b ", " c", ".", " !", "\n", "<p>", "</p>", "<br/>", "<script>", "</script>", "<nav id=x>", "</nav>", "<!-- k -->", "<svg/>", "<header>", "</header >", "<head>", "</head>", "x<y>", "<B>", "</b>"]
    pages = ["".join(random.choice(pieces) for _ in range(random.randint(0, 14))) for _ in range(1500)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string")
    got = {r.i: r.t for r in df.select("i", strip_tags("h").alias("t")).collect()}
    bad = [(p, got[i], scan(p)) for i, p in enumerate(pages) if got[i] != scan(p)]
    assert not bad, bad[:3]
