import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.llm import main_body
from tarn.llm.blocks import block_key, common_subsequence, page_blocks, site_pattern

FETCH = "fetch_id long, url string, ok boolean, html string, error string"


def words(rng, n):
    return " ".join("".join(rng.choice("abdegiklmnorstu") for _ in range(rng.randint(3, 9))) for _ in range(n))


def page(rng, host, i, with_byline=True):
    body = [words(rng, 25) + "." for _ in range(rng.randint(2, 5))]
    related = [f"Other title {words(rng, 2)}" for _ in range(3)]
    name = host.split(".")[0].capitalize()
    html = (
        "<html><head><title>t</title></head><body><div class=nav><a href='/x'>Home</a> | <a href='/y'>About us</a></div>"
        f"<div class='main'><h1>Headline {words(rng, 2)}</h1>"
        + (f"<p>Written by {name} on {rng.randint(1, 28)}.{rng.randint(1, 12)}.2024</p>" if with_byline else "")
        + "".join(f"<p>{b[:20]}<b>{b[20:]}</b>" for b in body)
        + "<h2>Notes</h2><table><tr><td>12<td>34 ms</table></div><div class=more><h3>More</h3><ul>"
        + "".join(f"<li><a href='/r'>{r}</a>" for r in related)
        + f"</ul></div><div class=foot><p>All rights of {name} reserved.</p><script>var x='<p>no</p>'</script></div></body></html>"
    )
    heading = html.split("<h1>")[1].split("</h1>")[0]
    return html, {heading, *body, "Notes", "12", "34 ms"}


@pytest.fixture(scope="module")
def site(spark):
    rng, rows, truth = random.Random(5), [], {}
    for h in ("alpha.example", "WWW.Betaville.test:80", "gamma.invalid", "lonely.example"):
        for i in range(1 if h.startswith("lonely") else 45):
            html, truth[len(rows)] = page(rng, h.lower().replace("www.", ""), i, rng.random() < 0.7)
            rows.append((len(rows), f"http://{h}/d/{i}", True, html, ""))
    base = len(rows)
    for j in range(300):  # one url fetched over and over
        html, truth[base + j] = page(rng, "alpha.example", j)
        rows.append((base + j, "http://alpha.example/d/7", True, html, ""))
    return rows, truth, spark.createDataFrame([*rows, *rows[:20], (9000, "http://a.example/", False, None, "x"), (9001, "http://a.example/", True, "", ""), (9002, None, True, "<p>x</p>", "")], FETCH)


def test_bodies(site):
    rows, truth, df = site
    got = {}
    for r in main_body.found_blocks(df).collect():
        got.setdefault(r.fetch_id, set()).add(r.block)
    lonely = {r[0] for r in rows if "lonely" in r[1]}
    assert set(got) == set(truth)
    wrong = [i for i in truth if got[i] != truth[i] and i not in lonely]
    assert not wrong, (got[wrong[0]] ^ truth[wrong[0]], len(wrong))
    # a page alone in its host: what other hosts share is known
    assert all(not b.startswith("Written by") for i in lonely for b in got[i])


def test_texts_are_in_order(site):
    rows, truth, df = site
    texts = {r.fetch_id: r.body for r in main_body.body_texts(df.where("fetch_id < 30")).collect()}
    assert texts[3].split("\n")[0].startswith("Headline") and texts[3].split("\n")[-2:] == ["12", "34 ms"]


def test_empty(spark):
    assert main_body.found_blocks(spark.createDataFrame([], FETCH)).count() == 0
    one = spark.createDataFrame([(1, "http://h/", True, "only text &amp; more", None), (2, "nohost", True, "<p></p>", None)], FETCH)
    assert [tuple(r) for r in main_body.found_blocks(one).collect()] == [(1, "only text &amp; more")]


def test_blocks():
    html = "<!-- c --><style>x</style><DIV id=a>one <A href=x>link</A>ed<br>two<table class=t><tr><td>c1<td class=s>c2</table>&lt;</div>end<script>never"
    got = [(b.text, b.tag, b.place.replace("\x1f", "/")) for b in page_blocks(html)]
    assert got == [("one linked", "div", "div.a"), ("two", "br", "div.a"), ("c1", "td", "div.a/table.t"), ("c2", "td", "div.a/table.t/td.s"), ("&lt;", "", "div.a"), ("end", "", "")]
    assert page_blocks("") == [] and page_blocks("<p>a<!-- x -->b</p>")[0].text == "ab"
    assert [b.free for b in page_blocks("<p>ab<a>cd</a></p><p><a>xy</a></p>")] == [2, 0]


def test_keys():
    name = site_pattern("www.lumenquarry.example")
    assert block_key("By  LUMEN Quarry, 2024-01-02 (33)", name) == block_key("by Lumenquarry, 1.2.2025 (4)", name)
    assert site_pattern("a.b") is None


def test_common_subsequence():
    assert common_subsequence(list("abcbdab"), list("bdcaba")) and len(common_subsequence(list("abcbdab"), list("bdcaba"))) == 4
    assert common_subsequence([], [1]) == [] and common_subsequence([1, 2], [3]) == []
    assert common_subsequence([1, 1, 2], [1, 2]) in ([(0, 0), (2, 1)], [(1, 0), (2, 1)])


def longest(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 5), max_size=25))
def test_common_subsequence_is_longest(a, b):
    got = common_subsequence(a, b)
    assert len(got) == longest(a, b) and all(a[i] == b[j] for i, j in got)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


def test_common_subsequence_of_long_pages():
    a, b = list(range(50_000)), list(range(50_000))
    random.Random(1).shuffle(b)
    began = time.time()
    assert len(common_subsequence(a, b)) > 300 and len(common_subsequence([1] * 50_000, [1] * 40_000)) == 40_000
    assert time.time() - began < 20


def test_page_of_many_blocks(spark):
    rng = random.Random(2)
    foot = "".join(f"<p>share {words(rng, 2)} {chr(97 + i % 26)}{i // 26}x</p>" for i in range(3000))
    rows = [(i, f"http://long.example/{i}", True, f"<div class=m><p>{words(rng, 30)}</p></div><div class=f>{foot}</div>", "") for i in range(4)]
    got = main_body.found_blocks(spark.createDataFrame(rows, FETCH)).collect()
    assert {(r.fetch_id, r.block) for r in got} == {(r[0], r[3].split("<p>")[1].split("</p>")[0]) for r in rows}


def test_body_doesnt_depend_on_urls_far_ahead(spark):
    """Urls before others in order shift the groups and change no verdict."""
    rng, rows, truth = random.Random(7), [], {}
    for i in range(40):
        html, truth[i] = page(rng, "shifted.example", i)
        rows.append((i, f"http://shifted.example/m/{i:02}", True, html, ""))
    ahead = [(100 + i, f"http://shifted.example/a/{i:02}", True, page(rng, "shifted.example", i)[0], "") for i in range(11)]
    one = {tuple(r) for r in main_body.found_blocks(spark.createDataFrame(rows, FETCH)).where("fetch_id between 5 and 40").collect()}
    two = {tuple(r) for r in main_body.found_blocks(spark.createDataFrame(rows + ahead, FETCH)).where("fetch_id between 5 and 40").collect()}
    assert one == two == {(i, b) for i in range(5, 40) for b in truth[i]}


def test_copies_under_neighbouring_urls(spark):
    rng, rows, truth = random.Random(6), [], {}
    for i in range(12):
        html, blocks = page(rng, "copies.example", i)
        for j in range(9 if i == 5 else 1):
            truth[len(rows)] = blocks
            rows.append((len(rows), f"http://copies.example/d/{i:02}{f'?print={j}' if j else ''}", True, html, ""))
    got = {}
    for r in main_body.found_blocks(spark.createDataFrame(rows, FETCH)).collect():
        got.setdefault(r.fetch_id, set()).add(r.block)
    assert all(got[k] == truth[5] for k in range(5, 14))
