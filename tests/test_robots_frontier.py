import http.server
import socket
import threading
import time
from typing import ClassVar

import pytest
from pyspark.sql import functions as F

from tarn.functions.urls import domain_of
from tarn.operators import frontier, netpolicy, robots
from tarn.operators.frontier import CrawlOptions, admit, crawl, in_order, reachable, schedule
from tarn.sources.pages import HttpSource, StubSource, TableSource, is_transient, probe_socks

OFFER = "url string, depth int, priority int, seq long"


def verdicts(spark, body, urls, agent="tarn-bot/0.1"):
    rules = robots.parse_robots(spark.createDataFrame([("http://h", body)], "origin string, body string"), agent)
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: r.allowed for r in robots.allowed(df, rules).collect()}
    return [got[u] for u in urls]


def test_robots_rules(spark):
    assert verdicts(spark, "User-agent: *\nDisallow: /p\n", ["http://h/p/x", "http://h/q", "http://other/p"]) == [False, True, True]
    assert verdicts(spark, "User-agent: *\nDisallow: /p\nAllow: /p/ok # yes\n", ["http://h/p/ok", "http://h/p"]) == [True, False]
    assert verdicts(spark, "User-agent: *\nDisallow:\n", ["http://h/"]) == [True]
    assert verdicts(spark, None, ["http://h/p"]) == [True]
    assert verdicts(spark, "User-agent: otherbot\nDisallow: /\n", ["http://h/p"]) == [True]
    assert verdicts(spark, "User-agent: *\nDisallow: /a\nAllow: /a\n", ["http://h/a"]) == [True]
    assert verdicts(spark, "User-agent: *\nUser-agent: otherbot\nDisallow: /\n", ["http://h/p"]) == [True]
    assert verdicts(spark, "User-agent: *\nDisallow: /p\n", ["http://H/p?x=/q"]) == [False]
    assert verdicts(spark, "USER-AGENT : TARN-BOT\r\ndisallow : /p\r\n", ["http://h/p"]) == [False]


def test_origins_load_once(spark):
    df = spark.createDataFrame([("http://h/a",), ("http://h/b",), ("x",), (None,)], "url string")
    assert [r.robots_url for r in robots.origins_to_load(df).collect()] == ["http://h/robots.txt"]
    assert robots.origins_to_load(df, robots.origins_to_load(df)).count() == 0
    rules = robots.parse_robots(spark.createDataFrame([("http://h", "User-agent: *\nDisallow: /x")], "origin string, body string"))
    assert tuple(robots.cache_stats(rules, spark.createDataFrame([("http://h",), ("http://g",)], "origin string")).first()) == (2, 1)


def test_order_priority_then_arrival(spark):
    df = spark.createDataFrame([("a", 0, 10, 1), ("b", 0, 0, 2), ("c", 5, -1, 3), ("d", None, None, 4)], OFFER)
    assert [r.url for r in in_order(df).orderBy("position").collect()] == ["b", "d", "c", "a"]


def test_admission(spark):
    df = spark.createDataFrame([("a", 0, -1, 1), ("a", 0, -1, 2), ("b", 0, -1, 3), ("c", 0, -1, 4), (None, 0, 0, 0), ("", 0, 0, 5)], OFFER)
    assert [r.url for r in admit(df, room=2).collect()] == ["a", "b"]
    seen = spark.createDataFrame([("a",)], "url string")
    assert {r.url for r in admit(df, seen).collect()} == {"b", "c", ""}
    assert admit(df, room=0).count() == 0


def test_schedule_per_domain(spark):
    df = spark.createDataFrame([("http://h/1", 0, 5, 1), ("http://h/2", 0, 1, 2), ("http://g/1", 0, 0, 3), ("http://h/3", 0, 5, 0)], OFFER)
    assert {r.url: r.wait_ms for r in schedule(df, 100).collect()} == {"http://h/2": 0, "http://h/3": 100, "http://h/1": 200, "http://g/1": 0}
    small = frontier.schedule_small(df, 100)
    assert {r.url: r.wait_ms for r in small.collect()} == {r.url: r.wait_ms for r in schedule(df, 100).collect()}


def test_stub_crawls(spark):
    seed = spark.createDataFrame([("http://h.example/",)], "url string")
    one = crawl(seed, StubSource(), CrawlOptions(max_depth=1))
    assert one.docs.count() == 4 and one.crawled == 4
    two = crawl(seed, StubSource())
    assert two.docs.select("url").distinct().count() == 6
    assert crawl(seed, StubSource(), CrawlOptions(strict_break=True)).docs.count() == 6
    assert crawl(seed, StubSource(), CrawlOptions(max_pages=2)).crawled == 2
    assert {r.source for r in crawl(spark.createDataFrame([("http://h.onion/",)], "url string"), StubSource(), CrawlOptions(max_depth=0)).docs.collect()} == {"onion"}


def test_blocked_and_failed_count(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://h/robots.txt", True, "User-agent: *\nDisallow: /no", ""),
            (2, "http://h/", True, '<a href="/no">n</a><a href="/gone">g</a>', ""),
            (3, "http://h/no", True, "x", ""),
        ],
        "fetch_id long, url string, ok boolean, html string, error string",
    )
    done = crawl(spark.createDataFrame([("http://h/",)], "url string"), TableSource(pages))
    assert done.crawled == 3 and done.counts == {"indexed": 1, "blocked": 1, "failed": 1}
    assert {r.kind for r in done.activity.collect()} == {"indexed", "blocked", "failed"}


def test_strict_break_differs(spark):
    page = '<a href="/a">1</a><a href="/a">2</a><a href="/b">3</a>'
    pages = spark.createDataFrame([(1, "http://h/", True, page, "")], "fetch_id long, url string, ok boolean, html string, error string")
    seed = spark.createDataFrame([("http://h/",)], "url string")
    assert crawl(seed, TableSource(pages), CrawlOptions(obey_robots=False)).seen.count() == 3
    assert crawl(seed, TableSource(pages), CrawlOptions(obey_robots=False, strict_break=True)).seen.count() == 2


def test_reachable_with_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = {r.url: r.depth for r in reachable(edges, spark.createDataFrame([("a",)], "url string"), 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_empty_tables(spark):
    none = spark.createDataFrame([], OFFER)
    assert in_order(none).count() == 0 and schedule(none).count() == 0 and admit(none).count() == 0
    assert crawl(none, StubSource()).crawled == 0


def test_transient_errors(spark):
    given = ["Could not connect: x", "status 404", None, "timed out", "proxy error: x", "HTTP/2 error", "empty answer", "tls error: x"]
    df = spark.createDataFrame([(e,) for e in given], "e string")
    assert [r[0] for r in df.select(is_transient("e")).collect()] == [True, False, False, True, True, True, False, False]
    assert df.where(F.lit(False)).count() == 0


def test_callbacks_and_stop(spark):
    told = []
    seed = spark.createDataFrame([("http://h.example/",)], "url string")
    done = crawl(seed, StubSource(), on_level=lambda docs, events: told.append((docs.count(), events.count())))
    assert told == [(1, 1), (3, 3), (2, 2)] and done.crawled == 6
    assert crawl(seed, StubSource(), stopped=lambda: True).crawled == 1


def test_http_source_reports_errors(spark):
    df = spark.createDataFrame([("http://127.0.0.1:9/x",), ("nonsense",), (None,), ("http://x.onion/",)], "url string")
    got = {r.url: (r.ok, r.html, r.error.split(":")[0]) for r in HttpSource(timeout_s=0.5, retries=0)(df).collect()}
    assert got == {"http://127.0.0.1:9/x": (False, None, "could not connect"), "nonsense": (False, None, "unsupported address nonsense"), "http://x.onion/": (False, None, "unsupported address")}


class Pages(http.server.BaseHTTPRequestHandler):
    """A site of this machine: what was asked when, large pages, redirects, one that fails at first."""

    asked: ClassVar[list] = []

    def do_GET(self):
        Pages.asked.append((self.path, time.monotonic()))
        if self.path.startswith("/hop"):
            n = int(self.path[4:])
            self.send_response(302)
            self.send_header("Location", f"/hop{n - 1}" if n else "/page")
            self.end_headers()
            return
        if self.path == "/none":
            self.send_error(404)
            return
        if self.path == "/shaky" and sum(p == "/shaky" for p, _ in Pages.asked) == 1:
            self.connection.close()
            return
        body = b"<title>Page</title>" + b"x" * ((9 << 20) if self.path == "/large" else 10)
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def site():
    Pages.asked.clear()
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_http_pages_are_whole_and_redirects_bounded(spark, site):
    df = spark.createDataFrame([(site + p,) for p in ("/page", "/large", "/hop4", "/hop9", "/none", "/shaky")], "url string")
    got = {r.url.removeprefix(site): r for r in HttpSource(timeout_s=20)(df).collect()}
    assert got["/page"].ok and got["/hop4"].ok and got["/shaky"].ok and len(got["/large"].html) == (9 << 20) + 19
    assert (got["/hop9"].error, got["/none"].error) == ("too many redirects", "status 404")
    assert sum(p == "/none" for p, _ in Pages.asked) == 1  # a server's answer isn't asked for again


def test_crawl_keeps_its_distance(spark, site):
    seeds = spark.createDataFrame([(f"{site}/p{i}",) for i in range(4)], "url string")
    done = crawl(seeds, HttpSource(), CrawlOptions(max_depth=0, domain_delay_ms=300, obey_robots=False))
    at = sorted(t for _, t in Pages.asked)
    assert done.counts["indexed"] == 4 and all(b - a > 0.25 for a, b in zip(at, at[1:], strict=False))


def socks_server(seen, refuse=False):
    """One that answers SOCKS5 and then plays the web server itself."""
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        while True:
            try:
                c, _ = server.accept()
            except OSError:
                return
            if refuse:
                c.close()
                continue
            c.recv(4)
            c.sendall(b"\x05\x02")
            user = c.recv(600)
            if len(user) > 2:  # a probe goes after the greeting
                c.sendall(b"\x01\x00")
                asked = c.recv(600)
                seen.append((user[2 : 2 + user[1]].decode(), asked[5 : 5 + asked[4]].decode()))
                c.sendall(b"\x05\x00\x00\x01\x00\x00\x00\x00\x00\x00")
                c.recv(4000)
                c.sendall(b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nonion")
            c.close()

    threading.Thread(target=serve, daemon=True).start()
    return server, server.getsockname()


def test_onion_pages_by_socks(spark):
    seen = []
    server, up = socks_server(seen)
    dead, down = socks_server([], refuse=True)
    assert probe_socks(up) == "up" and probe_socks(down, 0.5) == "down"
    seen.clear()
    df = spark.createDataFrame([("http://a.onion/1",), ("http://a.onion/2",), ("http://b.onion/1",)], "url string").coalesce(1)
    got = HttpSource(proxies=[down, up], timeout_s=4)(df).collect()
    assert all(r.ok and r.html == "onion" for r in got)
    tokens = df.select(netpolicy.isolation_token("url").alias("t"), domain_of("url").alias("d")).distinct().collect()
    assert {(r.t, r.d) for r in tokens} == set(seen) and len(set(seen)) == 2
    server.close()
    dead.close()
