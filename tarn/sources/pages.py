"""Page sources: a stub that needs no network, a table of fetched pages, and HTTP."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.urls import domain_of
from tarn.plans.session import shipped

ANSWER = "url string, ok boolean, html string, error string"
# Errors after which a fetch may be tried again.
TRANSIENT = ("could not connect", "could not resolve proxy", "timed out", "send error", "receive error", "proxy error", "http/2 error")


class PageSource(Protocol):
    name: str

    def __call__(self, urls: DataFrame) -> DataFrame:
        """url rows to (url, ok, html, error), one answer a url."""
        ...


def _stub_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"^(?:[\s\S]*?://)?([^/]*)", 1)
    return F.when(host == "", "unknown").otherwise(host)


class StubSource:
    """The same page for the same url: a title, a description, a heading, two paragraphs, three links."""

    name = "stub"

    def __call__(self, urls: DataFrame) -> DataFrame:
        url, host = F.col("url"), _stub_host(F.col("url"))
        page = F.concat(
            F.lit("<!DOCTYPE html>\n<html><head><title>Sample page of "), host, F.lit('</title>\n<meta name="description" content="Sample document for '), url,
            F.lit('."></head><body>\n<h1>'), host, F.lit("</h1>\n<p>A sample page that is always the same for its address, with text about "), host,
            F.lit(" to index.</p>\n<p>It mentions inverted index, ranking, onion services and feeds.</p>\n"
                  '<a href="/docs/a">First</a>\n<a href="/docs/b">Second</a>\n<a href="https://'), host, F.lit('/mirror">Mirror</a>\n</body></html>\n'),
        )
        robots = url.rlike(r"(?:^|[/?])robots\.txt")
        html = F.when(robots, "User-agent: *\nAllow: /\n").otherwise(page)
        return urls.where(url.isNotNull()).select("url", F.lit(True).alias("ok"), html.alias("html"), F.lit("").alias("error"))


class TableSource:
    """Answers from a table (url, ok, html, error): the latest fetch of each url; others fail.

    robots files may be given as a second table of the same form.
    """

    name = "table"

    def __init__(self, fetched: DataFrame, order: str = "fetch_id", robots: DataFrame | None = None) -> None:
        rows = fetched.where(F.col("url").isNotNull())
        newest = rows.groupBy("url").agg(F.max(order).alias(order))
        answers = rows.join(newest, ["url", order], "left_semi").dropDuplicates(["url"]).select("url", "ok", "html", "error")
        self.answers = answers if robots is None else answers.unionByName(robots.select("url", "ok", "html", "error"))

    def __call__(self, urls: DataFrame) -> DataFrame:
        own = self.answers.withColumn("_known", F.lit(True))
        found = urls.select("url").join(own, "url", "left")
        return found.select("url", F.coalesce("ok", F.lit(False)).alias("ok"), "html", F.when(F.col("_known").isNull(), "not found").otherwise(F.coalesce("error", F.lit(""))).alias("error"))


def is_transient(error: Column | str) -> Column:
    """Connection errors may be retried; answers of a server, 4xx and 5xx too, may not."""
    col = F.lower(F.col(error) if isinstance(error, str) else error)
    found = F.lit(False)
    for text in TRANSIENT:
        found = found | col.contains(text)
    return F.coalesce(found, F.lit(False))


class FetchError(Exception):
    """Why a page isn't there; the text begins with its class."""


def socks_connect(proxy: tuple[str, int], host: str, port: int, token: str, timeout_s: float):
    """A socket to host:port by way of a SOCKS5 proxy, which resolves the name.

    The token is user name and password: a proxy that isolates streams by credentials gives each
    token a circuit of its own.
    """
    import socket
    import struct

    try:
        sock = socket.create_connection(proxy, timeout_s)
    except socket.gaierror as e:
        raise FetchError(f"could not resolve proxy: {e}") from e
    except OSError as e:
        raise FetchError(f"proxy error: {e}") from e

    def take(n: int) -> bytes:
        data = b""
        while len(data) < n:
            got = sock.recv(n - len(data))
            if not got:
                raise FetchError("proxy error: closed")
            data += got
        return data

    try:
        sock.sendall(b"\x05\x02\x00\x02" if token else b"\x05\x01\x00")
        version, method = take(2)
        if version != 5 or method not in (0, 2):
            raise FetchError("proxy error: no common method")
        if method == 2:
            name = token.encode()[:255]
            sock.sendall(b"\x01" + bytes([len(name)]) + name + bytes([len(name)]) + name)
            if take(2)[1]:
                raise FetchError("proxy error: credentials refused")
        named = host.encode("idna") if not host.isascii() else host.encode()
        sock.sendall(b"\x05\x01\x00\x03" + bytes([len(named)]) + named + struct.pack(">H", port))
        _, answer, _, kind = take(4)
        if answer:
            raise FetchError(f"could not connect: proxy answer {answer}")
        take({1: 4, 4: 16}.get(kind) or take(1)[0])
        take(2)
        return sock
    except TimeoutError as e:
        sock.close()
        raise FetchError("timed out") from e
    except (OSError, FetchError) as e:
        sock.close()
        raise e if isinstance(e, FetchError) else FetchError(f"proxy error: {e}") from e


def probe_socks(proxy: tuple[str, int], timeout_s: float = 2.0) -> str:
    """up where the endpoint answers a SOCKS5 greeting, else down."""
    import socket

    try:
        with socket.create_connection(proxy, timeout_s) as sock:
            sock.sendall(b"\x05\x01\x00")
            return "up" if sock.recv(2)[:1] == b"\x05" else "down"
    except OSError:
        return "down"


class Client:
    """Fetches of one task: paced by domain, by way of a pool of proxies where there is one."""

    def __init__(self, source: HttpSource) -> None:
        self.source = source
        self.failed: dict[tuple[str, int], float] = {}
        self.turn = 0
        self.began: dict[str, float] = {}

    def endpoint(self) -> tuple[str, int] | None:
        """The next endpoint whose cooldown is over; None where there is no pool."""
        import time

        pool = self.source.proxies
        usable = [p for p in pool if time.monotonic() - self.failed.get(p, -1e9) >= self.source.cooldown_s]
        if pool and not usable:
            raise FetchError("proxy error: none is up")
        self.turn += 1
        return usable[self.turn % len(usable)] if usable else None

    def once(self, url: str, token: str) -> str:
        """The page, redirects followed."""
        from urllib.parse import urljoin, urlsplit

        for _ in range(self.source.redirects + 1):
            parts = urlsplit(url)
            if parts.scheme not in ("http", "https") or not parts.hostname:
                raise FetchError(f"unsupported address {url}")
            status, location, body = self._get(parts, token)
            if 300 <= status < 400 and location:
                url = urljoin(url, location)
                continue
            if status >= 400:
                raise FetchError(f"status {status}")
            return body.decode("utf-8", "replace")
        raise FetchError("too many redirects")

    def _get(self, parts, token: str) -> tuple[int, str | None, bytes]:
        import http.client
        import socket
        import ssl
        import time

        source = self.source
        port = parts.port or (443 if parts.scheme == "https" else 80)
        proxy = self.endpoint()
        if proxy is None and parts.hostname.endswith(".onion"):
            raise FetchError("unsupported address: an onion host needs a proxy")
        try:
            if proxy:
                sock = socks_connect(proxy, parts.hostname, port, token, source.timeout_s / 2)
            else:
                try:
                    sock = socket.create_connection((parts.hostname, port), source.timeout_s / 2)
                except TimeoutError as e:
                    raise FetchError("timed out") from e
                except OSError as e:
                    raise FetchError(f"could not connect: {e}") from e
        except FetchError as e:
            if proxy and "proxy" in str(e):
                self.failed[proxy] = time.monotonic()
            raise
        connection = http.client.HTTPConnection(parts.hostname, port, timeout=source.timeout_s)
        step = "send error"
        try:
            if parts.scheme == "https":
                sock = ssl.create_default_context().wrap_socket(sock, server_hostname=parts.hostname)
            sock.settimeout(source.timeout_s)
            connection.sock = sock
            connection.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers={"Host": parts.netloc.rpartition("@")[2], "User-Agent": source.agent})
            step = "receive error"
            answer = connection.getresponse()
            return answer.status, answer.getheader("Location"), answer.read()
        except TimeoutError as e:
            raise FetchError("timed out") from e
        except ssl.SSLError as e:
            raise FetchError(f"tls error: {e}") from e
        except (OSError, http.client.HTTPException) as e:
            raise FetchError(f"{step}: {e}") from e
        finally:
            connection.close()

    def fetch(self, url: str, domain: str, wait_ms: int) -> tuple[bool, str | None, str]:
        """(ok, html, error), not before `wait_ms` after the domain's first fetch; transient errors are
        tried again with backoff."""
        import time

        from tarn.functions.hashing import fnv1a

        first = self.began.setdefault(domain, time.monotonic())
        time.sleep(max(0.0, first + wait_ms / 1000 - time.monotonic()))
        source, error = self.source, ""
        token = f"s-{fnv1a(domain.encode()):016x}" if source.isolate else ""
        for attempt in range(source.retries + 1):
            try:
                return True, self.once(url, token), ""
            except FetchError as e:
                error = str(e)
            except ValueError as e:
                error = f"unsupported address: {e}"
            if attempt == source.retries or not any(t in error.lower() for t in TRANSIENT):
                break
            time.sleep(min(8.0, 0.25 * 2**attempt))
        return False, None, error


class HttpSource:
    """Live fetches inside tasks: up to `redirects` redirects, a status of 400 or more fails, transient
    errors (is_transient) are retried with backoff. A page is read whole.

    `urls` may have wait_ms, as a crawl's levels do: a domain's fetches then go to one task, which
    keeps their distance. `proxies` are SOCKS5 endpoints (host, port), taken in turn; one that fails
    rests for its cooldown, and each domain has circuits of its own unless `isolate` is off.
    """

    name = "http"

    def __init__(self, timeout_s: float = 10.0, retries: int = 2, agent: str = "tarn-bot/0.1", proxies: list[tuple[str, int]] | None = None, isolate: bool = True, redirects: int = 5, cooldown_s: float = 5.0) -> None:
        self.timeout_s, self.retries, self.agent, self.redirects = timeout_s, retries, agent, redirects
        self.proxies, self.isolate, self.cooldown_s = list(proxies or []), isolate, cooldown_s

    def __call__(self, urls: DataFrame) -> DataFrame:
        source = self

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            client = Client(source)
            for batch in batches:
                for url, domain, wait_ms in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    ok, html, error = client.fetch(url, domain, wait_ms)
                    yield pa.RecordBatch.from_arrays([pa.array([url]), pa.array([ok]), pa.array([html], pa.string()), pa.array([error])], names=["url", "ok", "html", "error"])

        wait = F.col("wait_ms").cast("long") if "wait_ms" in urls.columns else F.lit(0).cast("long")
        rows = urls.where(F.col("url").isNotNull()).select("url", F.coalesce(domain_of("url"), F.lit("")).alias("domain"), F.coalesce(wait, F.lit(0)).alias("wait_ms"))
        if "wait_ms" in urls.columns:
            rows = rows.repartition("domain").sortWithinPartitions("wait_ms", "url")
        return shipped(rows).mapInArrow(fetch, ANSWER)
