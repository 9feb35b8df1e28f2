"""The engine: search, crawl, status, save and load over one index version at a time."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import jsonio
from tarn.functions.encoding import escape_html
from tarn.operators import activity, frontier, rank
from tarn.operators.index import Index
from tarn.plans.session import cut
from tarn.sources import snapshot, store
from tarn.sources.pages import PageSource, StubSource

MAX_QUERY_BYTES = 256
ENVELOPE_HITS = 20
_DOC = "doc_id long, url string, title string, snippet string, content string, source string, depth int"
_EVENT = "ts timestamp, kind string, url string, text string"

# Four documents to begin with: two of either source.
SEED = [
    ("https://hill.example/about", "About the hill library", "Opening hours and rooms", "The hill library keeps a public index of local papers.", "clearweb", 0),
    ("https://hill.example/search", "Searching the index", "How ranking works", "Terms of the query are matched against the index and ranked.", "clearweb", 0),
    ("http://quietpond.onion/", "Quiet pond", "A hidden onion reading room", "An onion service with a small index of essays.", "onion", 0),
    ("http://quietpond.onion/mirror", "Quiet pond mirror", "Mirror of the onion room", "The mirror holds the same essays behind onion routing.", "onion", 0),
]


def cut_bytes(text: str, most: int = MAX_QUERY_BYTES) -> str:
    """The first `most` bytes; a character cut in two is dropped."""
    return text.encode("utf-8", "surrogatepass")[:most].decode("utf-8", "ignore")


def normalize_url(text: str) -> str:
    """On the driver as functions.urls.normalize_url."""
    t = text.strip(" \t\n\v\f\r")
    return t if not t or t.startswith(("http://", "https://")) else f"http://{t}"


class Engine:
    """Holds the current version; every change replaces it whole."""

    def __init__(self, spark: SparkSession, source: PageSource | None = None, options: frontier.CrawlOptions | None = None) -> None:
        self.spark, self.source, self.options = spark, source or StubSource(), options or frontier.CrawlOptions()
        self.index = Index.build(spark.createDataFrame([], _DOC), next_id=1)
        self.events = spark.createDataFrame([], _EVENT)
        self.crawled = self.pending = 0
        self.running = False

    def seed(self) -> None:
        rows = [(i, *r) for i, r in enumerate(SEED, 1)]
        self.add(self.spark.createDataFrame(rows, "seq long, url string, title string, snippet string, content string, source string, depth int"))

    def add(self, docs: DataFrame) -> None:
        """Upsert by url. docs has seq and the document columns."""
        self._set(self.index.upsert(docs))

    def remove(self, doc_ids: list[int]) -> None:
        self._set(self.index.remove(self.spark.createDataFrame([(i,) for i in doc_ids], "doc_id long")))

    def clear(self) -> None:
        self._set(Index.empty(self.index))

    def replace_all(self, docs: DataFrame) -> None:
        fresh = Index.empty(self.index)
        self._set(fresh.upsert(docs))

    def _set(self, index: Index) -> None:
        self.index = Index(cut(index.docs), cut(index.postings), cut(index.lengths), index.next_id)

    def search(self, query: str, k: int = rank.LIMIT) -> DataFrame:
        return rank.search(self.index, query, k)

    def search_json(self, query: str) -> str:
        """query, count, results[title, url, snippet, score, source]; no hits give []."""
        q = cut_bytes(query)
        hits = self.search(q, ENVELOPE_HITS).collect()
        results = [{"title": h.title, "url": h.url, "snippet": h.snippet, "score": h.score, "source": h.source} for h in hits]
        return jsonio.dump({"query": q, "count": len(results), "results": results})

    def search_html(self, query: str) -> str:
        """A plain results page."""
        q = cut_bytes(query)
        hits = self.search(q, ENVELOPE_HITS)
        shown = hits.select(*(escape_html(F.coalesce(c, F.lit(""))).alias(c) for c in ("title", "url", "snippet", "source")), F.format_string("%.2f", "score").alias("score"), "rank").orderBy("rank").collect()
        asked = self.spark.range(1).select(escape_html(F.lit(q))).first()[0]
        rows = "".join(f'<li>[{h.source}] <b>{h.title}</b><br><a href="{h.url}">{h.url}</a><br>{h.snippet} ({h.score})</li>\n' for h in shown)
        return f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{asked}</title></head><body>\n<form><input name="q" maxlength="256" value="{asked}"></form>\n<p>{len(shown)} results</p>\n<ol>\n{rows}</ol>\n</body></html>\n'

    def crawl(self, urls: list[str], on_level: Callable[[DataFrame, DataFrame], None] | None = None, stopped: Callable[[], bool] | None = None) -> frontier.Crawl:
        """Crawl from the given addresses and index what is found; blank ones are refused. `on_level` and
        `stopped` are those of frontier.crawl()."""
        wanted = [u for u in map(normalize_url, urls) if u]
        if not wanted:
            raise ValueError("no url")
        self.running = True
        try:
            seeds = self.spark.createDataFrame([(u, 0, -1, i) for i, u in enumerate(wanted)], "url string, depth int, priority int, seq long")
            done = frontier.crawl(seeds, self.source, self.options, on_level, stopped)
        finally:
            self.running = False
        self.add(done.docs.withColumn("seq", F.monotonically_increasing_id()))
        self.crawled += done.crawled
        told = done.activity.select(F.current_timestamp().alias("ts"), "kind", "url", "text")
        self.events = cut(activity.recent(self.events.unionByName(told)))
        return done

    def status(self) -> DataFrame:
        """One row: documents, terms, average_doc_length, crawled_pages, pending_crawls, crawler_running, fetcher."""
        return self.index.stats().select(
            F.col("ndocs").alias("documents"),
            F.col("nterms").alias("terms"),
            F.col("avgdl").alias("average_doc_length"),
            F.lit(self.crawled).alias("crawled_pages"),
            F.lit(self.pending).alias("pending_crawls"),
            F.lit(self.running).alias("crawler_running"),
            F.lit(self.source.name).alias("fetcher"),
        )

    def status_json(self) -> str:
        return jsonio.dump(self.status().first().asDict())

    def dashboard(self) -> dict[str, DataFrame]:
        """Small tables: status, documents by source, recent activity."""
        return {"status": self.status(), "sources": self.index.docs.groupBy("source").count(), "activity": activity.recent(self.events)}

    def request(self, method: str, path: str, query: str = "", body: str = "") -> tuple[int, str]:
        """The JSON surface without a server: (status, body) of /search, /crawl and /status."""
        from urllib.parse import unquote_plus

        param = next((v for k, _, v in (p.partition("=") for p in query.split("&")) if k == ("q" if path == "/search" else "url")), None)
        value = unquote_plus(param) if param is not None else None
        if method == "POST" and path in ("/search", "/crawl"):
            if len(body.encode()) > 64 << 10:
                return 413, jsonio.dump({"error": "body too large"})
            parsed, wrong = jsonio.parse(body)
            if wrong or not isinstance(parsed, jsonio.Object):
                return 400, jsonio.dump({"error": "invalid JSON"})
            value = jsonio.as_string(parsed.find("q" if path == "/search" else "url"))
        if path == "/status" and method == "GET":
            return 200, self.status_json()
        if path == "/search" and method in ("GET", "POST"):
            return (200, self.search_json(value)) if value else (400, jsonio.dump({"error": "missing q"}))
        if path == "/crawl" and method in ("GET", "POST"):
            if not value or not normalize_url(value):
                return 400, jsonio.dump({"error": "missing url"})
            done = self.crawl([value])
            return 200, jsonio.dump({"queued": True, "url": normalize_url(value), "crawled": done.crawled})
        return 404, jsonio.dump({"error": "not found"})

    def save(self, path: str) -> str:
        return store.save(self.index, path)

    def load(self, path: str) -> None:
        self.index = store.load(self.spark, path)

    def save_encrypted(self, path: str, password: str) -> None:
        store.save_encrypted(self.index.docs, path, password)

    def load_encrypted(self, path: str, password: str) -> None:
        docs = cut(store.load_encrypted(self.spark, path, password))
        self._set(Index.build(docs))

    def export_snapshot(self) -> bytes:
        """The binary form; every document passes through the driver, so for interchange only."""
        rows = self.index.docs.orderBy("doc_id").toLocalIterator()
        return snapshot.serialize([snapshot.Document(r.url or "", r.title or "", r.snippet or "", r.content or "", r.source or "clearweb", r.depth or 0) for r in rows])

    def import_snapshot(self, data: bytes) -> None:
        rows = [(i, *d) for i, d in enumerate(snapshot.deserialize(data), 1)]
        self.replace_all(self.spark.createDataFrame(rows, "seq long, url string, title string, snippet string, content string, source string, depth int"))


def timed_search(engine: Engine, query: str, k: int = rank.LIMIT) -> tuple[list, float]:
    """Hits and wall milliseconds, as a shell shows them."""
    began = time.perf_counter()
    hits = engine.search(query, k).collect()
    return hits, (time.perf_counter() - began) * 1000


