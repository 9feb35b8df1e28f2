"""The query suite of the search and crawl operators, over whole tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.api import Engine
from tarn.functions import encoding, html, jsonio, text, urls
from tarn.functions.text import query_terms, tokenize
from tarn.operators import activity, frontier, index, netpolicy, rank, robots, sketch
from tarn.plans.oracle import ROBOTS_BODIES, oracle_sql
from tarn.plans.session import checkpoint_dir, cut, shipped, table
from tarn.schemas import DOCS
from tarn.sources import snapshot, store
from tarn.sources.pages import StubSource, TableSource, is_transient
from tarn.streaming.ingest import event_counts

__all__ = ["flagship", "oracle_sql", "queries"]

QUERY = "the index of the archive and a mirror"


UNTITLED = {"title": None, "snippet": None}


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """documents as untitled documents of the index."""
    return table(spark, d, "documents").select("doc_id", "url", F.col("text").alias("content"), "lang", "source")


def _corpus(spark: SparkSession, d: str) -> index.Index:
    return index.Index.build(_texts(spark, d), next_id=0, **UNTITLED)


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return index.latest_versions(table(spark, d, "docs"))


def _docs_index(spark: SparkSession, d: str) -> index.Index:
    return index.Index.build(_latest(spark, d), next_id=0)


_kept: dict[tuple[str, str], str] = {}


def _stored_index(spark: SparkSession, d: str) -> index.Index:
    """The index of docs as a store keeps it, written once a session: what a search reads."""
    at = spark.sparkContext.applicationId, d
    if at not in _kept:
        path = f"{checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
        store.save(index.Index.build(_latest(spark, d)), path)
        _kept[at] = path
    return store.load(spark, _kept[at])


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 6))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(rank.search(_corpus(spark, d), "the of and"))


def tokenize_documents(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "documents").select("doc_id", tokenize("text").alias("t"))
    return tokens.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


def query_terms_of_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("seq", F.array_join(query_terms("title"), " ").alias("terms"))


def term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).postings.groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("df"))


def postings_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _docs_index(spark, d).postings.drop("dl")


def doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    return _docs_index(spark, d).lengths


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return _docs_index(spark, d).stats().withColumn("avgdl", F.round("avgdl", 6))


def term_stats(spark: SparkSession, d: str) -> DataFrame:
    return index.term_stats(_docs_index(spark, d).postings)


def postings_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _docs_index(spark, d).lookup("mirror")


def bm25_top10(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(rank.scan_top(_texts(spark, d), ["the", "of", "and"], **UNTITLED))


def bm25_many_terms(spark: SparkSession, d: str) -> DataFrame:
    from tarn.functions.text import tokenize_local

    return _rounded(rank.scan_top(_texts(spark, d), tokenize_local(QUERY), k=100, **UNTITLED))


def bm25_k1_zero(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(rank.top(_corpus(spark, d), ["mirror", "archive"], k=50, k1=0.0, b=0.0))


def bm25_all_scores(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(rank.scores(_docs_index(spark, d), ["mirror", "crawler", "spiegel"]))


def bm25_titled(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(rank.search(_stored_index(spark, d), "reading the report", k=20))


def bm25_in_language(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").where(F.lower("lang").startswith("de"))
    return _rounded(rank.top(_corpus(spark, d), ["der", "archiv"], k=20, where=own))


def page_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetched").select("fetch_id", html.title("html").alias("title"))


def page_descriptions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetched").where("html is not null").select("fetch_id", html.description("html").alias("description"))


def page_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetched").select("fetch_id", html.strip_tags("html").alias("text"))


def page_documents(spark: SparkSession, d: str) -> DataFrame:
    return html.documents_of(table(spark, d, "fetched"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetched").where("html is not null").select("fetch_id", "url", F.posexplode(html.links("html", "url")).alias("at", "link"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).select("fetch_id", F.col("at").cast("long").alias("link_no"), "link")


def link_in_degree(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).select("url", "link").distinct().groupBy("link").agg(F.count("*").alias("n"))


def link_out_degree(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).groupBy("url").agg(F.count("*").alias("n"), F.count_distinct("link").alias("n_distinct"))


def crawl_reachable(spark: SparkSession, d: str) -> DataFrame:
    edges = _links(spark, d).select(F.col("url").alias("src"), F.col("link").alias("dst")).distinct()
    seeds = table(spark, d, "fetched").select("url")
    return frontier.reachable(edges, seeds, 2)


def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    own = index.with_stable_ids(table(spark, d, "docs").select("seq", "url", "title"))
    return own.select("doc_id", "url", "seq", "title")


def delete_documents(spark: SparkSession, d: str) -> DataFrame:
    own = _docs_index(spark, d)
    return index.term_stats(own.remove(own.docs.where("source = 'onion'")).postings)


def frontier_first_offers(spark: SparkSession, d: str) -> DataFrame:
    return frontier.effective_priority(frontier.first_offers(table(spark, d, "frontier"))).select("url", "seq", "depth", "priority")


def frontier_unseen(spark: SparkSession, d: str) -> DataFrame:
    return frontier.first_offers(table(spark, d, "frontier"), table(spark, d, "fetched").where("url is not null")).select("url", "seq")


def frontier_admitted(spark: SparkSession, d: str) -> DataFrame:
    return frontier.admit(table(spark, d, "frontier"), room=frontier.MAX_PAGES).select("url", "seq", "depth", "priority")


def frontier_order(spark: SparkSession, d: str) -> DataFrame:
    return frontier.in_order(frontier.first_offers(table(spark, d, "frontier"))).select("seq", "position")


def frontier_schedule(spark: SparkSession, d: str) -> DataFrame:
    return frontier.schedule(frontier.first_offers(table(spark, d, "frontier"))).select("seq", "domain", "wait_ms")


def robots_parse(spark: SparkSession, d: str) -> DataFrame:
    bodies = spark.createDataFrame(ROBOTS_BODIES, "origin string, body string")
    return robots.parse_robots(bodies)


def robots_allowed(spark: SparkSession, d: str) -> DataFrame:
    bodies = spark.createDataFrame(ROBOTS_BODIES, "origin string, body string")
    offers = table(spark, d, "frontier").where("url is not null").select("url").distinct()
    return robots.allowed(offers, robots.parse_robots(bodies)).select("url", "origin", "path", "allowed")


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "frontier").where("url is not null").select("url").distinct()
    return rows.select("url", urls.domain_of("url").alias("domain"), urls.origin_of("url").alias("origin"), urls.path_of("url").alias("path"), urls.is_robots_url("url").alias("robots"), urls.source_of("url").alias("source"))


def normalized_urls(spark: SparkSession, d: str) -> DataFrame:
    bare = F.concat(F.lit(" "), F.regexp_replace("url", "^https?://", ""), F.lit("\t"))
    return table(spark, d, "docs").where("url is not null").select("seq", urls.normalize_url("url").alias("whole"), urls.normalize_url(bare).alias("bare")).distinct()


def search_envelope(spark: SparkSession, d: str) -> DataFrame:
    hits = _rounded(rank.search(_stored_index(spark, d), "mirror", k=20))
    item = F.struct("title", "url", "snippet", "score", "source")
    listed = hits.agg(F.count("*").alias("count"), F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))).alias("rows"))
    return listed.select(F.lit("mirror").alias("query"), "count", F.array_join(F.transform("rows", lambda r: r["item"]["url"]), "\n").alias("urls"))


def event_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", jsonio.get_number("props", "$.k", -1.0).alias("k"), jsonio.get_string("props", "$.none", "absent").alias("none"))


def escaped_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("seq", encoding.escape_html("title").alias("title")).distinct()


def decoded_queries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "frontier").where("url like '%?%'").select("url").distinct()
    return rows.select("url", encoding.query_param("url", "id").alias("id"), encoding.url_decode(encoding.query_param("url", "id")).alias("decoded"))


def base64url_titles(spark: SparkSession, d: str) -> DataFrame:
    coded = encoding.to_base64url("title")
    return table(spark, d, "docs").where("title is not null").select("seq", coded.alias("coded"), encoding.from_base64url(coded).cast("string").alias("back")).distinct()


def isolation_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").where("url is not null").select("url", netpolicy.isolation_token("url").alias("token")).distinct()


def bloom_geometry(spark: SparkSession, d: str) -> DataFrame:
    per_lang = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    bits, hashes = sketch.geometry_columns(F.col("n"), F.lit(0.01))
    return per_lang.select("source", "n", bits.alias("bits"), hashes.alias("hashes"))


def bloom_probe(spark: SparkSession, d: str) -> DataFrame:
    """The fetched urls, how many of them their sketch may hold, the frontier's urls, whether few of
    those that weren't fetched seem so, and what a cleared sketch holds."""
    fetched = table(spark, d, "fetched").select("url").where("url is not null").distinct()
    offers = table(spark, d, "frontier").select("url").where("url is not null").distinct()
    bits, hashes = sketch.geometry(fetched.count())
    built = cut(sketch.build(fetched, "url", bits, hashes))
    held = sketch.probe(fetched, "url", built, bits, hashes).agg(F.count("*").alias("held"), F.count_if("maybe").alias("held_maybe"))
    known = offers.join(fetched.withColumn("known", F.lit(True)), "url", "left")
    asked = sketch.probe(known, "url", built, bits, hashes).agg(F.count("*").alias("offered"), (F.count_if(F.col("maybe") & F.col("known").isNull()) < 0.03 * F.count("*")).alias("few_wrong"))
    after = sketch.probe(fetched, "url", sketch.clear(built), bits, hashes).agg(F.count_if("maybe").alias("after_clear"))
    return held.join(asked, F.lit(True)).join(after, F.lit(True))


def activity_recent(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "events").select("event_id", "event_type", "ts")
    return activity.recent(own, order=("ts", "event_id")).select("event_id", "event_type", activity.format_time("ts").alias("told_at"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return event_counts(table(spark, d, "events"), "1 day").select(activity.format_time("start").alias("start"), "event_type", "n")


def backoff_schedule(spark: SparkSession, d: str) -> DataFrame:
    attempts = spark.range(8).withColumnRenamed("id", "attempt")
    return attempts.select("attempt", netpolicy.backoff_ms(F.col("attempt")).alias("ms"))


def proxy_list(spark: SparkSession, d: str) -> DataFrame:
    specs = spark.createDataFrame([("a.example:9050, b.example:9150",), (":9050",), ("c.example:70000,nocolon",), ("d.example:x, e:1:2",)], "spec string")
    return netpolicy.parse_proxies(specs).select("host", "port")


def fetch_log_stats(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "fetched").select("fetch_id", "url", "ok", "fetched_at").distinct()
    log = netpolicy.attempts(once.withColumn("ms", F.lit(1.0)), ts="fetch_id")
    return netpolicy.fetch_stats(log).drop("mean_ms")


def tokenize_bytes(spark: SparkSession, d: str) -> DataFrame:
    data = F.concat(F.encode("text", "UTF-8"), F.lit(b"\xffAz"))
    rows = table(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", F.size(text.tokenize_bytes(data)).cast("long").alias("n_tokens"))


def _empty(spark: SparkSession) -> index.Index:
    return index.Index.build(spark.createDataFrame([], DOCS), next_id=1)


def index_upserted(spark: SparkSession, d: str) -> DataFrame:
    """All rows upserted into an empty index, and once more: ids stay, nothing doubles."""
    rows = table(spark, d, "docs")
    once = _empty(spark).upsert(rows)
    own = index.Index(*map(cut, (once.docs, once.postings, once.lengths)), once.next_id).upsert(rows)
    return own.docs.select("doc_id", "url").join(own.lengths, "doc_id")


def index_replaced(spark: SparkSession, d: str) -> DataFrame:
    cleared = index.Index.empty(_docs_index(spark, d))
    steps = [("cleared", cleared), ("replaced", cleared.upsert(table(spark, d, "docs")))]
    numbers = [i.stats().select(F.lit(step).alias("step"), "ndocs", "total_terms") for step, i in steps]
    return numbers[0].unionByName(numbers[1])


def document_lookup(spark: SparkSession, d: str) -> DataFrame:
    own = _stored_index(spark, d)
    return own.document(own.next_id - 1).select("doc_id", "url", "title", "content")


def scan_documents(spark: SparkSession, d: str) -> DataFrame:
    return _stored_index(spark, d).docs.select("doc_id", "url", "title", "snippet", "source", "depth")


def bm25_guards(spark: SparkSession, d: str) -> DataFrame:
    own = _docs_index(spark, d)
    asked = [
        ("no terms", rank.scores(own, [])), ("unknown term", rank.scores(own, ["qqqqzzzz"])), ("no documents", rank.scores(index.Index.empty(own), ["mirror"])), ("k of 0", rank.top(own, ["mirror"], k=0)),
    ]
    return spark.createDataFrame([(name, found.count()) for name, found in asked], "asked string, hits long")


def store_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Saved empty, upserted as two layers, loaded: the terms are those of the latest versions."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/layers-{uuid.uuid4().hex}"
    rows = table(spark, d, "docs")
    store.upsert(spark, path, rows.withColumn("content", F.lit("old words of no account")), _empty(spark))
    store.upsert(spark, path, rows)
    return store.load(spark, path).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


def stored_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The corpus numbers that the pointer keeps, without a scan."""
    own = _stored_index(spark, d)
    return spark.createDataFrame([(*own.known, own.next_id)], "ndocs long, total_terms long, next_id long")


def sealed_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = f"{checkpoint_dir(spark).rstrip('/')}/sealed-{uuid.uuid4().hex}"
    store.save_encrypted(_latest(spark, d).select("doc_id", "url", "title", "content", "depth"), path, "a passphrase")
    return store.load_encrypted(spark, path, "a passphrase")


def snapshot_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Through the binary codec, a snapshot per batch."""
    rows = _latest(spark, d).select("url", "title", "snippet", "content", "source", "depth")

    def through(batches):
        for batch in batches:
            back = snapshot.deserialize(snapshot.serialize([snapshot.Document(*r.values()) for r in batch.to_pylist()]))
            yield pa.RecordBatch.from_pylist([{"url": x.url, "title": x.title, "content": x.content, "source": x.source, "depth": x.depth} for x in back], _SNAPSHOT)

    return shipped(rows).mapInArrow(through, "url string, title string, content string, source string, depth long")


_SNAPSHOT = pa.schema([("url", pa.string()), ("title", pa.string()), ("content", pa.string()), ("source", pa.string()), ("depth", pa.int64())])


def json_edited(spark: SparkSession, d: str) -> DataFrame:
    """Each event's properties parsed, two keys set, and written again."""

    def edit(batches):
        for batch in batches:
            texts = []
            for props, kind in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                value, _ = jsonio.parse(props)
                value.set("type", kind)
                value.set("half", jsonio.as_number(value.find("k")) / 2)
                texts.append(jsonio.dump(value))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts)], names=["event_id", "text"])

    rows = table(spark, d, "events").select("event_id", "props", "event_type")
    return shipped(rows).mapInArrow(edit, f"event_id {rows.schema['event_id'].dataType.simpleString()}, text string")


def json_escaped(spark: SparkSession, d: str) -> DataFrame:
    def dump(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([jsonio.dump(t) for t in batch.column(1).to_pylist()], pa.string())], names=["seq", "text"])

    rows = table(spark, d, "docs").where("title is not null").select("seq", "title").distinct()
    return shipped(rows).mapInArrow(dump, "seq long, text string")


def _urls(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name).select("url").where("url is not null").distinct()


def stub_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = StubSource()(_urls(spark, d, "fetched"))
    return pages.select("url", "ok", html.title("html").alias("title"), F.size(html.links("html", "url")).cast("long").alias("n_links"))


def transient_errors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetched").select("fetch_id", "error", is_transient("error").alias("transient")).distinct()


def table_source(spark: SparkSession, d: str) -> DataFrame:
    answers = TableSource(table(spark, d, "fetched"))(_urls(spark, d, "docs"))
    return answers.select("url", "ok", "error", F.coalesce(F.length("html"), F.lit(0)).cast("long").alias("chars"))


def _crawled(spark: SparkSession, d: str) -> frontier.Crawl:
    """A crawl from all fetched urls over what was fetched; their links elsewhere fail."""
    return frontier.crawl(_urls(spark, d, "fetched"), TableSource(table(spark, d, "fetched")), frontier.CrawlOptions(max_pages=1 << 40, obey_robots=False))


def crawl_counts(spark: SparkSession, d: str) -> DataFrame:
    return _crawled(spark, d).activity.groupBy("level", "kind").agg(F.count("*").alias("n"))


def crawl_documents(spark: SparkSession, d: str) -> DataFrame:
    return _crawled(spark, d).docs.select("url", "title", "source", "depth")


def robots_cache(spark: SparkSession, d: str) -> DataFrame:
    rules = robots.parse_robots(spark.createDataFrame(ROBOTS_BODIES, "origin string, body string"))
    return robots.cache_stats(rules, robots.origins_to_load(_urls(spark, d, "frontier")))


def robots_to_load(spark: SparkSession, d: str) -> DataFrame:
    return robots.origins_to_load(_urls(spark, d, "frontier"), robots.origins_to_load(_urls(spark, d, "docs")))


def proxy_turns(spark: SparkSession, d: str) -> DataFrame:
    """Requests over a pool: one endpoint up, one down, one whose cooldown is over."""
    pool = spark.createDataFrame([("a.example", 9050, True, None), ("b.example", 9050, False, 100), ("c.example", 9150, False, 6000)], "host string, port int, healthy boolean, ms_since_failure int")
    turns = netpolicy.assign_round_robin(table(spark, d, "docs").select("seq").distinct(), pool, "seq")
    return turns.select("seq", netpolicy.endpoint_key(F.col("host"), F.col("port")).alias("endpoint"))


def retry_limits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "frontier").where("url is not null")
    return rows.select("url", netpolicy.max_retries("url", F.coalesce("depth", F.lit(0))).alias("retries")).distinct()


def onion_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "frontier").where("url is not null").groupBy(urls.is_onion("url").alias("onion")).agg(F.count("*").alias("n"))


def _engine(spark: SparkSession, d: str) -> Engine:
    engine = Engine(spark)
    engine.index = _stored_index(spark, d)
    return engine


def status_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _engine(spark, d).status().withColumn("average_doc_length", F.round("average_doc_length", 6))


def dashboard_sources(spark: SparkSession, d: str) -> DataFrame:
    return _engine(spark, d).dashboard()["sources"].withColumnRenamed("count", "n")


def search_api(spark: SparkSession, d: str) -> DataFrame:
    code, body = _engine(spark, d).request("GET", "/search", "q=mirror")
    answer, _ = jsonio.parse(body)
    rows = [(code, answer.find("query"), at, hit.find("url"), hit.find("title") or "") for at, hit in enumerate(answer.find("results"), 1)]
    return spark.createDataFrame(rows, "code int, query string, at long, url string, title string")


def api_errors(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark)
    asked = {
        "missing q": ("GET", "/search"), "bad json": ("POST", "/search", "", "{"), "large body": ("POST", "/crawl", "", "x" * 70_000), "missing url": ("GET", "/crawl", "url=%20"), "nowhere": ("GET", "/nowhere"),
    }
    answers = {name: engine.request(*args) for name, args in asked.items()}
    return spark.createDataFrame([(name, code, jsonio.parse(body)[0].find("error")) for name, (code, body) in answers.items()], "asked string, code int, error string")


def search_page(spark: SparkSession, d: str) -> DataFrame:
    page = _engine(spark, d).search_html("mirror")
    return spark.createDataFrame(list(enumerate(re.findall('<a href="([^"]*)">', page), 1)), "rank int, url string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        *(tokenize_documents, query_terms_of_titles, term_frequencies, postings_weighted, doc_lengths, corpus_stats, term_stats, postings_lookup),
        *(bm25_top10, bm25_many_terms, bm25_k1_zero, bm25_all_scores, bm25_titled, bm25_in_language),
        *(page_titles, page_descriptions, page_text, page_documents, page_links, link_in_degree, link_out_degree, crawl_reachable),
        *(upsert_last_wins, delete_documents, frontier_first_offers, frontier_unseen, frontier_admitted, frontier_order, frontier_schedule),
        *(robots_parse, robots_allowed, url_parts, normalized_urls, search_envelope, event_props, escaped_titles, decoded_queries),
        *(base64url_titles, isolation_tokens, bloom_geometry, bloom_probe, activity_recent, event_windows, backoff_schedule, proxy_list, fetch_log_stats),
        *(tokenize_bytes, index_upserted, index_replaced, document_lookup, scan_documents, bm25_guards, store_round_trip, stored_numbers, sealed_round_trip),
        *(snapshot_round_trip, json_edited, json_escaped, stub_pages, transient_errors, table_source, crawl_counts, crawl_documents, robots_cache),
        *(robots_to_load, proxy_turns, retry_limits, onion_urls, status_numbers, dashboard_sources, search_api, api_errors, search_page),
    )
    return {f.__name__: f for f in own}
