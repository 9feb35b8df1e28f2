"""The crawl frontier: admission, order, pacing, and the level loop."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.html import documents_of, links
from tarn.functions.urls import domain_of
from tarn.operators.robots import AGENT, allowed, origins_to_load, parse_robots
from tarn.plans.ids import dense_ids
from tarn.plans.session import cut

MAX_PAGES, MAX_DEPTH, DOMAIN_DELAY_MS = 64, 2, 100
MAX_TOP = 100_000  # rows of a cap that a top-k holds


def effective_priority(rows: DataFrame) -> DataFrame:
    """priority -1 or null means the depth; a null depth is 0."""
    depth = F.coalesce("depth", F.lit(0))
    return rows.withColumn("depth", depth).withColumn("priority", F.when(F.coalesce("priority", F.lit(-1)) == -1, depth).otherwise(F.col("priority")))


def first_offers(offers: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Each url's offer of the smallest seq, without urls in `seen`. A null url is no offer; the
    empty url is one. Two narrow aggregates before the join keep a hot url to a row per task."""
    rows = offers.where(F.col("url").isNotNull())
    best = rows.groupBy("url").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "url"]), "seq").alias("o")).select("url", "o.*")
    if seen is not None:
        best = best.join(seen.select("url"), "url", "left_anti")
    return best


def in_order(rows: DataFrame) -> DataFrame:
    """With `position` from 1 by (priority, seq): a range sort, not a one-partition window."""
    return dense_ids(effective_priority(rows), ["priority", "seq"], "position", start=1)


def admit(offers: DataFrame, seen: DataFrame | None = None, room: int = MAX_PAGES) -> DataFrame:
    """Offers accepted in order of arrival while there is room: the cap counts all ever accepted.

    A top-k where one task can hold the cap; a larger one is cut off by positions of a range sort."""
    fresh = effective_priority(first_offers(offers, seen))
    if room <= MAX_TOP:
        return fresh.orderBy("seq").limit(max(0, room))
    return dense_ids(fresh, ["seq", "url"], "_at").where(F.col("_at") < room).drop("_at")


def schedule(rows: DataFrame, delay_ms: int = DOMAIN_DELAY_MS, request_delay_ms: int = 0) -> DataFrame:
    """With domain and wait_ms: when each fetch may start, counted from the first of its domain.

    The k-th fetch of a domain waits k-1 delays. The k comes from dense ids over (domain, priority,
    seq) less the first id of the domain, so a domain with a third of all rows is still sorted by
    many tasks.
    """
    ordered = dense_ids(effective_priority(rows).withColumn("domain", domain_of("url")), ["domain", "priority", "seq"], "_id")
    first = ordered.groupBy("domain").agg(F.min("_id").alias("_first"))
    return ordered.join(first, "domain").withColumn("wait_ms", (F.col("_id") - F.col("_first")) * (delay_ms + request_delay_ms)).drop("_id", "_first")


def schedule_small(rows: DataFrame, delay_ms: int = DOMAIN_DELAY_MS) -> DataFrame:
    """schedule() for one level of a capped crawl, by a window."""
    w = Window.partitionBy("domain").orderBy("priority", "seq")
    return effective_priority(rows).withColumn("domain", domain_of("url")).withColumn("wait_ms", (F.row_number().over(w) - 1) * F.lit(delay_ms))


@dataclass
class CrawlOptions:
    max_pages: int = MAX_PAGES
    max_depth: int = MAX_DEPTH
    domain_delay_ms: int = DOMAIN_DELAY_MS
    request_delay_ms: int = 0
    obey_robots: bool = True
    agent: str = AGENT
    strict_break: bool = False  # a page's links end at the first one that isn't accepted


@dataclass
class Crawl:
    """What a crawl did: tables, and counts by kind."""

    docs: DataFrame
    seen: DataFrame
    activity: DataFrame
    crawled: int = 0
    counts: dict[str, int] = field(default_factory=dict)


def _strict_links(found: DataFrame, known: set[str], room: int) -> list[tuple[str, int]]:
    """Replay of one level's links in order with the early break; at most `room` are accepted, and
    a page gives no more than accepted links and one refusal, so only a capped crawl comes here."""
    out: list[tuple[str, int]] = []
    for page in found.orderBy("priority", "seq").toLocalIterator():
        for link in page["links"]:
            if len(out) >= room or link in known:
                break
            known.add(link)
            out.append((link, page["depth"] + 1))
    return out


def crawl(
    seeds: DataFrame,
    fetch: Callable[[DataFrame], DataFrame],
    options: CrawlOptions | None = None,
    on_level: Callable[[DataFrame, DataFrame], None] | None = None,
    stopped: Callable[[], bool] | None = None,
) -> Crawl:
    """Breadth-first by levels, one job chain a level.

    `on_level` is told each level's documents and events as tables; `stopped` is asked before the
    next level: the level at hand is drained, nothing new is admitted.

    `seeds` has url (and may have depth, priority, seq); `fetch` maps rows of url and wait_ms to (url,
    ok, html, error). Each level is checkpointed, so a lost executor repeats one level at most. All links of
    a page are followed unless strict_break is set. Blocked and failed pages count as crawled.
    """
    options = options or CrawlOptions()
    spark = seeds.sparkSession
    offers = seeds
    for name, value in (("depth", F.lit(0)), ("priority", F.lit(-1)), ("seq", F.monotonically_increasing_id())):
        if name not in offers.columns:
            offers = offers.withColumn(name, value)
    offers = offers.select("url", "depth", "priority", "seq")
    level = cut(admit(offers, room=options.max_pages))
    seen, docs, events, rules, loaded = level.select("url"), None, None, None, None
    accepted = level.count()
    crawled = level_no = 0
    counts = {"indexed": 0, "blocked": 0, "failed": 0}
    while True:
        size = level.count()
        if not size:
            break
        crawled += size
        judged = level
        if options.obey_robots:
            fresh = cut(origins_to_load(level, loaded))
            bodies = fetch(fresh.select(F.col("robots_url").alias("url"))).where("ok")
            own = fresh.join(bodies, fresh["robots_url"] == bodies["url"]).select("origin", F.col("html").alias("body"))
            new_rules = cut(parse_robots(own, options.agent))
            rules = new_rules if rules is None else rules.unionByName(new_rules)
            loaded = fresh if loaded is None else loaded.unionByName(fresh)
            judged = allowed(level, rules)
        else:
            judged = level.withColumn("allowed", F.lit(True))
        timed = schedule_small(judged, options.domain_delay_ms + options.request_delay_ms)
        answers = fetch(timed.where("allowed").select("url", "wait_ms"))  # a live source keeps the distance
        pages = cut(timed.select("url", "depth", "priority", "seq", "wait_ms", "allowed").join(answers, "url", "left"))
        good = pages.where("allowed and ok and html is not null")
        own_docs = cut(documents_of(good, depth="depth"))
        docs = own_docs if docs is None else docs.unionByName(own_docs)
        kind = F.when(~F.col("allowed"), "blocked").when(F.coalesce("ok", F.lit(False)), "indexed").otherwise("failed")
        told = pages.select(F.lit(level_no).alias("level"), kind.alias("kind"), "url", F.coalesce("error", F.lit("")).alias("text"), "wait_ms", "seq")
        events = told if events is None else events.unionByName(told)
        for r in told.groupBy("kind").count().collect():
            counts[r["kind"]] += r["count"]
        if on_level:
            on_level(own_docs, told)
        room = options.max_pages - accepted
        if level_no + 1 > options.max_depth or room <= 0 or (stopped and stopped()):
            break
        found = good.where(F.col("depth") < options.max_depth).select("url", "depth", "priority", "seq", links("html", "url").alias("links"))
        if options.strict_break:
            known = {r["url"] for r in seen.toLocalIterator()}
            rows = [(u, d, d, i) for i, (u, d) in enumerate(_strict_links(found, known, room))]
            level = cut(spark.createDataFrame(rows, "url string, depth int, priority int, seq long"))
        else:
            each = found.select((F.col("depth") + 1).alias("depth"), F.col("priority").alias("_p"), F.col("seq").alias("_s"), F.posexplode("links").alias("_at", "url"))
            # arrival order: the page's own order, then the link's place in it
            numbered = dense_ids(each, ["_p", "_s", "_at"], "seq")
            level = cut(admit(numbered.select("url", "depth", F.col("depth").alias("priority"), "seq"), seen, room))
        accepted += level.count()
        seen = cut(seen.unionByName(level.select("url")))
        level_no += 1
    if docs is None:
        docs = documents_of(spark.createDataFrame([], "url string, html string"))
        events = spark.createDataFrame([], "level int, kind string, url string, text string, wait_ms long, seq long")
    return Crawl(docs, seen, events, crawled, counts)


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """url, depth: least number of links from a seed, up to max_depth. `edges` has src, dst."""
    seen = cut(seeds.select("url").where("url is not null").distinct().withColumn("depth", F.lit(0)))
    level = seen
    for depth in range(1, max_depth + 1):
        step = edges.join(level, edges["src"] == level["url"]).select(F.col("dst").alias("url")).where("dst is not null").distinct()
        level = cut(step.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen
