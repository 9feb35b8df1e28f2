"""Problem 5: the main body of each page.

Nearest-URL differencing: the urls of a host are put in order of their path, each page is compared
with the pages before and after its own, and blocks in the longest common subsequence of two pages
are shared. Shared blocks go. Of what differs, the section with most text outside links, over all
pages of the host, is the body, and blocks elsewhere (titles of other pages) go too. A block that is
shared wherever it stands, in several hosts (their names masked), goes also where no neighbour holds
it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.blocks import HEADINGS, WITHIN, block_key, common_subsequence, page_blocks, site_pattern
from tarn.llm.hosts import site
from tarn.plans.ids import dense_ids
from tarn.plans.session import shipped, spread, stored

NEIGHBOURS = 4  # pages compared on either side
GROUP_URLS = 32  # urls whose pages one call judges
PART_PAGES, PART_BLOCKS = 128, 1 << 16  # fetches of them, and their blocks, in one call; beyond it is split
MIN_SHARED = 0.25  # share of the compared neighbours that hold a block before it is dropped
MIN_HOSTS = 3  # hosts in which a block is shared before it goes everywhere
MIN_RATE = 0.5  # share of its occurrences that are shared

_PARSED = "fetch_id long, host string, path string, texts array<string>, keys array<long>, tags array<string>, places array<string>, free array<int>"
_COMPARED = "fetch_id long, page long, host string, keys array<long>, fixed array<boolean>, places array<string>, times array<int>, near int, names array<string>, unshared array<long>"
_COMPARED_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64())]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    names = [f.split()[0] for f in _PARSED.split(", ")]
    types = [pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32())]
    for batch in batches:
        columns: list[list] = [[], [], [], [], []]
        for host, html in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            blocks = page_blocks(html)
            name = site_pattern(host)
            keys = [xxhash.xxh64_intdigest(block_key(b.text, name)) - (1 << 63) for b in blocks]
            for column, values in zip(columns, ([b.text for b in blocks], keys, [b.tag for b in blocks], [b.place for b in blocks], [b.free for b in blocks]), strict=True):
                column.append(values)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)


def page_id() -> Column:
    """A page by its fetch_id and blocks: rows delivered twice have one."""
    return F.xxhash64("fetch_id", "keys")


def parsed_pages(fetched: DataFrame) -> DataFrame:
    """Blocks of every page with html: failed fetches, empty pages and null urls give no row."""
    path = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([\s\S]*)$", 1)
    pages = fetched.where(F.col("url").isNotNull() & (F.length("html") > 0) & F.col("fetch_id").isNotNull())
    rows = pages.select(F.col("fetch_id").cast("long").alias("fetch_id"), site("url").alias("host"), path.alias("path"), "html")
    return spread(rows).mapInArrow(_parse, _PARSED)


def _compare(table: pa.Table) -> pa.Table:
    """One group's own pages, against the context pages around each url: how many of the pages in
    reach share each block, and the unshared text outside links of each section."""
    seen: dict[tuple, dict] = {}
    refs: dict[int, dict] = {}
    for row in table.to_pylist():
        if row["context"]:
            refs[row["rank"]] = row
        else:
            seen.setdefault((row["fetch_id"], row["rank"], tuple(row["keys"])), row)
    out: list[tuple] = []
    for page in seen.values():
        others = [r for d in range(-NEIGHBOURS, NEIGHBOURS + 1) if d and (r := refs.get(page["rank"] + d)) and r["host"] == page["host"] and r["keys"] != page["keys"]]
        times = [0] * len(page["keys"])
        for other in others:
            for at, _ in common_subsequence(page["keys"], other["keys"]):
                times[at] += 1
        unshared: dict[str, int] = {}
        for place, free, n in zip(page["places"], page["free"], times, strict=True):
            own = place.rpartition(WITHIN)[2]
            unshared[own] = unshared.get(own, 0) + (0 if n else free)
        fixed = [t in HEADINGS or t in ("td", "th") for t in page["tags"]]
        names = list(unshared)
        out.append((page["fetch_id"], page["page"], page["host"], page["keys"], fixed, page["places"], times, len(others), names, [unshared[x] for x in names]))
    columns = list(zip(*out, strict=True)) or [[]] * len(_COMPARED_TYPES)
    names = [f.split()[0] for f in _COMPARED.split(", ")]
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, _COMPARED_TYPES, strict=True)], names=names)


def compared_pages(pages: DataFrame) -> DataFrame:
    """Every parsed page with how many pages in reach share each of its blocks, and with the unshared
    text of its sections.

    Texts stay where they are: keys, tags and places decide. `page` names a page among the versions
    of its fetch_id.

    Groups are bounded: GROUP_URLS urls by rank and at most about PART_PAGES of their fetches or
    PART_BLOCKS of their blocks, and one reference page (the latest fetch) of each url in reach. So
    neither a large host nor a url fetched over and over meets in one task; the joins by url are plain
    ones, which adaptive execution splits where a url is hot. Urls of a host whose latest pages have
    the same blocks share a rank: copies are judged by the same neighbours, never by each other.
    """
    cost = (PART_BLOCKS // PART_PAGES + F.size("keys")).cast("long")  # in whole numbers: any order of summing gives the same parts
    latest = pages.groupBy("host", "path").agg(F.max(F.struct("fetch_id", F.xxhash64("keys").alias("look"))).alias("latest"), F.sum(cost).alias("n"))
    urls = latest.select("host", "path", F.col("latest.fetch_id").alias("ref_id"), F.col("latest.look").alias("look"), "n")
    looks = urls.groupBy("host", "look").agg(F.min(F.struct("path", "ref_id")).alias("first"), F.sum("n").alias("n"))
    firsts = looks.select("host", "look", F.col("first.path").alias("first_path"), F.col("first.ref_id").alias("ref_id"), "n")
    ranked = dense_ids(firsts, ["host", "first_path"], "rank").withColumn("group", F.floor(F.col("rank") / GROUP_URLS).cast("long"))
    groups = ranked.groupBy("group").agg(F.ceil(F.sum("n") / PART_BLOCKS).cast("int").alias("parts"))
    placed = urls.select("host", "path", "look").join(ranked.drop("first_path", "n"), ["host", "look"]).drop("look").join(groups, "group")
    narrow = pages.select("fetch_id", page_id().alias("page"), "host", "path", "keys", "tags", "places", "free")
    rows = narrow.join(placed, ["host", "path"])
    wide = ["fetch_id", "page", "rank", "host", "keys", "tags", "places", "free"]
    own = rows.select("group", F.pmod(F.xxhash64("fetch_id", F.lit(1)), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("context"), *wide)
    at = F.col("rank") % GROUP_URLS
    reach = F.array_compact(F.array(F.when(at < NEIGHBOURS, F.col("group") - 1), F.col("group"), F.when(at >= GROUP_URLS - NEIGHBOURS, F.col("group") + 1)))
    none = F.array().cast("array<string>")
    refs = rows.where(F.col("fetch_id") == F.col("ref_id")).select(
        F.explode(reach).alias("group"), F.lit(True).alias("context"), "fetch_id", "page", "rank", "host", "keys", none.alias("tags"), none.alias("places"), F.array().cast("array<int>").alias("free")
    )
    context = refs.join(groups, "group").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("group", "part", "context", *wide)
    return shipped(own.unionByName(context)).groupBy("group", "part").applyInArrow(_compare, _COMPARED)


def bodies(compared: DataFrame) -> DataFrame:
    """page, body: the section that holds most unshared text outside links over the pages of its
    host, of those in which the page has such text; by the page's own text where the host's is
    equal, then by name.

    A host's sums are made of pages' before they meet, and come back to pages over narrow rows.
    """
    each = compared.select("page", "host", F.explode(F.arrays_zip("names", "unshared")).alias("s")).select("page", "host", F.col("s.names").alias("place"), F.col("s.unshared").alias("own"))
    score = each.groupBy("host", "place").agg(F.sum("own").alias("score"))
    ranked = F.struct(F.when(F.col("own") > 0, -F.col("score")).otherwise(1), -F.col("own"), "place")
    return each.join(score, ["host", "place"]).groupBy("page").agg(F.min(ranked).alias("best")).select("page", F.col("best.place").alias("body"))


def judged_blocks(compared: DataFrame) -> DataFrame:
    """Every block with its verdict: elsewhere, kept, shared or alone.

    A block shared with enough neighbours goes, and so does one outside the body, the section that
    differs from the neighbours' most. Headings and table cells of the body repeat without being
    boilerplate and are kept.
    """
    rows = compared.join(bodies(compared), "page").select("fetch_id", "page", "host", "near", "body", F.posexplode(F.arrays_zip("keys", "fixed", "places", "times")).alias("at", "b"))
    inside = F.substring_index("b.places", WITHIN, -1) == F.col("body")
    enough = F.greatest(F.lit(1), F.ceil(F.lit(MIN_SHARED) * F.col("near")))
    verdict = F.when(~inside, "elsewhere").when(F.col("b.fixed"), "kept").when(F.col("b.times") >= enough, "shared").otherwise("alone")
    return rows.select("fetch_id", "page", "at", F.col("b.keys").alias("key"), "host", (F.col("b.times") > 0).alias("shared"), verdict.alias("verdict"))


def everywhere_shared(judged: DataFrame) -> DataFrame:
    """key of the blocks that are shared in several hosts and mostly where they stand."""
    per_host = judged.groupBy("key", "host").agg(F.count("*").alias("n"), F.sum(F.col("shared").cast("long")).alias("n_shared"))
    per_key = per_host.groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_shared").alias("n_shared"), F.sum((F.col("n_shared") > 0).cast("long")).alias("hosts"))
    return per_key.where((F.col("hosts") >= MIN_HOSTS) & (F.col("n_shared") >= MIN_RATE * F.col("n"))).select("key")


def body_blocks(fetched: DataFrame) -> DataFrame:
    """fetch_id, at (position in the page), block: the blocks of each page's main body, in order."""
    pages = stored(parsed_pages(fetched))
    judged = stored(judged_blocks(stored(compared_pages(pages))))
    known = everywhere_shared(judged)
    alone = judged.where(F.col("verdict") == "alone").join(known, "key", "left_anti")
    kept = judged.where(F.col("verdict") == "kept").select("page", "at").unionByName(alone.select("page", "at"))
    places = kept.groupBy("page").agg(F.collect_set("at").alias("at"))
    texts = pages.select("fetch_id", page_id().alias("page"), "texts").join(places, "page")
    return texts.select("fetch_id", F.explode("at").alias("at"), "texts").select("fetch_id", "at", F.col("texts")[F.col("at")].alias("block"))


def body_texts(fetched: DataFrame) -> DataFrame:
    """fetch_id, body: the main body of each page that has one, a block a line."""
    rows = body_blocks(fetched).distinct().groupBy("fetch_id").agg(F.array_sort(F.collect_list(F.struct("at", "block"))).alias("blocks"))
    return rows.select("fetch_id", F.array_join(F.transform("blocks", lambda b: b["block"]), "\n").alias("body"))


def found_blocks(fetched: DataFrame) -> DataFrame:
    """Distinct (fetch_id, block) of the main bodies."""
    return body_blocks(fetched).select("fetch_id", "block").distinct()
