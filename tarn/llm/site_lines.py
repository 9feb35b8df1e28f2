"""Problem 3: lines that one site repeats over its pages.

Each line becomes a 64-bit identifier of (site, normalised line). Single lines are counted first; a
longer block can only stand within a run of lines that are repeated themselves. Tasks concatenate
such runs and build a suffix array by prefix doubling; common prefixes of neighbouring suffixes give
the repeated blocks: maximal runs of several lines, which differ in what stands before them and in
what follows. A site of one chunk has its blocks from that. Those of a larger site may be maximal
over the site though in none of its parts, so the parts give bounds, then places to look at, then
exact counts; no large site is ever gathered into one task. A document loses the lines that an
occurrence of a block of many pages covers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tarn.llm.hosts import line_key, lines, site
from tarn.plans.session import shipped, spread, stored

MIN_URLS = 6
MIN_SHARE = 0.2
CHUNK_LINES = 1 << 18  # lines of one suffix array, and of a part of a site
_BORDER = np.iinfo(np.int64)  # its limits stand for what lies beyond a run: each time something else


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of non-negative integers by prefix doubling, its inverse, and the longest common
    prefix of each suffix with the one before it in the array."""
    n = len(ids)
    if not n:
        return (np.zeros(0, dtype=np.int64),) * 3
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.full(n, -1, dtype=np.int64)
        second[: max(0, n - k)] = rank[k:]
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        step = np.r_[0, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(step)
        k *= 2
        if rank[order[-1]] == n - 1 or k >= n:
            break
    return order, rank, _lcp(ids, order, rank)


def _lcp(ids: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the array, in linear time: going
    through the text, a prefix shrinks by one symbol at most from a suffix to the next."""
    n = len(ids)
    out = [0] * n
    text, before, at = ids.tolist(), np.r_[-1, order[:-1]].tolist(), rank.tolist()
    length = 0
    for i in range(n):
        j = before[at[i]]
        if j < 0:
            length = 0
            continue
        while i + length < n and j + length < n and text[i + length] == text[j + length]:
            length += 1
        out[at[i]] = length
        if length:
            length -= 1
    return np.array(out, dtype=np.int64)


_BASE = 0x9E3779B97F4A7C15  # a fixed odd multiplier
_INVERSE = pow(_BASE, -1, 1 << 64)


class RunHashes:
    """64-bit hashes of runs of identifiers, each in constant time from sums over the whole."""

    def __init__(self, ids: np.ndarray) -> None:
        n = len(ids)
        down = np.ones(n + 1, dtype=np.uint64)
        self.up = np.ones(n + 1, dtype=np.uint64)
        down[1:], self.up[1:] = np.uint64(_INVERSE), np.uint64(_BASE)
        down, self.up = np.multiply.accumulate(down), np.multiply.accumulate(self.up)
        self.sums = np.r_[np.zeros(1, dtype=np.uint64), np.cumsum(ids.view(np.uint64) * down[:n], dtype=np.uint64)]

    def __call__(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        h = (self.sums[start + length] - self.sums[start]) * self.up[start]
        h = (h ^ (h >> np.uint64(32)) ^ np.asarray(length, dtype=np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(29))).view(np.int64)


def _intervals(order: np.ndarray, lcp: np.ndarray, names: np.ndarray, urls: np.ndarray) -> Iterator[tuple[int, int, bool, set[int]]]:
    """(start, length, whether different symbols stand before, urls) of the runs of `names` that
    different symbols follow; the set of urls holds until the next one is asked for.

    Intervals of the suffix array with a common prefix are opened and closed on a stack; url sets
    are joined small into large, so texts of one line over and over take near linear time too.
    """
    before, at, common, url = np.r_[-1, names[:-1]][order].tolist() if len(names) else [], order.tolist(), [*lcp.tolist(), 0], urls[order].tolist()
    several = -2
    stack: list[list] = []  # open intervals: prefix, a start, what stands before all, urls

    def join(into: list, part: list) -> None:
        if into[2] != part[2]:
            into[2] = several
        if len(into[3]) < len(part[3]):
            into[3], part[3] = part[3], into[3]
        into[3] |= part[3]

    for i in range(len(at)):
        here, ahead = common[i], common[i + 1]
        if here or ahead:
            leaf = [max(here, ahead), at[i], before[i], {url[i]}]
            if ahead > here:
                stack.append(leaf)
            else:
                join(stack[-1], leaf)
        while stack and stack[-1][0] > ahead:
            top = stack.pop()
            yield top[1], top[0], top[2] == several, top[3]
            if stack and stack[-1][0] >= ahead:
                join(stack[-1], top)
            elif ahead:
                stack.append([ahead, *top[1:]])


def maximal_blocks(names: np.ndarray, urls: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, set[int]]]]:
    """The suffix array of `names`, its common prefixes, and (start, length, urls) of the repeated
    runs of two symbols or more under two urls or more that can't be made longer on either side
    without losing an occurrence.

    Every document in `names` ends with a mark that stands nowhere else, so no run crosses one.
    These are the blocks of the whole only if `names` is: see repeated_blocks().
    """
    order, _, lcp = suffix_array(names)
    found = [(start, length, set(own)) for start, length, several, own in _intervals(order, lcp, names, urls) if length >= 2 and several and len(own) >= 2]
    return order, lcp, found


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """site, url_id, site_urls, run: the runs of two lines or more that are all among `lines`, those
    that their site repeats. Columns site, url_id, site_urls, ids (without blank lines), lines."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(3)
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(ids).to_numpy(zero_copy_only=False))
        # identifiers differ between sites, so all sites of the batch are looked up at once
        first = np.unique(batch.column(0).dictionary_encode().indices.to_numpy(), return_index=True)[1]
        known = np.unique(batch.column(4).take(pa.array(first)).flatten().to_numpy(zero_copy_only=False))
        hit = known[np.minimum(np.searchsorted(known, flat), len(known) - 1)] == flat
        apart = np.r_[True, row[1:] != row[:-1]]
        start = np.flatnonzero(hit & (apart | ~np.r_[False, hit[:-1]]))
        stop = np.flatnonzero(hit & (np.r_[apart[1:], True] | ~np.r_[hit[1:], False])) + 1
        long = stop - start >= 2
        start, stop = start[long], stop[long]
        edge = np.zeros(len(flat) + 1, dtype=np.int64)
        edge[start] += 1
        edge[stop] -= 1
        run = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(stop - start)].astype(np.int32)), pa.array(flat[np.cumsum(edge[:-1]) > 0]))
        own = pa.array(row[start])
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(own) for i in range(3)), run], names=["site", "url_id", "site_urls", "run"])


class _Chunk:
    """Some rows with their runs behind one another, a mark that stands nowhere else behind each."""

    def __init__(self, rows: pa.Table) -> None:
        self.rows = rows
        runs = rows["run"].combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        self.stop = np.cumsum(sizes) - 1  # where each row's mark stands
        n = int(sizes.sum())
        self.end = np.zeros(n, dtype=bool)
        self.end[self.stop] = True
        self.raw = np.zeros(n, dtype=np.int64)
        self.raw[~self.end] = runs.flatten().to_numpy(zero_copy_only=False)
        self.names = np.unique(self.raw, return_inverse=True)[1].astype(np.int64) + n
        self.names[self.end] = np.arange(len(sizes))
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.site = rows["site"].combine_chunks().dictionary_encode().indices.to_numpy()
        self.asks = pc.is_null(rows["url_id"]).to_numpy()  # rows that bring no page
        # numbers of the urls, 0 where there is none
        self.url = np.where(self.asks, 0, np.unique(pc.fill_null(rows["url_id"], 0).to_numpy(), return_inverse=True)[1] + 1)

    def sites_of(self, rows: np.ndarray) -> pa.Array:
        return self.rows["site"].combine_chunks().take(pa.array(rows, pa.int64()))


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[_Chunk]:
    """The rows in chunks of `limit` lines and marks or somewhat more; no group is divided, as its
    rows come together. A chunk may hold many groups."""
    held, n, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column("group").to_numpy()
        total = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(batch.column("run")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)]
        begin = 0
        for at in np.flatnonzero(np.r_[group[0] != last, group[1:] != group[:-1]]).tolist():
            if n + total[at] - total[begin] >= limit:
                yield _Chunk(pa.Table.from_batches([*held, batch.slice(begin, at - begin)]))
                held, n, begin = [], 0, at
        held.append(batch.slice(begin))
        n, last = n + int(total[-1] - total[begin]), group[-1]
    if held:
        yield _Chunk(pa.Table.from_batches(held))


def _outermost(blocks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The (start, length) that lie in no other one."""
    out, reached = [], 0
    for start, length in sorted(blocks, key=lambda b: (b[0], -b[1])):
        if start + length > reached:
            out.append((start, length))
            reached = start + length
    return out


def _local_blocks(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """site, block, length, n_urls, run. For a site in one part, its blocks under many urls. For one
    in several parts, `run` holds lines such that each block under many urls of the site lies in one
    of them: it has its share of urls in one part at least, as urls are in one part each."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, limit):
            split, share = chunk.rows["split"].to_numpy(), chunk.rows["share"].to_numpy()
            pair = np.unique(np.stack([chunk.site, chunk.url]), axis=1)
            need = share * np.bincount(pair[0])[chunk.site] * (1 - 1e-9)  # rounding must not lose one
            found = [(s, k, len(own)) for s, k, own in maximal_blocks(chunk.names, chunk.url[chunk.row])[2] if len(own) >= need[chunk.row[s]]]
            whole = np.flatnonzero(split & (need <= 1))  # one page is enough here
            within = _outermost([(s, k) for s, k, _ in found if split[chunk.row[s]]] + [(int(chunk.stop[r] - k), k) for r in whole.tolist() for k in [len(chunk.rows["run"][r])]])
            found = [f for f in found if not split[chunk.row[f[0]]]]
            start = np.array([f[0] for f in found] + [s for s, _ in within], dtype=np.int64)
            length = np.array([f[1] for f in found] + [k for _, k in within], dtype=np.int64)
            runs = pa.array([None] * len(found) + [chunk.raw[s : s + k] for s, k in within], pa.list_(pa.int64()))
            n_urls = pa.array([f[2] for f in found] + [None] * len(within), pa.int64())
            columns = [chunk.sites_of(chunk.row[start]), pa.array(RunHashes(chunk.raw)(start, length)), pa.array(length.astype(np.int32)), n_urls, runs]
            yield pa.RecordBatch.from_arrays(columns, names=["site", "block", "length", "n_urls", "run"])

    return find


def _branches(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """site, block, length of the runs of lines in the rows without a url that pages of the chunk
    have too, but don't go on as those rows do. A block of the site that lies in such a row is among
    these in one part at least, or all pages would go on alike and it weren't maximal."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, limit):
            order, _, lcp = suffix_array(chunk.names)
            found = [(s, k) for s, k, _, own in _intervals(order, lcp, chunk.names, chunk.url[chunk.row]) if k >= 2 and len(own) >= 2 and 0 in own]
            start, length = np.array(found, dtype=np.int64).reshape(-1, 2).T
            columns = [chunk.sites_of(chunk.row[start]), pa.array(RunHashes(chunk.raw)(start, length)), pa.array(length.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["site", "block", "length"])

    return find


_COUNTS = "site string, block long, length int, n_urls long, least_before long, most_before long, least_after long, most_after long"


def _counts(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """_COUNTS of the blocks that the rows without a url name: the urls of the chunk they stand
    under, least and largest identifier before and after them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, limit):
            asked = np.flatnonzero(chunk.asks)
            blocks = pc.fill_null(chunk.rows["block"], 0).to_numpy()[asked]
            lengths = pc.fill_null(chunk.rows["length"], 0).to_numpy()[asked]
            hashes, left = RunHashes(chunk.raw), chunk.stop[chunk.row] - np.arange(len(chunk.raw))
            before = np.r_[True, chunk.end[:-1]], np.r_[0, chunk.raw[:-1]]
            for length in np.unique(lengths).tolist():
                own = asked[lengths == length]
                wanted, first = np.unique(blocks[lengths == length], return_index=True)
                at = np.flatnonzero(left >= length)
                got = hashes(at, length)
                which = np.minimum(np.searchsorted(wanted, got), len(wanted) - 1)
                at, which = at[wanted[which] == got], which[wanted[which] == got]
                if not len(at):
                    continue
                take = np.argsort(which, kind="stable")
                at, which = at[take], which[take]
                begin = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
                pair = np.unique(np.stack([which, chunk.url[chunk.row[at]]]), axis=1)[0]
                n_urls = np.bincount(pair, minlength=len(wanted))[which[begin]]
                sides = []
                for outside, line in ((before[0][at], before[1][at]), (chunk.end[at + length], chunk.raw[at + length])):
                    sides += [np.minimum.reduceat(np.where(outside, _BORDER.min, line), begin), np.maximum.reduceat(np.where(outside, _BORDER.max, line), begin)]
                columns = [chunk.sites_of(own[first[which[begin]]]), pa.array(wanted[which[begin]]), pa.array(np.full(len(begin), length, dtype=np.int32)), pa.array(n_urls.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, sides)], names=[c.split()[0] for c in _COUNTS.split(", ")])

    return count


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the hash of a block of one line in place of the line, their second column."""
    for batch in batches:
        ids = batch.column(1).to_numpy(zero_copy_only=False)
        yield batch.set_column(1, "block", pa.array(RunHashes(ids)(np.arange(len(ids)), 1)))


def _ids(text: str, of_site: str) -> Column:
    """An identifier per line of `text`, null for a blank one."""
    return F.transform(lines(text), lambda x: F.when(line_key(x) != "", F.xxhash64(F.col(of_site), line_key(x))))


def line_ids(docs: DataFrame) -> DataFrame:
    """seq, url, site, ids: an identifier per line, null for a blank one; stored, as counts and marks
    both read it. Rows without a url belong to no site and are left out."""
    own = docs.where(F.col("url").isNotNull()).select("seq", "url", "content").withColumn("site", site("url"))
    return stored(spread(own).select("seq", "url", "site", _ids("content", "site").alias("ids")))


def repeated_blocks(own: DataFrame, min_urls: int = MIN_URLS, min_share: float = MIN_SHARE) -> DataFrame:
    """site, block (hash), length (lines), n_urls, site_urls: the blocks that stand under many urls
    of their site, single lines and the site's maximal blocks. `own` is of line_ids().

    All are counted exactly, however the rows are split: a run of lines whose single lines are not
    repeated is no block, a site of up to CHUNK_LINES lines in repeated runs stands in one task, and
    the parts of a larger one are summed up by _of_parts().
    """
    narrow = own.select("site", F.xxhash64("url").alias("url_id"), F.filter("ids", lambda x: x.isNotNull()).alias("ids"))
    many = (F.col("n_urls") >= min_urls) & (F.col("n_urls") >= min_share * F.col("site_urls"))
    per_site = own.select("site", "url").distinct().groupBy("site").agg(F.count("*").alias("site_urls"))
    per_line = narrow.select("site", "url_id", F.explode("ids").alias("line")).distinct().groupBy("site", "line").agg(F.count("*").alias("n_urls"))
    single = stored(per_line.where(F.col("n_urls") >= min_urls).join(per_site, "site").where(many).select("site", "line", F.lit(1).alias("length"), "n_urls", "site_urls"))
    known = single.groupBy("site", "site_urls").agg(F.collect_list("line").alias("lines"))
    joined = narrow.where(F.size("ids") > 1).join(known, "site").select("site", "url_id", "site_urls", "ids", "lines")
    runs = stored(shipped(joined).mapInArrow(_runs, "site string, url_id long, site_urls long, run array<long>"))
    sizes = runs.groupBy("site").agg(F.ceil(F.sum(F.size("run") + 1) / CHUNK_LINES).alias("parts"), F.count_distinct("url_id").alias("reach"))
    placed = runs.join(sizes, "site").select(
        _group("site", F.pmod("url_id", "parts")).alias("group"),
        *("site", "url_id", "run", (F.col("parts") > 1).alias("split")),
        (F.greatest(F.lit(float(min_urls)), min_share * F.col("site_urls")) / F.col("reach")).alias("share"),
    )
    found = stored(_grouped(placed).mapInArrow(_local_blocks(CHUNK_LINES), "site string, block long, length int, n_urls long, run array<long>"))
    longer, within = found.where(F.col("run").isNull()).select("site", "block", "length", "n_urls"), found.where(F.col("run").isNotNull())
    if not within.isEmpty():
        longer = longer.union(_of_parts(placed.where("split"), within.select("site", "run").distinct(), sizes.select("site", "parts")))
    longer = longer.join(single.select("site", "site_urls").distinct(), "site").where(many)
    return single.mapInArrow(_single, longer.schema).union(longer)


def _group(of_site: str, part: Column) -> Column:
    return F.xxhash64(of_site, part.cast("long"))


def _grouped(rows: DataFrame) -> DataFrame:
    """`rows` with those of a `group` in one task, together."""
    return shipped(rows.repartition("group").sortWithinPartitions("group"))


def _of_parts(pages: DataFrame, within: DataFrame, sizes: DataFrame) -> DataFrame:
    """site, block, length, n_urls: the maximal blocks that lie in runs of `within`, over all parts
    of their sites.

    A block may be followed by one line throughout a part and by another in the next, or stand but
    once in each. So the runs go to every part of their site, which names the places where its pages
    leave them; these are then counted in every part, with what stands on either side. A fifth of the
    urls has a block, so runs and places grow with the lines of a page, not with the pages.
    """
    parts = sizes.where("parts > 1").select("site", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))

    def beside(asked: DataFrame) -> DataFrame:
        return _grouped(pages.select("group", "site", "url_id", "run").unionByName(asked.join(parts, "site").withColumn("group", _group("site", F.col("part"))).drop("part"), allowMissingColumns=True))

    places = beside(within).mapInArrow(_branches(CHUNK_LINES), "site string, block long, length int").distinct()
    counted = beside(places).mapInArrow(_counts(CHUNK_LINES), _COUNTS).groupBy("site", "block", "length")
    sides = [F.min("least_before"), F.max("most_before"), F.min("least_after"), F.max("most_after")]
    total = counted.agg(F.sum("n_urls").alias("n_urls"), (sides[0] < sides[1]).alias("opens"), (sides[2] < sides[3]).alias("closes"))
    return total.where("opens and closes and n_urls >= 2").drop("opens", "closes")


def _by_length(blocks: pa.ListScalar) -> dict[int, np.ndarray]:
    """Sorted hashes of a site's blocks by their length."""
    if not blocks.is_valid:
        return {}
    lengths, hashes = (blocks.values.field(i).to_numpy() for i in (0, 1))
    return {int(n): np.sort(hashes[lengths == n]) for n in np.unique(lengths)}


def _of_sites(sites: list, blocks: pa.ListArray) -> Iterator[dict[int, np.ndarray]]:
    """_by_length() of each row; rows of a site come together, so each site is read once or so."""
    last, known = None, {}
    for i, of_site in enumerate(sites):
        if of_site != last:
            last, known = of_site, _by_length(blocks[i])
        yield known


def _covered(ids: pa.ListScalar, blocks: dict[int, np.ndarray]) -> np.ndarray:
    """Positions (from 0, blank lines counted) of the lines that an occurrence of a block covers."""
    if not blocks or not ids.is_valid:
        return np.zeros(0, dtype=np.int64)
    full = ids.values
    place = np.flatnonzero(full.is_valid().to_numpy(zero_copy_only=False))
    own = full.drop_null().to_numpy(zero_copy_only=False)
    hashes = RunHashes(own)
    edge = np.zeros(len(own) + 1, dtype=np.int64)
    for length, wanted in blocks.items():
        if length > len(own):
            continue
        asked = hashes(np.arange(len(own) - length + 1), length)
        start = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, asked), len(wanted) - 1)] == asked)
        edge[start] += 1
        edge[start + length] -= 1
    return place[np.cumsum(edge[:-1]) > 0]


def _with_blocks(rows: DataFrame, own: DataFrame, min_urls: int, min_share: float) -> DataFrame:
    """`rows` (with site) and `blocks`, their site's repeated blocks.

    A repeated line stands on a fifth of the pages, so a site has at most five times as many as its
    average page has lines, however large the site. A site with a third of all rows makes one side
    of the join large, which adaptive execution splits.
    """
    blocks = repeated_blocks(own, min_urls, min_share).groupBy("site").agg(F.collect_list(F.struct("length", "block")).alias("blocks"))
    return shipped(rows.join(blocks, "site", "left"))


def found_lines(docs: DataFrame, min_urls: int = MIN_URLS, min_share: float = MIN_SHARE) -> DataFrame:
    """seq, line_no (from 1, blank lines counted) of every repeated line, each once."""
    own = line_ids(docs)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = _of_sites(batch.column(3).to_pylist(), batch.column(2))
            covered = [_covered(ids, blocks) for ids, blocks in zip(batch.column(1), known, strict=True)]
            sizes = [len(c) for c in covered]
            at = np.repeat(np.arange(batch.num_rows), sizes)
            numbers = (np.concatenate(covered) if covered else at) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(numbers.astype(np.int32))], names=["seq", "line_no"])

    kind = docs.select("seq").schema[0].dataType.simpleString()
    hit = _with_blocks(own, own, min_urls, min_share).where(F.col("blocks").isNotNull()).select("seq", "ids", "blocks", "site")
    return hit.mapInArrow(mark, f"seq {kind}, line_no int").distinct()


def cleaned(docs: DataFrame, min_urls: int = MIN_URLS, min_share: float = MIN_SHARE) -> DataFrame:
    """docs with `content` without its repeated lines and `removed`, their number (in place of a
    column of that name).

    Null content stays null; rows without a url stay as they are; rows delivered twice stay twice.
    """
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(site("url"), F.lit("")).alias("site"), "url", "content")
    keyed = keyed.select("row", "site", "content", F.when(F.col("url").isNotNull(), _ids("content", "site")).alias("ids"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            known = _of_sites(batch.column(4).to_pylist(), batch.column(3))
            for text, ids, blocks in zip(batch.column(1).to_pylist(), batch.column(2), known, strict=True):
                gone = set(_covered(ids, blocks).tolist()) if text is not None else set()
                texts.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone) if gone else text)
                removed.append(len(gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], names=["row", "text", "gone"])

    joined = _with_blocks(keyed, line_ids(docs), min_urls, min_share).select("row", "content", "ids", "blocks", "site")
    schema = StructType([joined.schema["row"], StructField("text", StringType()), StructField("gone", IntegerType())])
    out = joined.mapInArrow(strip, schema)
    return out.select(*[F.col("text").alias(c) if c == "content" else F.col(f"row.`{c}`") for c in docs.columns if c != "removed"], F.col("gone").alias("removed"))
