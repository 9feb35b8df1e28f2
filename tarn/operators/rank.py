"""BM25: query terms against postings, OR semantics, top k with ties by id."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import tokenize, tokenize_local
from tarn.operators.index import Index, fields_of

K1, B, LIMIT = 1.2, 0.75, 10


def idf(ndocs: int, df: int) -> float:
    return math.log(1 + (ndocs - df + 0.5) / (df + 0.5))


def saturation(tf: Column, dl: Column, avgdl: float, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def _wanted(terms: list[str]) -> list[str]:
    return [t.decode() for t in sorted({t.encode() for t in terms})]


def _nothing(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.lit(0.0).alias("score")).where(F.lit(False))


def scores(index: Index, terms: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """doc_id, score of every document with a query term.

    The isin filter reaches the postings' scan and a posting holds its document's length, so the one
    exchange is by doc_id, of matching postings. Before it the corpus' two numbers and a document
    frequency per query term come to the driver.
    """
    wanted = _wanted(terms)
    ndocs, avgdl = index.totals() if wanted else (0, 0.0)
    if not wanted or not ndocs or avgdl <= 0:
        return _nothing(index.postings)
    matched = index.postings.where(F.col("term").isin(wanted))
    weights = {r["term"]: idf(ndocs, r["df"]) for r in matched.groupBy("term").agg(F.count("*").alias("df")).collect()}
    if not weights:
        return _nothing(index.postings)
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("term"))
    part = weight * saturation(F.col("tf"), F.col("dl"), avgdl, k1, b)
    parts = matched.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("term", part.alias("w")))).alias("parts"))
    # summed in byte order of the terms, so a score doesn't depend on the partitioning
    return parts.select("doc_id", F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p["w"]).alias("score"))


def scan_scores(docs: DataFrame, terms: list[str], k1: float = K1, b: float = B, title: str | None = "title", snippet: str | None = "snippet", content: str | None = "content") -> DataFrame:
    """scores() straight from text without an index: two scans and no exchange but of aggregates."""
    wanted = _wanted(terms)
    if not wanted:
        return _nothing(docs)
    fields = fields_of(title, snippet, content)
    tokens = docs.select("doc_id", *[tokenize(f).alias(f"_{i}") for i, (f, _) in enumerate(fields)])

    def times(term: str) -> Column:
        total = F.lit(0).cast("long")
        for i, (_, weight) in enumerate(fields):
            total = total + F.size(F.filter(f"_{i}", lambda t: t == F.lit(term))).cast("long") * weight
        return total

    length = F.lit(0).cast("long")
    for i, (_, weight) in enumerate(fields):
        length = length + F.size(f"_{i}").cast("long") * weight
    counted = tokens.select("doc_id", length.alias("dl"), F.array(*[times(t) for t in wanted]).alias("tf"))
    numbers = counted.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"), *[F.count_if(F.col("tf")[i] > 0).alias(f"d{i}") for i in range(len(wanted))]).first()
    if not numbers["n"] or not numbers["total"]:
        return _nothing(docs)
    avgdl = numbers["total"] / numbers["n"]
    score = F.lit(0.0)
    for i in range(len(wanted)):
        tf = F.col("tf")[i]
        score = score + F.when(tf > 0, F.lit(idf(numbers["n"], numbers[f"d{i}"])) * saturation(tf, F.col("dl"), avgdl, k1, b)).otherwise(0.0)
    return counted.where(F.exists("tf", lambda x: x > 0)).select("doc_id", score.alias("score"))


def _numbered(found: DataFrame, k: int, where: DataFrame | None) -> DataFrame:
    if where is not None:
        found = found.join(where.select("doc_id"), "doc_id", "left_semi")
    best = found.orderBy(F.desc("score"), "doc_id").limit(k)
    # k rows: one list, numbered in its order
    listed = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id"))).alias("hits"))
    return listed.select(F.posexplode("hits").alias("at", "hit")).select((F.col("at") + 1).alias("rank"), "hit.doc_id", (-F.col("hit.s")).alias("score"))


def top(index: Index, terms: list[str], k: int = LIMIT, k1: float = K1, b: float = B, where: DataFrame | None = None) -> DataFrame:
    """rank, doc_id, score of the best k, score falling, id rising; `where` restricts to its doc_id."""
    return _numbered(scores(index, terms, k1, b), k, where)


def scan_top(docs: DataFrame, terms: list[str], k: int = LIMIT, k1: float = K1, b: float = B, where: DataFrame | None = None, **fields: str | None) -> DataFrame:
    """top() straight from text."""
    return _numbered(scan_scores(docs, terms, k1, b, **fields), k, where)


def search(index: Index, query: str, k: int = LIMIT, k1: float = K1, b: float = B, where: DataFrame | None = None) -> DataFrame:
    """Hits with their documents, joined after the cut: rank, doc_id, url, title, snippet, source, score."""
    hits = top(index, tokenize_local(query), k, k1, b, where)
    wanted = [c for c in ("url", "title", "snippet", "source") if c in index.docs.columns]
    return index.docs.select("doc_id", *wanted).join(F.broadcast(hits), "doc_id").select("rank", "doc_id", *wanted, "score").orderBy("rank")
