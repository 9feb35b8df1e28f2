"""The inverted index as tables: postings, document, term and corpus statistics, upsert, delete."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import tokenize

# Weight of an occurrence by field.
TITLE_WEIGHT, SNIPPET_WEIGHT, CONTENT_WEIGHT = 3, 1, 1


def latest_versions(docs: DataFrame, seq: str = "seq", key: str = "url") -> DataFrame:
    """One row per url: the row of the largest seq. Null urls count as the empty url, which is a url.

    A grouped max over whole rows would buffer contents; the largest seq per url is found first
    over two narrow columns, then the rows are kept by a join, which AQE splits where a url is hot.
    """
    rows = docs.withColumn(key, F.coalesce(key, F.lit("")))
    newest = rows.groupBy(key).agg(F.max(seq).alias(seq))
    return rows.join(newest, [key, seq], "left_semi").dropDuplicates([key, seq])


def with_stable_ids(docs: DataFrame, seq: str = "seq", key: str = "url", name: str = "doc_id") -> DataFrame:
    """Latest version of each url with an id in order of first appearance: 1, 2, ..."""
    from tarn.plans.ids import dense_ids

    rows = docs.withColumn(key, F.coalesce(key, F.lit(""))).drop(name)
    firsts = dense_ids(rows.groupBy(key).agg(F.min(seq).alias("_first")), ["_first", key], name, start=1)
    return latest_versions(rows, seq, key).join(firsts.drop("_first"), key)


def fields_of(title: str | None, snippet: str | None, content: str | None) -> list[tuple[str, int]]:
    return [(f, w) for f, w in ((title, TITLE_WEIGHT), (snippet, SNIPPET_WEIGHT), (content, CONTENT_WEIGHT)) if f]


def length_of(title: str | None = "title", snippet: str | None = "snippet", content: str | None = "content") -> Column:
    """Weighted number of tokens of a row: no explode, no exchange."""
    total = F.lit(0).cast("long")
    for field, weight in fields_of(title, snippet, content):
        total = total + F.size(tokenize(field)).cast("long") * weight
    return total


def postings_of(docs: DataFrame, title: str | None = "title", snippet: str | None = "snippet", content: str | None = "content") -> DataFrame:
    """term, doc_id, tf, dl: weighted frequency per document, with the document's length, so that
    ranking needs no join. Documents without tokens have no row."""

    def weighed(field: str, weight: int) -> Column:
        return F.transform(tokenize(field), lambda t: F.struct(t.alias("term"), F.lit(weight).cast("long").alias("weight")))

    parts = [weighed(f, w) for f, w in fields_of(title, snippet, content)]
    # the length is summed below the explode: beside it, it would be worked out again for each token
    tokens = docs.select("doc_id", F.concat(*parts).alias("tokens"))
    sized = tokens.select("doc_id", F.aggregate("tokens", F.lit(0).cast("long"), lambda n, t: n + t["weight"]).alias("dl"), "tokens")
    rows = sized.select("doc_id", "dl", F.explode("tokens").alias("t"))
    return rows.groupBy(F.col("t.term").alias("term"), "doc_id").agg(F.sum("t.weight").alias("tf"), F.max("dl").alias("dl"))


def doc_lengths(docs: DataFrame, **fields: str | None) -> DataFrame:
    """doc_id, dl of every document, 0 where it has no tokens."""
    return docs.select("doc_id", length_of(**fields).alias("dl")).groupBy("doc_id").agg(F.sum("dl").alias("dl"))


def term_stats(postings: DataFrame) -> DataFrame:
    """term, df."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(lengths: DataFrame, terms: DataFrame) -> DataFrame:
    """One row: ndocs, total_terms, avgdl (0.0 without documents), nterms."""
    numbers = lengths.agg(F.count("*").alias("ndocs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_terms"))
    both = numbers.withColumn("nterms", F.lit(None).cast("long")).unionByName(
        terms.agg(F.lit(None).cast("long").alias("ndocs"), F.lit(None).cast("long").alias("total_terms"), F.count("*").alias("nterms"))
    )
    row = both.agg(*[F.max(c).alias(c) for c in ("ndocs", "total_terms", "nterms")])
    avgdl = F.when(F.col("ndocs") > 0, F.col("total_terms") / F.col("ndocs")).otherwise(F.lit(0.0))
    return row.select("ndocs", "total_terms", avgdl.alias("avgdl"), "nterms")


@dataclass(frozen=True)
class Index:
    """One immutable version of the index; changes give a new one."""

    docs: DataFrame
    postings: DataFrame
    lengths: DataFrame
    next_id: int = 1
    known: tuple[int, int] | None = None  # number of documents and of weighted terms, where a store keeps them

    @staticmethod
    def build(docs: DataFrame, next_id: int | None = None, **fields: str | None) -> Index:
        postings, lengths = postings_of(docs, **fields), doc_lengths(docs, **fields)
        if next_id is None:
            next_id = (docs.agg(F.max("doc_id")).first()[0] or 0) + 1
        return Index(docs, postings, lengths, next_id)

    @staticmethod
    def empty(like: Index) -> Index:
        none = F.lit(False)
        return Index(like.docs.where(none), like.postings.where(none), like.lengths.where(none), 1)

    def stats(self) -> DataFrame:
        return corpus_stats(self.lengths, term_stats(self.postings))

    def totals(self) -> tuple[int, float]:
        """Number of documents and their average length: two numbers, on the driver."""
        if self.known is not None:
            return self.known[0], self.known[1] / self.known[0] if self.known[0] else 0.0
        row = self.lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first()
        return row["n"], row["total"] / row["n"] if row["n"] else 0.0

    def lookup(self, term: str) -> DataFrame:
        """doc_id, tf of one term: the filter reaches the scan of stored postings."""
        return self.postings.where(F.col("term") == term).select("doc_id", "tf")

    def document(self, doc_id: int) -> DataFrame:
        return self.docs.where(F.col("doc_id") == doc_id)

    def remove(self, ids: DataFrame) -> Index:
        """Without the documents in `ids` (doc_id); unknown ids change nothing, ids aren't reused."""
        gone = ids.select("doc_id").distinct()
        return Index(*(t.join(gone, "doc_id", "left_anti") for t in (self.docs, self.postings, self.lengths)), self.next_id)

    def changed(self, changes: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """(documents, gone, next_id) that an upsert of `changes` comes to: the new versions with
        their ids, the ids of the versions that they replace, and the next free id.

        `changes` needs seq and the document columns; the last seq of a url wins. A known url keeps
        its id, new ones get the next, in order of appearance.
        """
        from tarn.plans.ids import dense_ids

        rows = changes.drop("doc_id")
        latest = latest_versions(rows)
        known = self.docs.select("url", "doc_id")
        kept = latest.join(known, "url")
        new = latest.join(known, "url", "left_anti")
        firsts = rows.withColumn("url", F.coalesce("url", F.lit(""))).groupBy("url").agg(F.min("seq").alias("_first"))
        ids = dense_ids(firsts.join(known, "url", "left_anti"), ["_first", "url"], "doc_id", start=self.next_id)
        fresh = kept.unionByName(new.join(ids.drop("_first"), "url")).drop("seq")
        next_id = (ids.agg(F.max("doc_id")).first()[0] or self.next_id - 1) + 1
        return fresh.select(*[c for c in self.docs.columns if c in fresh.columns]), kept.select("doc_id"), next_id

    def upsert(self, changes: DataFrame) -> Index:
        """Replace or add documents by url, see changed()."""
        fresh, gone, next_id = self.changed(changes)
        rest, own = self.remove(gone), Index.build(fresh, next_id=0)
        return Index(
            rest.docs.unionByName(own.docs, allowMissingColumns=True),
            rest.postings.unionByName(own.postings),
            rest.lengths.unionByName(own.lengths),
            next_id,
        )
