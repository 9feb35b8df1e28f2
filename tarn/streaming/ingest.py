"""Live ingestion: pages as they land, deduplicated, extracted and upserted by micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarn.functions.html import documents_of
from tarn.functions.urls import domain_of
from tarn.operators.index import Index
from tarn.plans.session import shipped
from tarn.schemas import DOCS
from tarn.sources import store

PAGES = "fetch_id long, url string, ok boolean, html string, error string, fetched_at timestamp"


def page_stream(spark: SparkSession, directory: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(directory)


def upsert_stream(pages: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Extract each micro-batch and upsert it into the stored index under `path`.

    Each batch writes its own documents as a layer. A batch that runs again after a failure upserts
    the same rows, so the result is the same.
    """

    def apply(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        good = batch.where("ok and html is not null and html <> ''")
        newest = good.join(good.groupBy("url").agg(F.max("fetch_id").alias("fetch_id")), ["url", "fetch_id"], "left_semi").dropDuplicates(["url"])
        rows = documents_of(newest.select("url", "html")).join(newest.select("url", F.col("fetch_id").alias("seq")), "url")
        empty = Index.build(spark.createDataFrame([], DOCS), next_id=1)
        store.upsert(spark, path, rows, empty)  # a damaged store is an error, never an empty one

    writer = pages.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def new_urls(offers: DataFrame, late: str = "1 hour", time: str = "queued_at") -> DataFrame:
    """Offers whose url wasn't offered within the watermark: bounded state. For a memory without
    horizon, anti-join the stored seen table in foreachBatch instead."""
    return offers.withWatermark(time, late).dropDuplicatesWithinWatermark(["url"])


def paced(offers: DataFrame, delay_ms: int = 100, late: str = "10 minutes") -> DataFrame:
    """url, domain, fetch_at_ms: offers of a stream, each at least `delay_ms` after its domain's last.

    State is one number per domain; it goes when the watermark is ten minutes past its last offer.
    """

    def pace(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        next_at = state.get[0] if state.exists else 0
        for batch in batches:
            rows = batch.sort_values(["priority", "seq"])
            at = []
            for offered in rows["at_ms"]:
                start = max(int(offered), next_at)
                at.append(start)
                next_at = start + delay_ms
            yield pd.DataFrame({"url": rows["url"].to_numpy(), "domain": key[0], "fetch_at_ms": at})
        state.update((next_at,))
        state.setTimeoutTimestamp(max(next_at, state.getCurrentWatermarkMs()) + 600_000)

    rows = offers.where("url is not null").withWatermark("queued_at", late).select(
        "url", "queued_at", domain_of("url").alias("domain"), F.coalesce("priority", F.lit(0)).alias("priority"), "seq", F.unix_millis("queued_at").alias("at_ms")
    )
    return shipped(rows).groupBy("domain").applyInPandasWithState(pace, "url string, domain string, fetch_at_ms long", "next_at long", "append", GroupStateTimeout.EventTimeTimeout)


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """start, event_type, n: counts by window of event time; batch or stream. Rows later than the
    watermark are dropped by a stream."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
