import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException

from tarn.operators import rank
from tarn.sources import store
from tarn.streaming import ingest


def page(i, url, words):
    return (i, url, True, f"<title>{words}</title><p>{words}</p>", "", dt.datetime(2025, 1, 1))


def test_upsert_stream(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "ix"), str(tmp_path / "ck")
    first = [page(1, "http://h/a", "old words"), page(2, "http://h/b", "other"), (3, "http://h/c", False, None, "x", dt.datetime(2025, 1, 1))]
    spark.createDataFrame(first, ingest.PAGES).coalesce(1).write.mode("append").parquet(src)
    ingest.upsert_stream(ingest.page_stream(spark, src), out, ck).awaitTermination()
    spark.createDataFrame([page(4, "http://h/a", "fresh words"), page(4, "http://h/a", "fresh words")], ingest.PAGES).coalesce(1).write.mode("append").parquet(src)
    ingest.upsert_stream(ingest.page_stream(spark, src), out, ck).awaitTermination()
    index = store.load(spark, out)
    assert {(r.doc_id, r.url) for r in index.docs.collect()} == {(1, "http://h/a"), (2, "http://h/b")}
    assert [r.doc_id for r in rank.search(index, "fresh").collect()] == [1] and index.lookup("old").count() == 0
    # a damaged pointer stops the stream and loses nothing
    newest = max((tmp_path / "ix").glob("manifest-*.json"))
    whole = newest.read_text()
    newest.write_text("{")
    (tmp_path / "ix" / f".{newest.name}.crc").unlink(missing_ok=True)
    spark.createDataFrame([page(5, "http://h/d", "late words")], ingest.PAGES).coalesce(1).write.mode("append").parquet(src)
    with pytest.raises(StreamingQueryException):
        ingest.upsert_stream(ingest.page_stream(spark, src), out, ck).awaitTermination()
    newest.write_text(whole)
    ingest.upsert_stream(ingest.page_stream(spark, src), out, ck).awaitTermination()
    assert store.load(spark, out).docs.count() == 3


def test_pacing_and_dedup_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    at = dt.datetime(2025, 1, 1)
    rows = [("http://h/1", 0, 1, at), ("http://h/2", 0, 2, at), ("http://g/1", 0, 3, at), ("http://h/1", 0, 4, at)]
    schema = "url string, priority int, seq long, queued_at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    ingest.paced(stream, 100).writeStream.format("memory").queryName("paced").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    times = {}
    for r in spark.table("paced").collect():
        times.setdefault(r.domain, []).append(r.fetch_at_ms)
    gaps = sorted(times["h"])
    assert [b - a for a, b in zip(gaps, gaps[1:], strict=False)] == [100, 100] and len(times["g"]) == 1
    ingest.new_urls(stream).writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("fresh").count() == 3


def test_event_windows(spark):
    at = dt.datetime(2025, 1, 1, 10, 59)
    df = spark.createDataFrame([(at, "a"), (at + dt.timedelta(minutes=2), "a"), (at, "b")], "ts timestamp, event_type string")
    assert sorted((r.event_type, r.n) for r in ingest.event_counts(df).collect()) == [("a", 1), ("a", 1), ("b", 1)]
    assert ingest.event_counts(df, "1 hour", slide="30 minutes").count() == 5
