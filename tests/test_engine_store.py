import json

import pytest
from pyspark.errors import PySparkException

from tarn.__main__ import run
from tarn.api import Engine, cut_bytes, timed_search
from tarn.operators import rank
from tarn.sources import snapshot, store
from tarn.sources.snapshot import Document, SnapshotError


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.seed()
    return e


def test_search_is_case_blind_and_by_source(engine):
    assert {r.source for r in engine.search("ONION").collect()} == {"onion"}
    assert {r.source for r in engine.search("index").collect()} == {"onion", "clearweb"}
    hits, ms = timed_search(engine, "index")
    assert hits and ms > 0


def test_json_surface(engine):
    code, body = engine.request("GET", "/search", "q=onion+room")
    found = json.loads(body)
    assert code == 200 and found["query"] == "onion room" and found["count"] == len(found["results"]) > 0
    assert set(found["results"][0]) == {"title", "url", "snippet", "score", "source"}
    assert json.loads(engine.request("POST", "/search", body='{"q": "nothinglikeit"}')[1])["results"] == []
    assert engine.request("GET", "/search")[0] == 400 and engine.request("POST", "/search", body="{bad")[0] == 400
    assert engine.request("GET", "/nowhere")[0] == 404 and engine.request("POST", "/search", body="x" * 70_000)[0] == 413
    status = json.loads(engine.request("GET", "/status")[1])
    assert status["documents"] == 4 and status["fetcher"] == "stub" and status["crawler_running"] is False
    assert engine.request("GET", "/crawl", "url=%20")[0] == 400
    assert "<li>[onion]" in engine.search_html("onion") and "&lt;b&gt;" in engine.search_html("<b>")


def test_query_is_cut_by_bytes():
    assert cut_bytes("é" * 200) == "é" * 128 and cut_bytes("a" + "é" * 200, 4) == "aé"


def test_crawl_adds_pages(spark):
    e = Engine(spark)
    e.seed()
    code, body = e.request("POST", "/crawl", body='{"url": "h.example/"}')
    assert code == 200 and json.loads(body)["crawled"] == 6
    assert e.status().first().documents == 10
    assert e.dashboard()["activity"].count() == 6
    e.crawl(["http://h.example/"])
    assert e.status().first().documents == 10
    told = []
    e.crawl(["http://k.example/"], on_level=lambda docs, events: told.append(events.count()), stopped=lambda: True)
    assert told == [1] and e.status().first().documents == 11
    e.remove([1])
    assert e.status().first().documents == 10
    e.clear()
    assert e.status().first().documents == 0 and e.search("onion").count() == 0
    with pytest.raises(ValueError, match="no url"):
        e.crawl(["  "])


def test_shell(engine, tmp_path):
    assert "hits in" in run(engine, "search onion") and "hits in" in run(engine, "onion")
    assert "search TEXT" in run(engine, "help") and '"documents":4' in run(engine, "status")
    assert run(engine, f"save {tmp_path}/ix").startswith("v-")
    assert run(engine, f"load {tmp_path}/ix") == "loaded" and run(engine, "activity") == ""


def test_store_round_trip(spark, engine, tmp_path):
    path = str(tmp_path / "ix")
    before = [tuple(r) for r in engine.search("index").collect()]
    store.save(engine.index, path)
    store.save(engine.index, path)
    back = store.load(spark, path)
    assert [tuple(r) for r in rank.search(back, "index").collect()] == before and back.next_id == engine.index.next_id
    with pytest.raises(store.StoreError):
        store.load(spark, str(tmp_path / "none"))
    assert back.known == (4, engine.index.lengths.agg({"dl": "sum"}).first()[0])
    with pytest.raises(store.MissingStore):
        store.load(spark, str(tmp_path / "none"))


CHANGE = "seq long, url string, title string, snippet string, content string, source string, depth int"


def damage(directory, text="{"):
    newest = max(directory.glob("manifest-*.json"))
    newest.write_text(text)
    (directory / f".{newest.name}.crc").unlink(missing_ok=True)


def test_layers(spark, engine, tmp_path, monkeypatch):
    path = str(tmp_path / "ix")
    store.save(engine.index, path)
    index = engine.index
    for i in range(4):
        rows = [(1, engine.index.docs.first().url, f"again {i}", "", "words of change", "clearweb", 0), (2, f"http://new{i}/", "new", "", f"layer number{i}", "clearweb", 0)]
        changes = spark.createDataFrame(rows, CHANGE)
        monkeypatch.setattr(store, "MAX_LAYERS", 3)
        store.upsert(spark, path, changes)
        index = index.upsert(changes)
        index = type(index)(*(spark.createDataFrame(t.collect(), t.schema) for t in (index.docs, index.postings, index.lengths)), index.next_id)
        back = store.load(spark, path)
        for own, there in ((index.docs, back.docs), (index.postings, back.postings), (index.lengths, back.lengths)):
            assert sorted(map(str, (r.asDict() for r in own.collect()))) == sorted(str({c: r[c] for c in own.columns}) for r in there.collect())
        assert back.next_id == index.next_id and back.known == (4 + i + 1, index.lengths.agg({"dl": "sum"}).first()[0])
    # the fourth upsert passed the number of layers once and wrote a base
    assert len(list((tmp_path / "ix").glob("manifest-*.json"))) == 6


def test_damaged_store_is_refused(spark, engine, tmp_path):
    path = str(tmp_path / "ix")
    store.save(engine.index, path)
    changes = spark.createDataFrame([(1, "http://x/", "t", "", "c", "clearweb", 0)], CHANGE)
    for text in ("{", "[]", '{"format": 99}', '{"format": 2}'):
        damage(tmp_path / "ix", text)
        with pytest.raises(store.StoreError):
            store.upsert(spark, path, changes, engine.index)
        with pytest.raises(store.StoreError):
            store.load(spark, path)


def test_crash_before_the_pointer_moves(spark, engine, tmp_path, monkeypatch):
    path = str(tmp_path / "ix")
    store.save(engine.index, path)
    changes = spark.createDataFrame([(1, "http://x/", "t", "", "c", "clearweb", 0)], CHANGE)

    def crash(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(store, "_publish", crash)
        with pytest.raises(OSError, match="gone"):
            store.upsert(spark, path, changes)
    assert store.load(spark, path).docs.count() == 4
    (tmp_path / "ix" / ".manifest.0123").write_text("half")  # left by a writer that died
    store.upsert(spark, path, changes)
    assert store.load(spark, path).docs.count() == 5
    with pytest.raises(store.StoreError, match="someone else"):
        store._publish(spark, path, "manifest", {}, 0)


def test_encrypted_round_trip(spark, engine, tmp_path):
    path = str(tmp_path / "sealed")
    store.save_encrypted(engine.index.docs, path, "right")
    assert {tuple(r) for r in store.load_encrypted(spark, path, "right").collect()} == {tuple(r) for r in engine.index.docs.collect()}
    with pytest.raises(store.StoreError):
        store.load_encrypted(spark, path, "wrong")
    stored = b"".join(p.read_bytes() for p in (tmp_path / "sealed").rglob("*") if p.is_file())
    assert b"pond" not in stored
    (pointer,) = (tmp_path / "sealed").glob("sealed-*.json")
    sealed = json.loads(pointer.read_text())
    version = f"{path}/{sealed['version']}"
    broken = spark.read.parquet(version).selectExpr("concat(substring(sealed, 1, length(sealed) - 1), x'00') as sealed")
    broken.write.parquet(f"{path}/v2")
    sealed["version"] = "v2"
    (tmp_path / "sealed" / f".{pointer.name}.crc").unlink(missing_ok=True)
    pointer.write_text(json.dumps(sealed))
    with pytest.raises(PySparkException):
        store.load_encrypted(spark, path, "right").collect()


def test_snapshot_codec():
    docs = [Document("u", "t", "", "é\x00", "onion", 0), Document("", "", "", "", "clearweb", 3)]
    data = snapshot.serialize(docs)
    assert snapshot.deserialize(data) == docs and snapshot.deserialize(data + b"more") == docs
    for bad in (b"", b"garbage", data[:-1], data[:9], data.replace(b"TARNSN\x01", b"TARNSN\x02"), b"TARNSN" + b"\x01\x00\x00\x00" + b"\xff" * 4):
        with pytest.raises(SnapshotError):
            snapshot.deserialize(bad)


def test_engine_snapshot(spark, engine):
    data = engine.export_snapshot()
    other = Engine(spark)
    other.import_snapshot(data)
    assert other.index.docs.count() == 4 and other.search("onion").count() == engine.search("onion").count()
