import pytest
from pyspark.sql import functions as F

from tarn.functions import encoding, jsonio
from tarn.functions.hashing import fnv1a, fnv1a_hex
from tarn.operators import activity, netpolicy, sketch


def one(spark, expression):
    return spark.range(1).select(expression).first()[0]


def test_escape_and_decode(spark):
    assert one(spark, encoding.escape_html(F.lit("& < > \" '"))) == "&amp; &lt; &gt; &quot; &#39;"
    assert one(spark, encoding.url_decode(F.lit("a+b%20c%C3%A9"))) == "a b cé"
    assert one(spark, encoding.url_decode(F.lit("%zz"))) is None
    assert one(spark, encoding.query_param(F.lit("x=1&q=a%20b&q=c"), "q")) == "a%20b"


@pytest.mark.parametrize("data", [b"", b"f", b"fo", b"foo", b"\xff\xfe\xfd\xfc", bytes(range(200))])
def test_base64url(spark, data):
    df = spark.createDataFrame([(bytearray(data),)], "b binary")
    coded = df.select(encoding.to_base64url("b").alias("c"))
    text = coded.first()[0]
    assert "=" not in text and "+" not in text and "/" not in text and "\n" not in text
    assert bytes(coded.select(encoding.from_base64url("c")).first()[0]) == data


def test_base64url_skips_junk(spark):
    assert bytes(one(spark, encoding.from_base64url(F.lit("Zm 9v!+/-_")))) == bytes(one(spark, F.unbase64(F.lit("Zm9v+/+/"))))
    assert len(encoding.passphrase(3)) == 8 and len(encoding.random_bytes(5)) == 5


@pytest.mark.parametrize("text", ["", "a", "example.com", "żółć 搜索", "x" * 300])
def test_fnv(spark, text):
    assert one(spark, fnv1a_hex(F.lit(text))) == f"{fnv1a(text.encode()):016x}"


def test_json_parse_and_dump():
    value, wrong = jsonio.parse('{"b": 1, "a": [true, null, "\\u00e9\\ud83d\\ude00"], "b": 2.5}')
    assert not wrong and value.find("b") == 1 and [k for k, _ in value] == ["b", "a", "b"]
    assert jsonio.dump(value) == '{"b":1,"a":[true,null,"é😀"],"b":2.5}'
    for bad in ("", '{"a":}', "[1,2", "hello", "[1,2]x", "NaN", "[" * 5000):
        assert jsonio.parse(bad)[1]
    assert jsonio.dump({"x": [], "y": {}, "z": 1234567.89}) == '{"x":[],"y":{},"z":1.23457e+06}'
    assert jsonio.dump({"x": [1]}, pretty=True) == '{\n  "x": [\n    1\n  ]\n}'
    assert jsonio.as_number("x", 3) == 3 and jsonio.as_bool(1) is False and jsonio.as_string(None, "d") == "d"
    assert jsonio.dump("a\"\\\b\n\x01/") == '"a\\"\\\\\\b\\n\\u0001/"'


def test_json_columns(spark):
    df = spark.createDataFrame([('{"a":{"n":2,"s":"x","t":true}}',), ("{bad",), (None,)], "j string")
    got = [tuple(r) for r in df.select(jsonio.get_number("j", "$.a.n"), jsonio.get_string("j", "$.a.s"), jsonio.get_bool("j", "$.a.t"), jsonio.get_string("j", "$.a.n", "no")).collect()]
    assert got == [(2.0, "x", True, "no"), (0.0, "", False, "no"), (0.0, "", False, "no")]


def test_bloom_geometry(spark):
    assert sketch.geometry(10_000, 0.01) == (95_851, 7)
    assert sketch.geometry(0, 2) == sketch.geometry(1, 0.5) and sketch.geometry(5, 0) == sketch.geometry(5, 1e-4)
    df = spark.createDataFrame([(10_000, 0.01), (0, 2.0), (5, 0.0)], "n long, p double")
    assert [tuple(r) for r in df.select(*sketch.geometry_columns(F.col("n"), F.col("p"))).collect()] == [sketch.geometry(10_000, 0.01), sketch.geometry(0, 2), sketch.geometry(5, 0)]


def test_bloom_membership(spark):
    bits, hashes = sketch.geometry(2000)
    keys = spark.range(2000).select(F.concat(F.lit("in-"), "id").alias("k"))
    held = sketch.build(keys, "k", bits, hashes)
    assert sketch.probe(keys, "k", held, bits, hashes).where("not maybe").count() == 0
    others = spark.range(2000).select(F.concat(F.lit("out-"), "id").alias("k")).unionByName(spark.createDataFrame([(None,)], "k string"))
    wrong = sketch.probe(others, "k", held, bits, hashes)
    assert wrong.count() == 2001 and wrong.where("maybe").count() < 100
    assert sketch.probe(others, "k", held.where("false"), bits, hashes).where("maybe").count() == 0


def test_proxies(spark):
    df = spark.createDataFrame([("a:1, b:2",), ("c:3",), ("d:70000",), ("nocolon",), (":9050",), ("",), (None,)], "spec string")
    assert {(r.host, r.port) for r in netpolicy.parse_proxies(df).collect()} == {("a", 1), ("b", 2), ("c", 3), ("127.0.0.1", 9050)}
    assert one(spark, netpolicy.socks_url(F.lit("h"), F.lit(1))) == "socks5h://h:1"


def test_backoff_and_retries(spark):
    got = [r[0] for r in spark.range(7).select(netpolicy.backoff_ms(F.col("id"))).collect()]
    assert got == [250, 500, 1000, 2000, 4000, 8000, 8000]
    jittered = spark.range(50).select(netpolicy.backoff_ms(F.col("id") % 8, jitter=netpolicy.backoff_jitter(seed=1)).alias("b"))
    assert jittered.where("b > 8000 or b < 250").count() == 0
    assert one(spark, netpolicy.max_retries(F.lit("http://x.onion"), F.lit(5), 2)) == 2
    assert [one(spark, netpolicy.max_retries(F.lit("http://x"), F.lit(n))) for n in (0, 1, 3)] == [0, 0, 2]


def test_round_robin_and_pool(spark):
    pool = spark.createDataFrame([("a", 1, True, None), ("b", 2, False, 100), ("c", 3, False, 6000)], "host string, port int, healthy boolean, ms_since_failure long")
    asked = spark.range(5).withColumnRenamed("id", "request_id")
    assert [r.host for r in netpolicy.assign_round_robin(asked, pool).orderBy("request_id").collect()] == ["a", "c", "a", "c", "a"]
    assert {r.host for r in netpolicy.assign_round_robin(asked, pool.where("host = 'b'")).collect()} == {None}
    status = spark.createDataFrame([("down",), ("up",)], "status string")
    assert [netpolicy.pool_status(x).first()[0] for x in (status, status.where("status = 'down'"), status.where("false"))] == ["up", "down", "unknown"]


def test_isolation_tokens(spark):
    a, b = (one(spark, netpolicy.isolation_token(F.lit(u))) for u in ("http://h.example/a", "http://h.example/b?c"))
    assert a == b and len(a) == 18 and a.startswith("s-")
    assert one(spark, netpolicy.isolation_token(F.lit("http://h/a"), "url")) != one(spark, netpolicy.isolation_token(F.lit("http://h/b"), "url"))
    assert one(spark, netpolicy.isolation_token(F.lit("x"), "none")) == ""


def test_circuits_rotate(spark):
    url = F.lit("http://h.example/")
    tokens = [one(spark, netpolicy.circuit_token(url, F.lit(t), 1000)) for t in (0, 999, 1000)]
    assert tokens[0] == tokens[1] != tokens[2] and one(spark, netpolicy.circuit_token(url, F.lit(5))) == one(spark, netpolicy.isolation_token(url))


def test_activity_keeps_the_newest(spark):
    df = spark.createDataFrame([(i,) for i in range(4)], "i long").select(F.timestamp_seconds("i").alias("ts"), "i")
    assert [r.i for r in activity.recent(df, 3).collect()] == [1, 2, 3]
    assert [r.i for r in activity.recent(df, 0).collect()] == [3]
    assert one(spark, activity.format_time(F.timestamp_seconds(F.lit(0)))) == "1970-01-01 00:00:00"


def test_base32_and_hex():
    from tarn.functions import encoding

    for n in range(40):
        data = encoding.random_bytes(n)
        coded = encoding.to_base32(data)
        assert encoding.from_base32(coded) == encoding.from_base32(coded.upper()) == data and "=" not in coded and coded == coded.lower()
    assert encoding.to_base32(b"foobar") == "mzxw6ytboi" and len(encoding.random_hex(8)) == 16
