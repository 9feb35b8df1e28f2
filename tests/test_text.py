import random

import pytest
from pyspark.sql import functions as F

from tarn.functions.text import FOLD_FROM, FOLD_TO, TOKEN_RANGES, query_terms, tokenize, tokenize_bytes, tokenize_local

CASES = [
    ("Hello, World!", ["hello", "world"]),
    ("C++20 std::format v3.1", ["c", "20", "std", "format", "v3", "1"]),
    ("foo_bar", ["foo", "bar"]),
    ("Résumé café", ["résumé", "café"]),
    ("搜索引擎 索引", ["搜索引擎", "索引"]),
    ("", []),
    (" \t\n ", []),
    (None, []),
    ("Źź Ÿ Ё İ", ["ŹŻ", "Ź", "Ё", "ı"]),
    ("https://example.com/path?q=1", ["https", "example", "com", "path", "q", "1"]),
    ("สวัสดี", []),
    ("×÷", []),
]


def test_tokenize_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", tokenize("t").alias("x")).collect()}
    assert got == {i: x for i, (_, x) in enumerate(CASES)}
    assert [tokenize_local(t) for t, _ in CASES] == [x for _, x in CASES]


@pytest.mark.parametrize(
    ("data", "expected"),
    [
        (b"abc\xff\xfe def", ["abc", "def"]),
        (b"abc\xc0\x80\x80xyz", ["abc", "xyz"]),
        (b"abc\xe2\x82", ["abc"]),
        (b"a\xed\xa0\x80b", ["a", "b"]),
        (b"a\xf5\x80\x80\x80b", ["a", "b"]),
        (b"", []),
    ],
)
def test_malformed_bytes_separate(spark, data, expected):
    assert spark.createDataFrame([(bytearray(data),)], "b binary").select(tokenize_bytes("b")).first()[0] == expected


def test_fuzz_against_a_loop(spark):
    def slow(text):
        fold = dict(zip(FOLD_FROM, FOLD_TO, strict=True))
        out, run = [], ""
        for c in [*text, " "]:
            if any(a <= ord(c) <= b for a, b in TOKEN_RANGES):
                run += fold.get(c, c)
            elif run:
                out.append(run)
                run = ""
        # a fold may leave the token class only for characters outside it
        return out

    random.seed(7)
    points = [*range(0x20, 0x260), *range(0x370, 0x500), 0x5D0, 0x627, 0x905, 0x1F00, 0x3042, 0x4E2D, 0xAC00, 0xE01, 0x2019, 0x1F600]
    texts = ["".join(chr(random.choice(points)) for _ in range(random.randint(0, 60))) for _ in range(800)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", tokenize("t").alias("x")).collect()}
    assert all(got[i] == slow(t) for i, t in enumerate(texts))


def test_query_terms_are_distinct_and_sorted(spark):
    assert spark.range(1).select(query_terms(F.lit("b a B é a"))).first()[0] == ["a", "b", "é"]
