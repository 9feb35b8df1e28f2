import base64
import math
import random
import time
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.llm import bpe, mixing

TEXTS = [
    None, "", " ", "Hello, world! It's 2024.", "<|endoftext|> stays text", "x" * 3000, "ha" * 500, " \n\n\t  a ", "naïve café — 搜索引擎 😀", "don't I'LL we've",
    "a\u0000b�", "Привет, мир", "\r\n\r\n", "1234567890" * 5, "  leading", "trailing  ",
]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(str(Path(bpe.TOKENIZER_DIR, "byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids(spark, reference):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] * 2 + [(None, "a", "x")], "doc_id long, text string, ids string")
    got = bpe.token_ids(df).collect()
    assert len(got) == 2 * len(TEXTS) + 1
    assert all(r.ids == reference("a" if r.doc_id is None else TEXTS[r.doc_id]) for r in got)
    assert bpe.token_ids(df.where("false")).count() == 0


def test_round_trip(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    back = bpe.texts_of(bpe.token_ids(df)).collect()
    assert len(back) == len(TEXTS) and all(r.text == (TEXTS[r.doc_id] or "") for r in back)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [10**6])], "doc_id long, ids array<int>")
    assert [r.text for r in bpe.texts_of(odd).collect()] == ["", "", ""]


def test_long_words(reference):
    rng = random.Random(3)
    encoder = bpe.WordEncoder(VOCABULARY)
    for letters, n in (("abcdefghijklmnopqrstuvwxyz", 1 << 20), ("etaoinshr", 6000), ("x", 1 << 20), ("ab", 20_000)):
        word = "".join(rng.choice(letters) for _ in range(n))
        began = time.time()
        (ids,) = encoder.learn({word}).values()
        assert time.time() - began < 60
        assert n > 100_000 or ids.tolist() == reference(word)
        assert bpe.Decoder(VOCABULARY)([ids.tolist()]) == [word]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_any_text(texts):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t.encode("utf-8", "replace").decode() for t in texts])], names=["id", "text"])
    ids = [x for b in bpe.encode_batches(iter([batch]), VOCABULARY) for x in b.column(1).to_pylist()]
    assert DECODER(ids) == batch.column(1).to_pylist()


VOCABULARY = bpe.read_vocabulary()
DECODER = bpe.Decoder(VOCABULARY)


def test_other_vocabulary(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(bpe.TOKENIZER_DIR, "byte_bpe_multi_50k.tiktoken").read_bytes().splitlines())}
    own = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    assert all(r.ids == own.encode_ordinary(TEXTS[r.doc_id] or "") for r in bpe.token_ids(df, vocabulary="byte_bpe_multi_50k.tiktoken").collect())


def mean_of(low, steps):
    return low + sum(1 - s for s in steps)


def test_cut_poisson():
    for mean, cap in ((0.1, 1), (0.9, 1), (1.5, 2), (1.99, 2), (3.0, 10), (0.5, 4), (600, 1000), (999.5, 1000), (900, 2**31 - 1), (40_000, 10**6)):
        low, steps = mixing.distribution(mean, cap)
        assert mean_of(low, steps) == pytest.approx(mean, rel=1e-6) and steps == sorted(steps) and low + len(steps) <= cap
    assert mixing.distribution(5, 2) == (2, []) and mixing.distribution(0, 2) == (0, []) and mixing.distribution(1, 0) == (0, [])


def test_distribution_is_poisson_cut_at_the_cap():
    rate, cap = 2.3, 5
    low, steps = mixing.distribution(mixing.cut_mean(rate, cap), cap)
    p = [math.exp(-rate) * rate**k / math.factorial(k) for k in range(cap)]
    assert low == 0 and steps == pytest.approx([sum(p[: k + 1]) for k in range(cap)], abs=1e-6)


DOCUMENT, TARGET = "doc_id long, text string, source string", "source string, weight double, max_repeats int"


def test_shares(spark):
    rows = [(i, f"word {i} of a text", "big") for i in range(600)] + [(1000 + i, f"small text {i} here", " Small ") for i in range(200)]
    rows += [(5000, "x", "tiny"), (5001, None, "big"), (5002, "y", None), (5003, "z", "other"), (5004, "", "mute"), (5005, None, "mute")]
    documents = spark.createDataFrame(rows, DOCUMENT)
    targets = spark.createDataFrame([("big", 1.0, 3), ("small", 1.0, 4), ("tiny", 1.0, 2), ("gone", 0.5, 9), ("mute", 0.5, 2), ("big", 1.0, 3), ("big", 0.5, 9), (None, 1.0, 1), ("zero", 0.0, 1), ("free", 1.0, None)], TARGET)
    plan = {r.source: r for r in mixing.budgets(mixing.sized(documents, targets), targets).collect()}
    assert set(plan) == {"big", "small", "tiny", "gone", "mute"} and plan["gone"].own_tokens == 0 and plan["big"].max_repeats == 3
    short = {s for s, r in plan.items() if r.own_tokens * r.max_repeats < r.wanted_tokens}
    assert short == {"tiny", "gone", "mute"} == {r.source for r in mixing.unreachable(documents, targets).collect()}
    got = {r.source: r for r in mixing.shares(documents, targets).collect()}
    assert {s for s, r in got.items() if not r.reachable} == short
    assert all((r.most_copies or 0) <= r.max_repeats for r in got.values()) and got["tiny"].most_copies == 2 and got["big"].n_records == 601
    assert got["big"].tokens == pytest.approx(plan["big"].wanted_tokens, rel=0.15) and got["small"].tokens == pytest.approx(plan["small"].wanted_tokens, rel=0.15)
    assert sum(r.share_reached for r in got.values()) == pytest.approx(1)
    mixed = [tuple(r) for r in mixing.mixed(documents, targets).collect()]
    assert sorted(map(str, mixed)) == sorted(map(str, mixing.mixed(documents.union(documents.limit(50)), targets).collect())) or len(set(mixed)) == len(mixed)
    assert len(mixed) == len(set(mixed)) == sum(r.n_copies for r in got.values())
    texts = {r[0]: r[1] for r in rows}
    assert all(texts[d] == t for d, _, _, t in mixed) and {k for _, k, _, _ in mixed} <= {"big", "small", "tiny", "mute"}


def test_a_small_source_is_repeated_hundreds_of_times(spark):
    documents = spark.createDataFrame([(i, "a few words that count", "big") for i in range(1500)] + [(9000, "a few words that count", "rare")], DOCUMENT)
    targets = spark.createDataFrame([("big", 1.0, 5), ("rare", 1.0, 1000)], TARGET)
    got = {r.source: r for r in mixing.shares(documents, targets).collect()}
    assert got["rare"].reachable and 650 < got["rare"].n_copies < 850


def test_found_comes_from_the_replication(spark, monkeypatch):
    documents = spark.createDataFrame([(i, "a b c", "s" if i % 2 else "t") for i in range(40)], DOCUMENT)
    targets = spark.createDataFrame([("s", 1.0, 2), ("t", 9.0, 1)], TARGET)
    assert [r.source for r in mixing.unreachable(documents, targets).collect()] == ["t"]
    monkeypatch.setattr(mixing, "distribution", lambda mean, cap: (0, []))
    assert mixing.unreachable(documents, targets).count() == 0  # no record is used, so none is at its cap


def test_repeated_rows_and_empty_tables(spark):
    documents = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s")], DOCUMENT)
    targets = spark.createDataFrame([("s", 1.0, 1)], TARGET)
    assert mixing.budgets(mixing.sized(documents, targets), targets).first().own_tokens == 3
    assert mixing.unreachable(documents, targets).count() == 0 and mixing.mixed(documents, targets).count() == 1
    assert mixing.shares(documents, targets.where("false")).count() == 0 and mixing.mixed(documents.where("false"), targets).count() == 0
    assert [r.source for r in mixing.unreachable(documents.where("false"), targets).collect()] == []
