import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.llm import site_lines
from tarn.llm.site_lines import suffix_array

DOC = "seq long, url string, content string"


def key(line):
    return " ".join(re.sub(r"\d+", "0", line.lower()).split())


def brute(rows):
    sites, under = defaultdict(set), defaultdict(set)
    host = lambda u: re.sub(r":\d*$", "", u.split("://", 1)[1].split("/")[0]).lower()
    rows = [r for r in rows if r[1] is not None]
    for _, u, c in rows:
        sites[host(u)].add(u)
        for line in (c or "").split("\n"):
            if key(line):
                under[host(u), key(line)].add(u)
    return {
        (s, i)
        for s, u, c in rows
        for i, line in enumerate((c or "").split("\n"), 1)
        if key(line) and len(under[host(u), key(line)]) >= 6 and 5 * len(under[host(u), key(line)]) >= len(sites[host(u)])
    }


def test_against_brute_force(spark, monkeypatch):
    random.seed(3)
    foot = ["Share this (12 times)", "© 2024 Site", "  MENU  ", "Share  THIS (7 times)\r", "", "read on"]
    rows = []
    for i in range(400):
        host = random.choice(["Big.example", "big.example:80", "small.example", "tiny.example"])
        body = [f"text {random.randint(0, 40)} of page{i % 90}", *random.sample(foot, random.randint(0, 5)), "", f"own {chr(97 + i % 26)}{i // 26}"]
        random.shuffle(body)
        rows.append((i, f"http://{host}/p{i % 120}", random.choice(["\n".join(body)] * 9 + ["", None])))
    rows += rows[:30] + [(900, None, "menu"), (901, "http://big.example/x", None)]
    df = spark.createDataFrame(rows, DOC)
    got = [(r.seq, r.line_no) for r in site_lines.found_lines(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    kept = {(r.seq, r.url): (r.content, r.removed) for r in site_lines.cleaned(df).collect()}
    for s, u, c in rows:
        if u is not None and c is not None:
            gone = {i for q, i in got if q == s}
            assert kept[s, u] == ("\n".join(x for i, x in enumerate(c.split("\n"), 1) if i not in gone), len(gone))
    assert kept[900, None] == ("menu", 0)


def test_small_chunks_sum_up(spark, monkeypatch):
    rows = [(i, f"http://h/{i}", f"menu\nown words{chr(97 + i % 26)}\nfoot") for i in range(40)]
    df = spark.createDataFrame(rows, DOC)
    monkeypatch.setattr(site_lines, "CHUNK_LINES", 5)
    assert {(r.seq, r.line_no) for r in site_lines.found_lines(df).collect()} == brute(rows)


def test_blocks(spark):
    rows = [(i, f"http://h/{i}", f"a{chr(97 + i)}x\none\ntwo\nthree\nb{chr(97 + i)}y") for i in range(10)] + [(20 + i, f"http://h/x{i}", f"two\nthree\nc{chr(97 + i)}z") for i in range(6)]
    got = sorted((r.length, r.n_urls) for r in site_lines.repeated_blocks(site_lines.line_ids(spark.createDataFrame(rows, DOC))).collect())
    assert got[:3] == [(1, 10), (1, 16), (1, 16)] and [n for n, _ in got[3:]] == [2, 3]
    assert 6 <= got[3][1] <= 16 and 6 <= got[4][1] <= 10  # of the tasks in which they are maximal


def blocks_of(df):
    """Hash and length to (site, n_urls, site_urls) of each block of several lines."""
    rows = site_lines.repeated_blocks(site_lines.line_ids(df)).where("length > 1").collect()
    out = {(r.block, r.length): (r.site, r.n_urls, r.site_urls) for r in rows}
    assert len(out) == len(rows)
    return out


def brute_site_blocks(df):
    """What blocks_of() is to give, by trying all runs of all documents of a site."""
    runs, urls, out = defaultdict(list), defaultdict(set), {}
    for n, r in enumerate(site_lines.line_ids(df).collect()):
        ids = [x for x in r.ids if x is not None]
        urls[r.site].add(r.url)
        for i in range(len(ids)):
            for j in range(i + 2, len(ids) + 1):
                runs[r.site, tuple(ids[i:j])].append((r.url, ids[i - 1] if i else ("start", n), ids[j] if j < len(ids) else ("end", n)))
    for (of_site, run), places in runs.items():
        under, before, after = (len(set(x)) for x in zip(*places, strict=True))
        if under >= 6 and 5 * under >= len(urls[of_site]) and before > 1 and after > 1:
            block = int(site_lines.RunHashes(np.array(run, dtype=np.int64))(np.array([0]), len(run))[0])
            out[block, len(run)] = (of_site, under, len(urls[of_site]))
    return out


def test_blocks_do_not_depend_on_the_split(spark, monkeypatch):
    # each task sees "one two" before one other line only, or once
    rows = [(i, f"http://h/{i}", f"own{chr(97 + i)}\none\ntwo\n{'left' if i % 2 else 'right'}\n{chr(97 + i)}end") for i in range(10)]
    df = spark.createDataFrame(rows, DOC)
    monkeypatch.setattr(site_lines, "spread", lambda x: x.repartitionByRange(2, F.col("seq") % 2))
    for limit in (1 << 18, 12):
        monkeypatch.setattr(site_lines, "CHUNK_LINES", limit)
        assert {n: found[1] for (_, n), found in blocks_of(df).items()} == {2: 10}


@pytest.mark.parametrize("seed", range(2))
def test_blocks_against_brute_force(spark, monkeypatch, seed):
    rng = random.Random(seed)
    menu = [f"menu {x}" for x in "abcdefgh"]
    rows = []
    for i in range(150):
        host = rng.choice(["big"] * 4 + ["small", "tiny"])
        at = rng.randint(0, 4)
        body = [*menu[at : at + rng.randint(1, 5)], f"own {chr(97 + i % 26)}x", *rng.choices(["foot", "share", "top", ""], k=rng.randint(0, 6)), *menu[: rng.randint(0, 3)]]
        rows.append((i, f"http://{host}/p{i % 110}", "\n".join(body)))
    df = spark.createDataFrame([*rows, *rows[:20], (900, None, "menu a\nmenu b"), (901, "http://big/x", None)], DOC)
    want = brute_site_blocks(df)
    assert len(want) > 10
    for limit in (1 << 18, 200, 5):
        monkeypatch.setattr(site_lines, "CHUNK_LINES", limit)
        assert blocks_of(df) == want


def test_lines_go_by_the_blocks_that_cover_them(spark, monkeypatch):
    rows = [(i, f"http://h/{i}", f"own {chr(97 + i)}q\none\n\ntwo\nthree\n{chr(97 + i)}end") for i in range(10)]
    df = spark.createDataFrame(rows, DOC)
    assert {(r.seq, r.line_no) for r in site_lines.found_lines(df).collect()} == {(i, n) for i in range(10) for n in (2, 4, 5)}
    every = site_lines.repeated_blocks
    monkeypatch.setattr(site_lines, "repeated_blocks", lambda *a: every(*a).where("length > 1"))
    monkeypatch.setattr(site_lines, "spread", lambda x: x.coalesce(1))
    assert {(r.seq, r.line_no) for r in site_lines.found_lines(df).collect()} == {(i, n) for i in range(10) for n in (2, 4, 5)}
    monkeypatch.setattr(site_lines, "repeated_blocks", lambda *a: every(*a).where("length > 9"))
    assert site_lines.found_lines(df).count() == 0


def brute_blocks(docs):
    """Maximal repeats of two lines or more under two urls or more, by trying all runs."""
    runs = defaultdict(list)
    for d, ids in enumerate(docs):
        for i in range(len(ids)):
            for j in range(i + 2, len(ids) + 1):
                runs[tuple(ids[i:j])].append((d, i, j))
    out = {}
    for run, places in runs.items():
        before = {docs[d][i - 1] if i else ("start", d) for d, i, _ in places}
        after = {docs[d][j] if j < len(docs[d]) else ("end", d) for d, _, j in places}
        if len(before) > 1 and len(after) > 1 and len({d for d, *_ in places}) > 1:
            out[run] = {d for d, *_ in places}
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=12), max_size=5))
def test_maximal_blocks(docs):
    names, urls = [], []
    for d, ids in enumerate(docs):
        names += [x + 100 for x in ids] + [d]
        urls += [d] * (len(ids) + 1)
    *_, found = site_lines.maximal_blocks(np.array(names, dtype=np.int64), np.array(urls, dtype=np.int64))
    got = {tuple(x - 100 for x in names[s : s + n]): own for s, n, own in found}
    assert len(got) == len(found) and got == brute_blocks(docs)


def test_hashes_of_runs():
    rng = np.random.default_rng(1)
    ids = rng.integers(-(1 << 62), 1 << 62, 300)
    ids[200:250] = ids[100:150]
    h = site_lines.RunHashes(ids)
    at = np.arange(20)
    assert (h(at + 100, 30) == h(at + 200, 30)).all() and len({*h(at, 30).tolist(), *h(at, 29).tolist()}) == 40
    assert (site_lines.RunHashes(ids[100:])(at, 7) == h(at + 100, 7)).all()


def test_one_line_over_and_over():
    began = time.time()
    names = np.r_[np.full(1 << 17, 9), 0, np.full(1 << 17, 9), 1]
    urls = np.r_[np.zeros((1 << 17) + 1), np.ones((1 << 17) + 1)].astype(np.int64)
    order, lcp, found = site_lines.maximal_blocks(names.astype(np.int64), urls)
    assert lcp.max() == 1 << 17 and time.time() - began < 20 and found


def test_empty_and_clashing_columns(spark):
    assert site_lines.found_lines(spark.createDataFrame([], DOC)).count() == 0
    rows = [(i, f"http://h/{i}", "menu\nx" + "y" * i, "s", 1, "r") for i in range(8)]
    df = spark.createDataFrame(rows, DOC + ", site string, salt int, removed string")
    out = site_lines.cleaned(df)
    assert out.columns == ["seq", "url", "content", "site", "salt", "removed"]
    assert {r.removed for r in out.collect()} == {1} and {r.site for r in out.collect()} == {"s"}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60))
def test_suffix_array(values):
    ids = np.array(values, dtype=np.int64)
    order, rank, lcp = suffix_array(ids)
    assert order.tolist() == sorted(range(len(values)), key=lambda i: values[i:])
    assert all(rank[order[i]] == i for i in range(len(values)))
    for i in range(1, len(values)):
        a, b = values[order[i - 1] :], values[order[i] :]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert lcp[i] == n
