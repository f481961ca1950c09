"""Problem 1 against brute force and on its edge cases."""

import random
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from tracewright.llm import queries, spans

SCHEMA = "cite_id long, file string, quote string, a string, class string"


def brute_pairs(rows, n):
    grams = defaultdict(set)
    for i, f, q in rows:
        if i is not None and f is not None and q:
            for k in range(len(q) - n + 1):
                grams[q[k : k + n]].add((i, f))
    return {(min(a[0], b[0]), max(a[0], b[0])) for s in grams.values() for a in s for b in s if a[1] != b[1]}


def brute_shares(rows, n):
    files = defaultdict(set)
    for i, f, q in rows:
        if i is not None and f is not None and q:
            for k in range(len(q) - n + 1):
                files[q[k : k + n]].add(f)
    out = {}
    for i, f, q in rows:
        if i is None:
            continue
        q = q or ""
        hit = set()
        for k in range(len(q) - n + 1):
            if f is not None and files[q[k : k + n]] - {f}:
                hit |= set(range(k, k + n))
        out[i] = len(hit)
    return out


def test_found_equals_brute_force(spark, medium):
    rows = {(r["cite_id"], r["file"], r["quote"]) for r in pq.read_table(f"{medium}/citations.parquet").to_pylist()}
    got = [tuple(r) for r in queries.p1_found(spark, medium).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_pairs(rows, 120)
    shares = {r.cite_id: r.shared for r in queries.p1_shares(spark, medium).collect()}
    assert shares == brute_shares(rows, 120)


def noisy(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("ab é") for _ in range(60)) for _ in range(4)]
    rows = []
    for i in range(60):
        q = "".join(r.choice(base)[r.randint(0, 20) :] for _ in range(r.randint(0, 3)))
        rows.append((i, r.choice(["f", "g", "h", None]), r.choice([q, q, q, None, ""]), "x", "y"))
    return [*rows, *rows[:5], (None, "f", base[0], "x", "y")]


@pytest.mark.parametrize("hot", [1, 3, 100])
def test_hot_anchors_lose_nothing(spark, hot, monkeypatch):
    rows = noisy(hot)
    df = spark.createDataFrame(rows, SCHEMA)
    whole = spans.repeats
    monkeypatch.setattr(spans, "repeats", lambda c, n: whole(c, n, anchor=20, hot=hot))
    got = [tuple(r) for r in spans.found(df, at_least=25).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_pairs([r[:3] for r in rows], 25)
    shares = {r.cite_id: r.shared for r in spans.shares(df, at_least=25, anchor=20).collect()}
    assert shares == brute_shares([r[:3] for r in rows], 25)


def test_a_repeat_is_met_once_however_many_share_it(spark, monkeypatch):
    r = random.Random(5)
    passage = "".join(r.choice("abcdefgh ") for _ in range(90))
    texts = [f"{r.choice('xyz') * r.randint(0, 2)}{passage[r.choice([0, 0, 0, 7]):]}{r.choice('uvw')}{i:03}" for i in range(40)]
    df = spark.createDataFrame([(i, f"f{i % 5}", t, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    seeds = []
    begin = spans._begin
    monkeypatch.setattr(spans, "_begin", lambda runs: seeds.append(begin(runs)) or seeds[0])
    got = {tuple(x) for x in spans.repeats(spans.classes(spans.classed(df, "cite_id", "file", "quote", 25)), 25, anchor=20, hot=1).select("a", "b").collect()}
    pairs = brute_pairs([(i, f"f{i % 5}", t) for i, t in enumerate(texts)], 25)
    assert len(got) == len(pairs) == seeds[0].count()


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert spans.found(df).count() == 0
    assert spans.shares(df).count() == 0


@pytest.mark.parametrize("window", [1, 2, 7, 57, 300])
def test_winnow_keeps_the_least_of_every_window(window):
    r = np.random.default_rng(window)
    h, owner = r.integers(1, 9, 200, dtype=np.uint64), np.sort(r.integers(0, 3, 200))
    windows = [range(i, i + window) for i in range(len(h) - window + 1) if owner[i] == owner[i + window - 1]]
    expected = {k for w in windows for k in w if h[k] == h[w.start : w.stop].min()}
    assert set(np.flatnonzero(spans.winnow(h, window, owner)).tolist()) == expected


@pytest.mark.parametrize("n", [1, 2, 3, 7, 96, 120])
def test_run_hashes_depend_on_the_run_alone(n):
    r = random.Random(n)
    t = "".join(r.choice("abé𝛼") for _ in range(300))
    seen = {}
    for i, h in enumerate(spans.run_hashes(t, n).tolist()):
        assert seen.setdefault(t[i : i + n], h) == h
    assert len(set(seen.values())) == len(seen)
    assert len(spans.run_hashes(t[: n - 1], n)) == 0
