"""Runs of repeated words against brute force over all starts and periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import runs
from lectern.llm.queries import op13_runs

SMALL = "/root/testdata/sf0.001"


def by_hand(codes, least=6, times=4):
    n, out = len(codes), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and codes[j] == codes[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, times * q) and not any(all(codes[x] == codes[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out)


def row_by_hand(doc_id, text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = by_hand(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(found), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(2, 4))
def test_runs_as_brute_force(codes, times):
    got = sorted(map(tuple, runs.runs_of(np.array(codes, dtype=np.int64), 2, times).tolist()))
    assert got == by_hand(codes, 2, times)


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_longer_strings(seed):
    r = random.Random(seed)
    codes = []
    while len(codes) < 400:
        part = [r.randrange(1 + seed) for _ in range(r.randint(1, 30))]
        codes += part * r.randint(1, 9) + part[: r.randrange(len(part))]
    assert sorted(map(tuple, runs.runs_of(np.array(codes)).tolist())) == by_hand(codes)
    fib = [0, 1]
    while len(fib) < 300:
        fib = fib + fib[: len(fib) // 2 + 1]
    assert sorted(map(tuple, runs.runs_of(np.array(fib), 2, 2).tolist())) == by_hand(fib, 2, 2)


def test_runs_of_one_word_take_linear_time():
    assert runs.runs_of(np.zeros(60_000, dtype=np.int64)).tolist() == [[0, 60_000, 1]]


def test_op13_as_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = {row_by_hand(r.doc_id, r.text) for r in docs if len(r.text or "") < 4000}
    got = {tuple(r) for r in op13_runs(spark, SMALL).collect()}
    assert want <= got and len(got) == len(docs) and sum(1 for r in want if r[1]) >= 5


def test_runs_of_odd_rows(spark, odd, none):
    more = spark.createDataFrame([(20, "a b a b a b a b"), (21, "x x x x x"), (22, "y y y y y y z"), (23, "p q\nP q p\tq p q p q"), (None, "k l m " * 9)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").union(more)
    got = sorted((tuple(r)[:8] for r in runs.periodic_runs(docs, loop=F.crc32(F.col("doc_id").cast("string"))).collect()), key=repr)
    long = [r for r in got if r[0] == 6]
    assert [r[:6] for r in long] == [(6, 1, 0, 60_000, 3, 20_000_000)]
    assert [r for r in got if r[0] != 6] == sorted((row_by_hand(r.doc_id, r.text) for r in docs.collect() if r.doc_id != 6), key=repr)
    assert runs.periodic_runs(none).count() == 0 and runs.periodic_runs(odd).count() == odd.count()
    text = {r.doc_id: (r.runs, r.collapsed) for r in runs.periodic_runs(more).collect()}
    assert text[20] == ("0,8,2\n", "a b") and text[21] == ("", "x x x x x") and text[22] == ("0,6,1\n", "y z")
