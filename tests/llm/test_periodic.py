"""Runs of words against plain Python."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from weftlink.llm import periodic
from weftlink.llm.queries import op13_periodic_runs, table


def brute(words, least=12):
    """(start, last, period) of all runs: every stretch of equal words at each distance, the smallest distance of a stretch."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - 1), q)
            i = j + 1
    return sorted(((a, b, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def check(texts, least=12):
    flat = np.array([w for t in texts for w in t], np.int64)
    got = periodic.all_runs(flat, np.cumsum([0, *map(len, texts)]), least)
    assert [got.get(i, []) for i in range(len(texts))] == [brute(t, least) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.lists(st.integers(0, 2), max_size=70), st.builds(lambda w, n: (w * n)[:90], st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 30))), min_size=1, max_size=4), st.sampled_from([2, 5, 12]))
def test_runs_of_small_texts(texts, least):
    check(texts, least)


def test_runs_with_structure():
    made, (a, b) = random.Random(1), ([0], [0, 1])
    for _ in range(11):
        a, b = b, b + a
    line = [made.randrange(9) for _ in range(30)]
    inner = line[:5] + [1, 2] * 9 + line[5:]
    check([b, inner + [3] + inner + [4] + inner, line * 5, [7] * 200, line * 2 + [9] + line * 3, [], [1]])


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def test_query(spark, sf):
    rows = {r.doc_id: r for r in op13_periodic_runs(spark, sf).collect()}
    docs = table(spark, sf, "documents").collect()
    assert len(rows) == len(docs)
    for d in docs:
        words = planted(d.doc_id, (d.text or "").encode().split())
        found = [(a, b - a + 1, q) for a, b, q in brute(words)]
        r = rows[d.doc_id]
        kept = [w for i, w in enumerate(words) if not any(a + q <= i < a + n for a, n, q in found)]
        assert r.n_runs == len(found) and r.collapsed_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest()
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in found).encode()).hexdigest()
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert any(r.n_runs for r in rows.values())


def test_edge_cases(spark):
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "a b " * 6), (4, "a b " * 6), (None, "x y " * 12), (5, "a b " * 60_000 + "c"), (6, "A a " * 5)]
    docs = spark.createDataFrame([Row(d, t, "x", 1) for d, t in texts], "doc_id long, text string, runs string, n_words int")
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text) for r in periodic.runs(docs).collect()]
    assert got == [
        (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 12, [(0, 12, 2)], "a b"), (4, 12, [(0, 12, 2)], "a b"),
        (None, 12, [(0, 12, 1)], "x y"), (5, 120_001, [(0, 120_000, 2)], "a b c"), (6, 10, [], " ".join(["A a"] * 5)),
    ]
    assert periodic.runs(docs.where("false")).count() == 0
