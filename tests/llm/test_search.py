"""Ranked search against plain Python."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import Row

from weftlink.llm import ranked
from weftlink.llm.queries import op11_ranked_search, table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """(item_id, rank, doc_id, score) for docs and items of (id, text)."""
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        own = Counter(terms(text))
        scores = []
        for d, c in counted:
            m = 100 - 75 + 75 * c.total() * n // total
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, r in own.items() if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def rows(df):
    assert df.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_whole_tables(spark, sf):
    docs, items = (table(spark, sf, t) for t in ("documents", "benchmark"))
    got = rows(op11_ranked_search(spark, sf))
    assert got == sorted(brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]))


@pytest.mark.parametrize(("window", "docs_of", "postings", "chars"), [(64, 1 << 16, 50, 10**6), (128, 96, 10**6, 40)])
def test_windows_segments_and_blocks(spark, monkeypatch, window, docs_of, postings, chars):
    """Many small windows, segments and item blocks give the same; ids come in no order."""
    import random

    made = random.Random(5)
    words = ["ab", "Ab", "cd", "ef", "gh", "日本", "é", "x1", "_", "zz-zz"]
    docs = [(made.randrange(-500, 500), " ".join(made.choice(words) for _ in range(made.randrange(9)))) for _ in range(700)]
    items = [(i, " ".join(made.choice(words[: 3 + i]) for _ in range(1 + i))) for i in range(7)]
    for name, value in (("WINDOW", window), ("SEGMENT_DOCS", docs_of), ("SEGMENT_POSTINGS", postings)):
        monkeypatch.setattr(ranked, name, value)
    writer = ranked.SegmentWriter({t.encode(): i for i, t in enumerate(sorted({t for _, x in items for t in terms(x)}))})
    segments = []
    for d, t in docs:
        writer.add(d, t.encode())
        if writer.full:
            segments.append(writer.row())
    segments.append(writer.row())
    assert len(segments) > 1
    n, total = sum(s["n_docs"] for s in segments), sum(s["n_terms"] for s in segments)
    import numpy as np

    df = np.zeros(len(writer.numbers), np.int64)
    for s in segments:
        np.add.at(df, s["terms"], s["counts"])
    queries = [[(writer.numbers[t.encode()], r) for t, r in Counter(terms(x)).items()] for _, x in items]
    scorer = ranked.WindowedScorer(queries, np.array([ranked.weight(n, int(x)) for x in df]), (n, total), 10)
    for s in segments:
        scorer.add(s)
    got = sorted((items[q][0], -score, doc) for q, doc, score in scorer.rows())
    assert got == sorted((i, -s, d) for i, _, d, s in brute(docs, items))
    frame = lambda x, name: spark.createDataFrame([Row(*r) for r in x], f"{name} long, text string")
    assert rows(ranked.search(frame(docs, "doc_id"), frame(items, "item_id"), item_chars=chars)) == sorted(brute(docs, items))


def test_edge_cases(spark):
    long = "lorem " * 400_000 + "needle"
    docs = [(3, "alpha beta"), (3, "alpha beta"), (1, "alpha beta"), (None, "alpha beta"), (7, None), (8, ""), (9, "?!"), (10, long), (11, "gamma")]
    items = [(1, "ALPHA"), (1, "ALPHA"), (2, None), (3, ""), (4, "needle needle"), (5, "unknown"), (None, "gamma")]
    frame = spark.createDataFrame([Row(d, t, 1) for d, t in docs], "doc_id long, text string, score int")
    asked = spark.createDataFrame([Row(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    got = rows(ranked.search(frame, asked))
    assert got == sorted(brute(docs, items[1:]), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [r[2] for r in got if r[0] == 1] == [1, 3, 3, None]
    assert ranked.search(frame.where("false"), asked).count() == 0
    assert ranked.search(frame, asked.where("false")).count() == 0
    assert ranked.term_counts(long.encode()) == Counter({b"lorem": 400_000, b"needle": 1})
