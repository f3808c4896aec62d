import hashlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from weftlink.llm import common, fingerprint



def one(text):
    return fingerprint.digests([text])[0]


def brute_units(text):
    """The units of a text by a plain loop over its characters."""
    mix = lambda x: int(common.mix(np.array([x], np.uint64))[0])
    full, turn, marks = 2**64 - 1, int(fingerprint._TURN), {chr(c) for c in fingerprint._MARKS}
    spaces = {chr(c) for c in fingerprint._SPACES}
    units, unit, before, stop, gap, word = [], "", None, False, "", 0
    for i, c in enumerate(text):
        if c in spaces:
            gap += c
            continue
        if unit and (stop or "\n" in gap or len(unit.replace(" ", "")) == fingerprint.LONGEST):
            units.append(unit)
            unit = ""
        if gap or not i:
            word, place = 0, 0
        unit += (" " if gap and unit else "") + c
        gap, place = "", place + 1
        word = (word + (ord(c) + 1) * pow(turn, (place - 1) % fingerprint.LONGEST + 1, 2**64)) & full
        ends = i + 1 == len(text) or text[i + 1] in spaces
        stop = ends and (mix(word) % fingerprint.MEAN_WORDS == 0 or c in marks)
        if ord(c) >= fingerprint._UNSPACED:
            stop = stop or c in marks or mix((ord(c) + 1 + mix(ord(before) + 1 if before is not None else 0)) & full) % (2 * fingerprint.MEAN_WORDS) == 0
        before = c
    return units + [unit] if unit else units


def brute_likeness(a, b):
    x, y = Counter(brute_units(a)), Counter(brute_units(b))
    size = lambda c: sum(len(u.replace(" ", "")) * n for u, n in c.items())
    return 1 - (size(x - y) + size(y - x)) / (size(x) + size(y)) if x or y else 1.0


SETS = st.sets(st.integers(1, 2**63), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(SETS, SETS, SETS), min_size=1, max_size=4))
def test_differences_are_exact(groups):
    pairs = [(np.array(sorted(a | c), np.uint64), np.array(sorted(b | c), np.uint64)) for a, b, c in groups]
    for (x, y), (a, b, c) in zip(fingerprint.differences(pairs, 6), groups, strict=True):
        assert set(x.tolist()) == (a | c) - (b | c) and set(y.tolist()) == (b | c) - (a | c)


def test_versions(spark):
    long = " ".join(f"w{i}." if i % 9 == 0 else f"w{i}" for i in range(4000))
    texts = {3: "One two three. Four five six.\nSeven", -2: None, 10: "", 4: long, 5: long, 8: "😀é" * 40, 2: "a", 11: "x " * 50}
    docs = spark.createDataFrame([Row(d, t, "fp", 0.5) for d, t in texts.items()], "doc_id long, text string, fingerprint string, tie double")
    got = {r.doc_id: r for r in fingerprint.fingerprint_versions(docs).collect()}
    order = sorted(texts)
    assert sorted(got) == order
    for i, d in enumerate(order):
        own, following = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        n = len(own) // 4
        new = own[: len(own) - n] + following[:n]
        assert got[d].n_chars == len(own) and got[d].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
        assert got[d].edited_fingerprint == fingerprint.fingerprints([one(new)])[0]
        assert abs(got[d].near_next - brute_likeness(own, following)) < 1e-12 and abs(got[d].near_edited - brute_likeness(own, new)) < 1e-12
    assert got[4].fingerprint == got[5].fingerprint and got[4].near_next == 1.0 and got[4].near_edited > 0.7
    assert got[2].near_next < 0.1


def test_repeated_short_units_have_digests_of_their_own():
    """Occurrence numbers of short words once collided, and a sketch with a key twice never peels."""
    words = [w for w in "abcdefghijklmnopqrstuvwxyz" for _ in range(300)] + ["|"] * 700 + ["."] * 500
    a, b = one("\n".join(words)), one("\n".join(words[:-40]))
    assert len(a) == len(words) == len(np.unique(a))
    assert len(fingerprint.differences([(a, b)])[0][0]) == 40


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([Row(1, "a b c"), Row(1, "a b c"), Row(1, "d e f"), Row(None, "g"), Row(None, None)], "doc_id long, text string")
    assert fingerprint.fingerprint_versions(docs).count() == 5
    assert fingerprint.fingerprint_versions(docs.where("false")).count() == 0
    one = fingerprint.fingerprint_versions(docs.where("text = 'g'")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_many_documents_over_ranges(spark):
    rows = [(i * 7 % 1009, f"text number {i * 7 % 1009} of many.") for i in range(1009)]
    got = {r.doc_id: r.edited_sha256 for r in fingerprint.fingerprint_versions(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    for d in range(1009):
        new = fingerprint.edited(text[d], text[(d + 1) % 1009])
        assert got[d] == hashlib.sha256(new.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab .\n\u00e9\u3000\u65e5\u672c\u3002\u0e01"), max_size=40) | st.just("x" * 600) | st.just("\u65e5\u672c" * 150), max_size=4))
def test_units_by_brute_force(texts):
    keys, first = fingerprint.digests(texts)
    for i, t in enumerate(texts):
        want = brute_units(t)
        assert sorted(int(k) & 0xFFFF for k in keys[first[i] : first[i + 1]]) == sorted(len(u.replace(" ", "")) for u in want)
        assert np.array_equal(keys[first[i] : first[i + 1]], one(t))


def test_one_rule_for_all_lengths():
    """A word more, or many blanks, leave a text's likeness near 1, short or long; so does an edit of unspaced text."""
    words = [f"word{i * 7 % 83}" for i in range(4000)]
    for n in (30, 31, 32, 33, 2000, 4000):
        a, b = one(" ".join(words[:n])), one(" ".join(words[: n // 2] + ["more"] + words[n // 2 : n]) + " " * 5000)
        assert fingerprint.likenesses([(a, b)])[0] > 0.7
    for n in (200, 300, 3000):
        t = "".join(chr(0x4E00 + i * 37 % 1900) for i in range(n))
        assert 0.6 < fingerprint.likenesses([(one(t), one(t[: n - n // 4] + "x" * (n // 4)))])[0] < 0.85


def test_large_differences_end():
    """Three million differing units: places beyond 20 bits, and sizes that stop at the number of digests."""
    keys = np.unique(common.mix(np.arange(1, 3_000_001, dtype=np.uint64)))
    (x, y), = fingerprint.differences([(keys, np.empty(0, np.uint64))])
    assert len(x) == len(keys) and not len(y)


def test_hopeless_sketches_end(monkeypatch):
    monkeypatch.setattr(fingerprint.Sketches, "peel", lambda self: (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(len(self.thirds), bool)))
    (x, y), = fingerprint.differences([(np.array([1, 2, 3], np.uint64), np.array([3, 4], np.uint64))])
    assert x.tolist() == [1, 2] and y.tolist() == [4]
