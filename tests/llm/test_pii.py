import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from weftlink.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else 2 * int(d) - 9 * (int(d) > 4) for i, d in enumerate(reversed(digits))) % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    return kind == "email" or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if passes(k, m[0])] for k, p in PLAIN.items()}


CASES = [
    "a@b.c.d@e.f g_h@i.j", "a@b.c_d@e.f", "x@y a@b. @c.d", "1.2.3.4.5 300.1.1.1 0001.2.3.4 1.2.3", "4111 1111 1111 1111 x 4111-1111-1111-1111", "4111111111111111111111", "5 - 4111111111111111", "😀 +1 (152) 555-8590 é a@b.co",
    "+12 345", "+1234567890123456", "4111 1111 1111 1111 4111", None, "", "9" * 40_000, "a" * 50_000 + "@", "a.b" * 20_000 + "@x.y", "1.2" * 10_000, "+1" + "-" * 30_000 + "2", "1 " * 30_000,
]


def spans(spark, texts):
    docs = spark.createDataFrame([Row(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: {k: [tuple(s) for s in r[k]] for k in pii.KINDS} for r in pii.find(docs).collect()}


def test_base_spans(spark):
    got = spans(spark, CASES)
    for i, t in enumerate(CASES):
        assert got[i] == brute(t), t and t[:60]


def test_base_spans_of_random_texts(spark):
    made = []

    @settings(max_examples=1500, deadline=None, database=None)
    @given(st.text(st.sampled_from("a1+@.-_ ()é25😀%"), max_size=30) | st.text("0123456789 -", min_size=14, max_size=26) | st.text("0125.", max_size=18))
    def collect(t):
        made.append(t)

    collect()
    got = spans(spark, made)
    for i, t in enumerate(made):
        assert got[i] == brute(t), t


@pytest.fixture(scope="module")
def corpus(spark):
    good = [(i, f"Some words here and member card 4111111111111{n:03d} was used", "s") for i, n in enumerate(n for n in range(400) if luhn(f"4111111111111{n:03d}"))]
    more = [(500, "Later on member card QX81220-77 was used again", "s"), (501, "the part number QX99999-11 is unrelated", "s"), (502, "member card QX81220-77 was used too", "s"), (502, "member card QX81220-77 was used too", "s"), (None, "a null id with member card ZZ44556677 was used", "s"), (503, None, "s")]
    return spark.createDataFrame(good + more, "doc_id long, text string, id string")


def test_contexts_find_unseen_identifiers(corpus):
    got = [(r.doc_id, [tuple(s) for s in r.id]) for r in pii.find(corpus).where("doc_id >= 500 or doc_id is null").collect()]
    assert sorted(got, key=str) == sorted([(500, [(21, 31)]), (501, []), (502, [(12, 22)]), (502, [(12, 22)]), (None, [(27, 37)]), (503, [])], key=str)


def test_every_kind_of_base_span_seeds(spark):
    """Identifiers after contexts of emails, IPs and grouped cards, of which none holds an identifier-like token."""
    cards = [f"4111 1111 1111 1{n:03d}" for n in range(400) if luhn(f"4111111111111{n:03d}")]
    made = [f"you can reach office {w}@mail.org during work" for w in ("ann", "bob", "cy", "dee", "eve", "flo", "gus", "hal")]
    made += [f"log shows source 10.0.0.{n} was blocked" for n in range(40)] + [f"the payment card {c} was used" for c in cards]
    docs = dict(enumerate(made, 1000)) | {1: "you can reach office QX8122077 during work", 2: "log shows source HX-1200-77 was blocked", 3: "the payment card DE89 3704 0044 0532 was used", 4: "the part number 1234 5678 9012 is unrelated", 5: "log shows source 10.0.0.300 was blocked"}
    got = {r.doc_id: [docs[r.doc_id][s.start : s.end] for s in r.id] for r in pii.find(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert {i: got.pop(i) for i in (1, 2, 3, 4, 5)} == {1: ["QX8122077"], 2: ["HX-1200-77"], 3: ["DE89 3704 0044 0532"], 4: [], 5: ["10.0.0.300"]}
    assert not any(got.values())


def test_random_keys_teach_contexts(spark):
    """Keys that look random teach the context; other values after it are found, random keys elsewhere are not."""
    import hashlib

    keys = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(40)]
    docs = {i: f'some {"abcdefgh"[i % 8]}x text secret = "{k}" then {"qrstuvw"[i % 7]}y' for i, k in enumerate(keys[:30])}
    docs |= {100: 'here secret = "Zk-7pQ_x" is short', 101: 'and secret = "' + "long-part-" * 30 + '9" too', 102: f"commit {keys[35]} fixed it", 103: "lot 123456 of part 77-88-99 was sold", 104: "A secret = none here in 2024 or 1999"}
    got = {r.doc_id: [docs[r.doc_id][s.start : s.end] for s in r.id] for r in pii.find(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert all(got[i] == [k] for i, k in enumerate(keys[:30]))
    assert (got[100], got[101], got[102], got[103], got[104]) == (["Zk-7pQ_x"], ["long-part-" * 30 + "9"], [], [], [])


def test_planted_identifiers(spark, sf):
    """TESTDATA plants keys as token = "..."; precision and recall of the added spans against them."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet").collect()}
    planted = {(d, m.start(1), m.end(1)) for d, t in docs.items() for m in re.finditer(r'(?i)token = "([0-9a-z]+)', t)}
    frame = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet")
    found = {(r.doc_id, s.start, s.end) for r in pii.find(frame).collect() for s in r.id}
    assert len(planted) > 100 and len(planted & found) >= 0.99 * len(planted) and len(planted & found) >= 0.95 * len(found)


def test_redact_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "write to a@b.co", "k", "d", 5, "x")], "doc_id long, text string, span_key string, span_doc string, key int, text_spans string")
    assert [tuple(r) for r in pii.redact(docs).collect()] == [(1, "write to [EMAIL]", "k", "d", 5, "x")]


def test_redact(corpus):
    out = {r.doc_id: r for r in pii.redact(corpus.withColumn("n_chars", F.length("text").cast("long"))).collect()}
    assert out[500].text == "Later on member card [ID] was used again" and out[500].n_chars == len(out[500].text)
    assert out[0].text.endswith("member card [CARD] was used") and out[501].text.startswith("the part number QX9") and out[503].text is None
    assert out[500].id == "s" and len(out) == corpus.select("doc_id").distinct().count()


def test_overlaps_and_empty(spark):
    docs = spark.createDataFrame([Row(1, "mail +1 555 123-4567@x.org now")], "doc_id long, text string")
    text = pii.redact(docs).first().text
    assert "555" not in text and "@" not in text and text.endswith(" now")
    assert pii.find(docs.where("false")).count() == 0 and pii.redact(docs.where("false")).count() == 0


def test_native(spark, sf):
    plan = pii.find(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_places_take_linear_time(spark):
    """A text of 32,000 emails takes about four times as long as one of 8,000; places are right in both."""
    import time

    def seconds(n):
        docs = spark.createDataFrame([(1, "x@y.zz, " * n)], "doc_id long, text string")
        found = docs.select(pii.base(F.col("text"), "email").alias("e")).select(F.size("e").alias("n"), F.element_at("e", -1)["end"].alias("end"), F.element_at("e", n // 2)["start"].alias("start"))
        began = time.perf_counter()
        assert tuple(found.first()) == (n, 8 * n - 2, 8 * (n // 2 - 1))
        return time.perf_counter() - began

    seconds(2000)
    assert seconds(32_000) < 8 * max(seconds(8000), 0.5)


def test_running_folds(spark):
    import itertools

    for n in (0, 1, 63, 64, 65, 4096, 4097, 10_000):
        xs = [(i * 7919) % 101 - 50 for i in range(n)]
        row = spark.createDataFrame([(xs,)], "x array<int>").select(pii.running(F.col("x"), lambda a, b: a + b, 0).alias("s"), pii.running(F.col("x"), lambda a, b: F.greatest(a, b), -99).alias("m")).first()
        assert row.s == list(itertools.accumulate(xs)) and row.m == list(itertools.accumulate(xs, max))


def test_values_that_no_seed_names(spark, sf):
    """Half of TESTDATA's keys become short codes, which are no seeds: what contexts alone find of them, and beside them.

    A few of the keys that are left don't look random; found, they count as right.
    """
    rows, planted, left = [], set(), set()
    for r in spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet").select("doc_id", "text").collect():
        text = r.text
        if r.doc_id % 2 and (m := re.search(r'(?i)token = "([0-9a-z]+)', text or "")):
            code = f"KD-{r.doc_id:06d}-{r.doc_id % 90 + 10}"
            text = text[: m.start(1)] + code + text[m.end(1) :]
            planted.add((r.doc_id, m.start(1), m.start(1) + len(code)))
        else:
            left |= {(r.doc_id, *m.span(1)) for m in re.finditer(r'(?i)token = "([0-9a-z]+)', text or "")}
        rows.append((r.doc_id, text))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    texts = dict(rows)
    found = {(r.doc_id, s.start, s.end) for r in pii.find(frame).collect() for s in r.id}
    seeds = spark.createDataFrame([(*f, texts[f[0]][f[1] : f[2]]) for f in found], "d long, s long, e long, v string").where(pii.random_looking(F.col("v")))
    alone = found - {(r.d, r.s, r.e) for r in seeds.collect()}
    assert len(planted) > 50 and len(planted & alone) >= 0.9 * len(planted) and len((planted | left) & alone) >= 0.9 * len(alone)
    print("found alone", len(planted & alone), "of", len(planted), "right", len((planted | left) & alone), "of", len(alone), "all", len((planted | left) & found), len(found))


def test_random_looking(spark):
    import uuid

    keys = {"04dbebab91ab85687d33eeaaf9ac699e1188f962": True, str(uuid.UUID(int=0x3F2A9C1B7E4D4A6F8B0C5D2E9F1A7B3C)): True, "QX81220-77": False, "9807915762804490": False, "KD-000123-45": False, "long-part-9": False, "version2024beta11": False, "": False}
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert {r.k: r.r for r in df.select("k", pii.random_looking(F.col("k")).alias("r")).collect()} == keys


def test_contexts_reach_across_neighbours(spark):
    row = spark.createDataFrame([("user name QX81220 ZZ44556 was seen",)], "t string").select(pii.located(F.col("t"), pii.CANDIDATE).alias("m")).first()
    assert [(m.start, m.end, m.left, m.right) for m in row.m] == [(10, 17, "user name ", " # was seen"), (18, 25, "user name # ", " was seen")]


def test_replaced_by_brute_force(spark):
    """Random spans, also nested, equal and adjacent, in texts around block bounds; and linear time."""
    import hashlib
    import random
    import time

    def plain(text, spans):
        out, at = [], 0
        for s, e, mark in spans:
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join(out) + text[at:]

    rng, rows = random.Random(5), []
    for n in [1, 5, 255, 256, 257, 512, 700, 2000] * 12:
        text = "".join(rng.choice("aé😀\n") for _ in range(n))
        starts = [rng.randrange(n) for _ in range(rng.randrange(1, 90))]
        rows.append((text, sorted((s, min(n, s + rng.randrange(1, 300 if n > 300 else 4)), rng.choice(["[A]", "[B]"])) for s in starts)))
    schema = "text string, spans array<struct<start:int,end:int,mark:string>>"
    got = spark.createDataFrame(rows, schema).select("text", "spans", pii.replaced(F.col("text"), F.col("spans")).alias("new")).collect()
    assert all(r.new == plain(r.text, [tuple(s) for s in r.spans]) for r in got)

    def seconds(n):
        one = spark.createDataFrame([("x@y.zz, " * n, [(8 * i, 8 * i + 6, "[E]") for i in range(n)])], schema).select(F.sha2(pii.replaced(F.col("text"), F.col("spans")), 256).alias("h"))
        began = time.perf_counter()
        assert one.first().h == hashlib.sha256(b"[E], " * n).hexdigest()
        return time.perf_counter() - began

    seconds(2000)
    assert seconds(32_000) < 8 * max(seconds(8000), 0.5)
