import random
import re

from pyspark.sql import Row
from pyspark.sql import functions as F

from weftlink.llm import common, decontaminate, minhash

rng = random.Random(5)
WORDS = [f"w{i}" for i in range(3000)]


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def item_shingles(text):
    """A text of fewer than five words holds no item and is held by nothing."""
    return {s for s in shingles(text) if len(s) == 5}


def brute(docs, percent=75):
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in sets}


def edit(words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = rng.choice(WORDS)
    return out


def corpus():
    docs, d = [], 0
    for size, copies, edits in ((150, 60, 4), (150, 40, 8), (40, 30, 1), (300, 20, 5), (12, 15, 1), (6, 8, 1)):
        base = rng.choices(WORDS, k=size)
        for _ in range(copies):
            docs.append((d, " ".join(edit(base, rng.randint(0, edits)))))
            d += 1
    chain = rng.choices(WORDS, k=120)  # neighbours are alike, the ends are not
    for _ in range(25):
        docs.append((d, " ".join(chain)))
        chain = edit(chain, 2)
        d += 1
    docs += [(d + 1, None), (d + 2, ""), (d + 3, " \t\n"), (d + 4, "One"), (d + 5, "one"), (d + 6, "a b c"), (d + 7, "A\x0bB c"), (d + 8, "a\x1cb c"), (d + 9, "long " * 20_000), (d + 10, "LONG " * 30_000)]
    rng.shuffle(docs)
    return docs


def test_components(spark):
    docs = corpus()
    df = spark.createDataFrame([Row(d, t, 1, True) for d, t in docs], "doc_id long, text string, component_id int, kept boolean").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.link_components(df).collect()}
    assert got == brute(docs)


def test_prefix_links_are_all_links(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    nodes = df.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("node"), F.col("doc_id").alias("label"))
    got = {(r.a, r.b) for r in minhash.prefix_links(minhash.shingle_sets(df, nodes), 75).collect()}
    sets = {d: shingles(t) for d, t in docs}
    assert got == {(a, b) for a in sets for b in sets if a < b and (n := len(sets[a] & sets[b])) and 100 * n >= 75 * len(sets[a] | sets[b])}


def test_small_sets_lose_no_link(spark):
    """Pairs of 3 to 22 shingles at the least similarity of 0.75 or more: the end cut off, and words at the end replaced."""
    made, texts, pairs = random.Random(11), [], []
    for n in range(3, 23):
        for _ in range(120):
            words = [f"x{made.randrange(10**9)}" for _ in range(n + 4)]
            cut = max(k for k in range(n) if 100 * (n - k) >= 75 * n)
            other = max(k for k in range(n) if 100 * (n - k) >= 75 * (n + k))
            for twin in (words[: len(words) - cut], words[: len(words) - other] + [f"y{made.randrange(10**9)}" for _ in range(other)]):
                if twin != words:
                    pairs.append((len(texts), len(texts) + 1))
                    texts += [" ".join(words), " ".join(twin)]
    docs = spark.createDataFrame([Row(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    label = {r.doc_id: r.component_id for r in minhash.link_components(docs).select("doc_id", "component_id").collect()}
    assert len(pairs) > 3500 and not [p for p in pairs if label[p[0]] != label[p[1]]]


def test_min_max_estimates():
    import numpy as np

    from weftlink.llm import common

    a, b = list(range(1000)), list(range(200, 1200))
    hashes, first, _ = common.shingle_hashes([" ".join(f"x{i}" for i in x).encode() for x in (a, b)], 1)
    s = minhash.min_max(hashes, first)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.13
    assert np.array_equal(minhash.bands(s)[0], minhash.bands(s[:1])[0])


def test_repeats_nulls_and_empty(spark):
    text = " ".join(WORDS[:30])
    df = spark.createDataFrame([Row(4, text, 1), Row(4, text, 1), Row(2, text, 9), Row(None, text, 3), Row(7, None, 3)], "doc_id long, text string, n_chars long")
    rows = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in minhash.link_components(df).collect())
    assert rows == [("2", "2", True), ("4", "2", False), ("4", "2", False), ("7", "7", True), ("None", "None", True)]
    assert sorted(str(r.doc_id) for r in minhash.deduplicate(df).collect()) == ["2", "7", "None"]
    other = " ".join(WORDS[100:130])
    shared = spark.createDataFrame([(3, text), (5, text), (5, other), (6, other), (5, None), (8, None), (8, ""), (9, "x"), (9, "x")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.link_components(shared).collect())
    assert got == [(3, 26, 3, True), (5, 0, 3, False), (5, 26, 3, False), (5, 26, 3, False), (6, 26, 3, False), (8, 0, 8, True), (8, 0, 8, True), (9, 1, 9, True), (9, 1, 9, True)]
    stay = minhash.deduplicate(shared.withColumn("node_id", F.lit("mine")).withColumn("component_id", F.lit(7)))
    rows = sorted((r.doc_id, r.text or "", r.node_id, r.component_id) for r in stay.collect())
    assert rows == sorted((d, t, "mine", 7) for d, t in [(3, text), (5, other), (5, ""), (8, ""), (8, ""), (9, "x")])
    odd = minhash.deduplicate(df.withColumn("a.b", F.lit(1)))
    assert odd.columns == ["doc_id", "text", "n_chars", "a.b"] and odd.count() == 3
    assert minhash.link_components(df.where("false")).count() == 0 and minhash.deduplicate(df.where("false")).count() == 0


def test_no_holder_is_missed():
    """Items of all sizes with three quarters of their shingles scattered in pieces over long texts are all candidates."""
    items, texts, held = [], [], set()
    for i in range(300):
        n = rng.choice([5, 6, 7, 9, 12, 20, 40, 80, 150, 400, 1200])
        words = [f"i{i}w{k}" for k in range(n)]
        items.append((i, " ".join(words).encode()))
        step = max(8, n // 10)
        parts = [words[at : at + step + 4] for at in range(0, n, step)]  # neighbours overlap, so each shingle is in one
        rng.shuffle(parts)
        filler = iter(f"t{i}f{k}" for k in range(10**6))
        text = [w for p in parts for w in [*(next(filler) for _ in range(rng.randrange(200))), *p]]
        if rng.random() < 0.5 and n > 40:  # some pieces are lost
            text = [w for p in parts[: len(parts) - len(parts) // 5] for w in [*(next(filler) for _ in range(50)), *p]]
        texts.append(" ".join(text).encode())
        item, own = item_shingles(items[-1][1].decode()), item_shingles(texts[-1].decode())
        if 100 * len(item & own) >= 75 * len(item):
            held.add((i, i, len(item & own), len(item)))
    assert set(decontaminate.ItemIndex.build(items).search(texts, 75, 5)) == held and len(held) > 200


def test_decontamination(spark):
    items = [(i, " ".join(rng.choices(WORDS, k=n))) for i, n in enumerate([5, 6, 9, 14, 30, 60, 130, 300, 700] * 3)] + [(90, None), (91, "too short"), (92, ""), (4, "Some OTHER words under an id that repeats here")]
    docs = []
    for d in range(120):
        words = rng.choices(WORDS, k=rng.choice([3, 40, 900, 6000]))
        if d % 3 == 0:
            item = (rng.choice(items)[1] or "").split()
            part = edit(item, rng.randint(0, max(1, len(item) // 25))) if item else []
            at = rng.randrange(len(words))
            words[at:at] = part
        docs.append((d, " ".join(words).upper() if d % 2 else "\n".join(words)))
    docs += [(500, None), (501, ""), (None, items[5][1]), (7, items[6][1]), (502, "x " * 100_000)]
    want = set()
    for d, t in docs:
        own = item_shingles(t)
        for i, x in items:
            of = item_shingles(x)
            if of and 100 * (n := len(of & own)) >= 75 * len(of):
                want.add((d, i, n, len(of)))
    df = spark.createDataFrame([Row(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (300, 10**7):  # joined, broadcast
        got = [tuple(r) for r in decontaminate.find(df, bench, broadcast_chars=most).collect()]
        assert set(got) == want and len(got) == len(want)
    assert len(want) > 20
    kept = {r.doc_id for r in decontaminate.decontaminate(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {w[0] for w in want if w[0] is not None}
    assert decontaminate.find(df, bench.where("false")).count() == 0 and decontaminate.find(df.where("false"), bench).count() == 0


def test_one_passage_in_most_of_many_texts(spark):
    """Texts of which 80 % is one passage are not alike: no links, and none lost among the copies between them."""
    passage = rng.choices(WORDS, k=80)
    docs = [(i, " ".join(passage + [f"own{i}x{k}" for k in range(30 + i % 7)])) for i in range(60)] + [(100 + i, " ".join(passage + [f"own{i}x{k}" for k in range(30 + i % 7)][:-1])) for i in range(0, 60, 3)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.link_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)
