"""Candidate joins against all pairs, and how many pairs their postings make meet."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftlink.functions.similarity import jaro_winkler
from weftlink.operators import block

ENTITY = "entity_id string, business_name string, business_address string, country string"


def names(n, made, common):
    """n names of a rare word and two that many records share."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rare = ["".join(made.choice(letters) for _ in range(8)) for _ in range(n)]
    pick = lambda: common[min(int(made.paretovariate(0.6)) - 1, len(common) - 1)]
    return [f"{w} {pick()} {pick()}" for w in rare]


def table(spark, rows, prefix, countries=("US",)):
    return spark.createDataFrame([(f"{prefix}-{i}", n, "", countries[i % len(countries)]) for i, n in enumerate(rows)], ENTITY)


def grams(name):
    return Counter(f" {w} "[i : i + 3] for w in name.split() for i in range(len(w)))


def brute_cosines(s1, pool, threshold, min_df, max_df):
    """Pairs above the threshold by all pairs of one country; names by id."""
    df = Counter(g for name in pool.values() for g in grams(name))
    idf = {g: math.log((1 + len(pool)) / (1 + n)) + 1 for g, n in df.items() if min_df <= n <= max_df * len(pool)}

    def vector(name):
        raw = {g: tf * idf[g] for g, tf in grams(name).items() if g in idf}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {g: x / norm for g, x in raw.items()}

    right = {i: vector(n) for i, n in pool.items()}
    out = {}
    for a, name in s1.items():
        left = vector(name)
        for b, other in right.items():
            cosine = sum(w * other.get(g, 0.0) for g, w in left.items())
            if cosine > threshold:
                out[a, b] = cosine
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.65, 0.9])
def test_cosines_are_those_of_all_pairs(spark, threshold):
    made = random.Random(2)
    common = [f"{a}{b}" for a in ("north", "south", "green", "blue") for b in ("river", "stone", "bakery", "motors", "optics")]
    right = names(120, made, common)
    left = [n if made.random() < 0.3 else " ".join(made.sample(n.split(), 2)) for n in made.sample(right, 60)] + ["zzz", "", "northriver"]
    s1, pool = table(spark, left, "S1"), table(spark, right, "S2")
    want = brute_cosines({f"S1-{i}": n for i, n in enumerate(left)}, {f"S2-{i}": n for i, n in enumerate(right)}, threshold, 2, 0.5)
    got = {(r.s1_id, r.pool_id): r.cosine for r in block.tfidf_cosine(s1.union(s1.limit(9)), pool, threshold, max_df=0.5).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def meeting(left, right):
    counts = [x.groupBy("country", "gram").agg(F.count(F.lit(1)).alias(f"n{k}")) for k, x in enumerate((left, right))]
    return counts[0].join(counts[1], ["country", "gram"]).agg(F.sum(F.col("n0") * F.col("n1")).alias("n")).first().n or 0


def test_pairs_that_meet_grow_less_than_with_the_square(spark):
    """Three sizes of a country whose names share common words: all postings meet quadratically, the bounded ones don't."""
    made = random.Random(4)
    common = ["".join(made.choice("bcdfghklmnprst") + made.choice("aeiou") for _ in range(3)) for _ in range(150)]
    plain, kept = [], []
    for n in (500, 1000, 2000):
        s1, pool = table(spark, names(n, made, common), "S1"), table(spark, names(n, made, common), "S2")
        left, right = block.bounded_sides(s1, pool, 0.65, max_df=0.3)
        kept.append(meeting(block.postings(left, 1), block.postings(right, 2)))
        vocab = block.vocabulary(pool, max_df=0.3)
        plain.append(meeting(*(block.vectors(block.gram_counts(x), vocab).select("country", F.explode("grams.gram").alias("gram")) for x in (s1, pool))))
    growth = lambda x: math.log(x[-1] / x[0]) / math.log(4)
    print(plain, kept)
    assert growth(plain) > 1.8 and growth(kept) < 1.55 and kept[-1] < plain[-1] / 10


def test_a_hot_name_stays_a_block(spark):
    """A name with 100,000 records on either side: its members are kept, not its 10^10 pairs; smaller names come as pairs."""
    n = 100_000
    hot = lambda p: spark.range(n).select(F.concat(F.lit(p), F.col("id").cast("string")).alias("entity_id"), F.lit("hot name").alias("business_name"), F.lit("").alias("business_address"), F.lit("US").alias("country"))
    s1, pool = (hot(p).union(table(spark, ["rare", "other", ""], p)) for p in ("S1", "S2"))
    found = block.exact_name_blocks(s1, pool)
    assert {tuple(r) for r in found.pairs.collect()} == {("S1-0", "S2-0"), ("S1-1", "S2-1")}
    assert {(r.business_name, r.side, r["count"]) for r in found.members.groupBy("business_name", "side").count().collect()} == {("hot name", 1, n), ("hot name", 2, n)}
    few = block.exact_name_blocks(s1.limit(40).union(table(spark, ["rare"], "S1")), pool.limit(30).union(table(spark, ["rare"], "S2")), most=100)
    assert few.members.count() == 70 and few.expanded(7).count() == 1201 and few.expanded().distinct().count() == 1201


def test_jaro_winkler_is_that_of_a_plain_loop(spark):
    """Greedy matching within reach, half the crossings, the prefix boost: random texts of few characters, and known values."""

    def plain(a, b):
        if not a or not b:
            return 0.0
        reach, free, left = max(0, max(len(a), len(b)) // 2 - 1), list(b), []
        for i, ch in enumerate(a):
            for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
                if free[j] == ch:
                    free[j] = None
                    left.append(ch)
                    break
        if not left:
            return 0.0
        right, m = [y for x, y in zip(free, b, strict=True) if x is None], len(left)
        t = sum(x != y for x, y in zip(left, right, strict=True)) // 2
        score = (m / len(a) + m / len(b) + (m - t) / m) / 3
        same = [x == y for x, y in zip(a[:4], b[:4], strict=False)] + [False]
        return score + 0.1 * same.index(False) * (1 - score) if score > 0.7 else score

    made = random.Random(7)
    text = lambda: "".join(made.choice("abcdé日😀 "[: made.randint(1, 8)]) for _ in range(made.randint(0, 12)))
    rows = [(a, text() if made.random() < 0.4 else "".join(made.sample(a, len(a))) if made.random() < 0.3 else a[1:] + a[:1]) for a in (text() for _ in range(1500))]
    rows += [("martha", "marhta"), ("dixon", "dicksonx"), ("mérthà", "mérhtà"), (None, "a"), ("a", None), ("x￿y", "xy￿")]
    out = spark.createDataFrame(rows, "a string, b string").select("a", "b", jaro_winkler("a", "b").alias("j"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        assert r.j == pytest.approx(plain(r.a, r.b), abs=1e-12), (r.a, r.b)
    known = {(r.a, r.b): r.j for r in out.collect()}
    assert known["martha", "marhta"] == pytest.approx(0.961111, abs=1e-6) and known["dixon", "dicksonx"] == pytest.approx(0.813333, abs=1e-6)


@pytest.mark.parametrize("join", [block.exact_name, block.ngram_jaccard, block.tfidf_cosine, block.candidates])
def test_pairs_unfold_after_the_last_shuffle(spark, join):
    """A name with 1,500 records a side beside others: each pair once, and none of them is shuffled."""
    made = random.Random(6)
    rest = names(60, made, ["north", "south", "green"])
    s1, pool = (table(spark, ["blue harbour"] * 1500 + rest, p) for p in ("S1", "S2"))
    out = join(s1, pool) if join in (block.exact_name, block.ngram_jaccard) else join(s1, pool, max_df=1.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.find("Generate explode(pool_ids") < plan.find("Exchange")
    pairs = out.select("s1_id", "pool_id")
    assert pairs.distinct().count() == pairs.count() >= 1500 * 1500 + 60


@pytest.mark.parametrize("join", [block.ngram_jaccard, block.tfidf_cosine, block.candidates])
def test_only_pairs_above_the_threshold_are_written(spark, monkeypatch, join):
    """Of names that share common words the blocks give those above, however many share a gram; also with blocks of a few names."""
    made, seen, plain = random.Random(8), [], block.met
    common = ["".join(made.choice("bcdfghklmnprst") + made.choice("aeiou") for _ in range(3)) for _ in range(40)]
    left, right = names(150, made, common), names(200, made, common)
    s1, pool = table(spark, left + right[:20] + ["", "ab"], "S1", ("US", "IN")), table(spark, right + ["", "ab"], "S2", ("US", "IN"))
    monkeypatch.setattr(block, "BLOCK", 40)
    monkeypatch.setattr(block, "met", lambda *x: seen.append(plain(*x)) or seen[-1])
    fit = {} if join == block.ngram_jaccard else {"max_df": 1.0}
    pairs = {(r.s1_id, r.pool_id) for r in join(s1, pool, **fit).collect()}
    equal = {tuple(r) for r in block.exact_name(s1, pool).collect()} if join == block.candidates else set()
    written = seen[0].count()
    assert 0 < written <= 1.02 * len(pairs) and len(pairs) <= written + len(equal)  # ties at the threshold are measured again
