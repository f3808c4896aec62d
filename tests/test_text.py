import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from weftlink.functions import text
from weftlink.functions.similarity import jaro_winkler
from weftlink.operators import evaluate

NORMAL = [
    ("  ACME Private Limited ", "acme pvt ltd"), ("Foo & Bar, Corporation", "foo bar corp"), ("12, High Street; Mill Road", "12 high st mill rd"), ("Limitedness Incorporated Company", "limitedness inc co"),
    ("a_b limited_x", "a_b limited_x"), ("élimited", "élimited"), ("తెలంగాణ-x", "త ల గ ణ x"), (None, ""), ("\x1ca b\x85c", "a b c"),
]


def one(spark, expr, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([Row(*values)], ", ".join(f"{n} string" for n in names)).select(expr(*names).alias("x")).first().x


def test_normalize(spark):
    df = spark.createDataFrame([Row(a, b) for a, b in NORMAL], "a string, b string")
    for r in df.select(text.normalize("a").alias("got"), "b", text.normalize(text.normalize("a")).alias("twice")).collect():
        assert r.got == r.b == r.twice
    assert one(spark, text.normalize_country, None) == "UNKNOWN" and one(spark, text.normalize_country, " us ") == "US"


@pytest.mark.parametrize(("f", "a", "b", "want"), [
    (text.token_jaccard, "12 high st", "12 mill st", 0.5), (text.token_jaccard, "", "x", 0.0), (text.gram_jaccard, "abcd", "abce", 1 / 3), (text.gram_jaccard, "ab", "ab", 0.0),
    (text.profile_jaccard, "ab", "ab", 1.0), (text.profile_jaccard, "", "", 1.0), (text.profile_jaccard, "", "a", 0.0), (text.same_country, "", "", 0), (text.same_country, "US", "US", 1),
    (text.first_token_equal, "A b", "a c", 1), (text.first_token_equal, "", "", 0), (text.same_text, " A", "a ", 1),
])
def test_similarity(spark, f, a, b, want):
    assert one(spark, f, a, b) == pytest.approx(want)


def similarities(spark, pairs):
    rows = spark.createDataFrame([Row(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a string, b string")
    return [r.x for r in rows.select("i", jaro_winkler("a", "b").alias("x")).orderBy("i").collect()]


def test_jaro_winkler(spark):
    cases = (("martha", "marhta", 0.961111), ("dixon", "dicksonx", 0.813333), ("abcx", "abyz", 0.666667), ("", "", 0.0), (None, "a", 0.0))
    assert similarities(spark, [c[:2] for c in cases]) == pytest.approx([c[2] for c in cases], abs=1e-6)


def test_jaro_winkler_properties(spark):
    """Between 0 and 1 for texts of any characters, and 1 for equal ones."""
    import random

    rng = random.Random(2)
    text_of = lambda: "".join(chr(rng.choice([rng.randrange(0x80), rng.randrange(0x20, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randint(0, 12)))
    pairs = [(text_of(), text_of()) for _ in range(1000)]
    assert all(0 <= x <= 1 + 1e-12 for x in similarities(spark, pairs))
    assert all(x == 1 for (a, _), x in zip(pairs, similarities(spark, [(a, a) for a, _ in pairs]), strict=True) if a)


def test_jaro_winkler_equals_duckdb(spark):
    import random

    import duckdb

    rng = random.Random(1)
    pairs = [("".join(rng.choices("abcd", k=rng.randint(0, 9))), "".join(rng.choices("abcd", k=rng.randint(0, 9)))) for _ in range(3000)]
    db = duckdb.connect()
    want = [db.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0] for a, b in pairs]
    assert similarities(spark, pairs) == pytest.approx(want, abs=1e-9)


def test_padded_grams(spark):
    got = one(spark, lambda c: F.array_join(text.padded_grams(c), "|"), "A bcd")
    assert got == " a | bc|bcd|cd "


def test_f05(spark):
    cases = [("", "", 1.0), ("", "a", 0.0), ("a", "", 0.0), ("a,b", "a", 0.625 / 0.75), ("a", "a,b", 0.625 / 1.125), ("a", "b", 0.0)]
    truth = spark.createDataFrame([Row(str(i), c[0]) for i, c in enumerate(cases)], "source1_entity_id string, matched_entity_ids string")
    found = spark.createDataFrame([Row(str(i), c[1]) for i, c in enumerate(cases)], "source1_entity_id string, matched_entity_ids string")
    got = {r.source1_entity_id: r.f05 for r in evaluate.per_entity(truth, found).collect()}
    assert got == pytest.approx({str(i): c[2] for i, c in enumerate(cases)})
    alone = {r.source1_entity_id: r.f05 for r in evaluate.per_entity(truth, found.where("false")).collect()}
    assert alone["0"] == 1.0 and alone["3"] == 0.0
