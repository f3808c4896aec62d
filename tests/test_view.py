"""The entity view: its records are those that whole texts give."""

from pyspark.sql import functions as F

from weftlink.functions import text
from weftlink.plans import fixtures

WORDS = " ".join(f"w{i}" for i in range(30))
TEXTS = [
    None, "", "one", WORDS, WORDS * 50, " " * 3000 + WORDS, "?! " * 2000 + WORDS, "x" * 4000 + " " + WORDS, "AİB " * 400, "ΣΣ " * 400,
    " ".join(["oΣ"] * 19 + ["ΟΣ'ʰΟ"] + ["z"] * 200), "\U0001f600a " * 300, "w-x.y " * 300, "a b c d e f g h i j k l m n o p q r s t" + "u" * 900,
]


def test_first_tokens_are_those_of_the_whole_text(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    whole = F.slice(F.filter(F.split(text.simplify("text"), " "), lambda t: t != ""), 1, 20)
    for head in (1, 7, 60, 500):
        got = fixtures.first_tokens(rows, "text", 20, head).select("i", F.slice("t", 1, 20).alias("t"), whole.alias("want")).collect()
        assert len(got) == len(TEXTS)
        assert [r.t for r in got] == [r.want for r in got]
