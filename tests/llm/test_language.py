from collections import Counter

from pyspark.sql import Row
from pyspark.sql import functions as F

from weftlink.llm import langid


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    filters = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    out = langid.identify(docs.where(langid.held_out(F.col("doc_id"))), filters)
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def test_filters_hold_what_they_learned():
    import numpy as np

    grams = {lang: np.arange(i, 60_000, 7, dtype=np.uint64) for i, lang in enumerate("abcdefghi")}
    f = langid.LanguageFilters.build(grams, 1 << 18, 4)
    for bit, lang in enumerate(sorted(grams)):
        assert (f.lookup(grams[lang]) >> bit & 1).all()
        absent = np.arange(10**6, 10**6 + 50_000, dtype=np.uint64)
        assert abs((f.lookup(absent) >> bit & 1).mean() - f.fill[bit] ** 4) < 0.01


def test_edge_cases(spark):
    train = spark.createDataFrame([Row("der die und das nicht", "de"), Row("the and of that this", "en"), Row(None, "en"), Row("x", None)] * 3, "text string, lang string")
    filters = langid.fit(train)
    rows = [(1, None), (2, ""), (3, "123 $$$"), (4, "the and"), (4, "the and"), (5, "der die " * 50_000), (None, "das"), (6, "日本語")]
    docs = spark.createDataFrame([Row(d, t, "old", 3) for d, t in rows], "doc_id long, text string, lang_pred string, score int")
    out = langid.identify(docs, filters).collect()
    assert [r.lang_pred for r in out][:7] == ["und", "und", "und", "en", "en", "de", "de"]
    assert [r.score for r in out][:3] == [0, 0, 0] and all(0 <= r.score <= 1 for r in out)
    assert langid.identify(docs.where("false"), filters).count() == 0
    nothing = langid.identify(docs, langid.fit(train.where("false"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert docs.select(langid.held_out(F.col("doc_id")).alias("h")).where("h is null").count() == 0


def test_more_than_64_languages(spark):
    words = {f"l{i:03d}": " ".join(chr(0x4E00 + 40 * i + (7 * k) % 40) * 2 + chr(0x4E00 + 40 * i + k) for k in range(40)) for i in range(150)}
    filters = langid.fit(spark.createDataFrame([(t, lang) for lang, t in words.items()], "text string, lang string"), 1 << 16)
    assert filters.predict([*words.values(), "", None])[0] == [*words, langid.UNKNOWN, langid.UNKNOWN]


def plain_trigrams(text):
    low = f" {(text or '').lower()} "
    clean = "".join(c if c.isalpha() else " " for c in low)
    return [clean[i - 1 : i + 2] for i in range(len(clean)) if clean[i] != " "]


def brute_predictions(train, texts, rows, hashes, least_rate=1e-6, least_share=0.2):
    """Learned sets and a Bloom filter for each language, all in plain Python."""
    import numpy as np

    from weftlink.llm import common

    counts = {}
    for text, lang in train:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(plain_trigrams(text))
    rates = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    most = Counter()
    for r in rates.values():
        for g, x in r.items():
            most[g] = max(most[g], x)

    def places(g):
        key = sum(ord(c) << 21 * i for i, c in enumerate(g))
        h = int(common.mix(np.array([key], np.uint64))[0])
        return {((h + k * (h >> 32 | 1)) % 2**64) & (rows - 1) for k in range(hashes)}

    bits = {lang: set().union(*(places(g) for g, x in r.items() if x >= least_rate and x >= least_share * most[g])) for lang, r in rates.items()}
    out = []
    for text in texts:
        grams = plain_trigrams(text)
        best = (0.0, "und")
        for i, lang in enumerate(sorted(bits)):
            if grams:
                false = (len(bits[lang]) / rows) ** hashes
                share = min(1.0, max(0.0, (sum(places(g) <= bits[lang] for g in grams) / len(grams) - false) / (1 - false)))
                if i == 0 or share > best[0]:
                    best = (share, lang)
        out.append(best)
    return out


def test_predictions_by_brute_force(spark, sf):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    train = [(t, lang) for d, t, lang in docs if d % 3]
    texts = [t for _, t, _ in docs] + [None, "", "12 %", "été the und"]
    for rows in (1 << 9, 1 << 14):  # crowded filters, where the correction counts, and roomy ones
        filters = langid.fit(spark.createDataFrame(train, "text string, lang string"), rows, 3)
        langs, scores = filters.predict(texts)
        for lang, score, (want, name) in zip(langs, scores, brute_predictions(train, texts, rows, 3), strict=True):
            assert (lang, round(float(score), 9)) == (name, round(want, 9))
