"""Pairs of equal names with columns, labels, lists and counts: as the plain joins give them, and without a shuffle of pairs."""

import pytest
from pyspark.sql import functions as F

from weftlink.operators import block, evaluate, features

ENTITY = "entity_id string, business_name string, business_address string, country string"


@pytest.fixture(scope="module")
def tables(spark):
    def side(p, n):
        rows = [(f"{p}-{i}", "hot name" if i % 3 else f"name {i % 7}", f"{i % 5} high st" if i % 4 else "", "US" if i % 11 else "UNKNOWN") for i in range(n)]
        return spark.createDataFrame(rows, ENTITY).persist()

    s1, pool = side("S1", 60), side("S2", 80)
    truth = s1.select(F.col("entity_id").alias("source1_entity_id"), F.when(F.col("entity_id").endswith("1"), "S2-1,S2-2,S2-3,S2-14").otherwise("").alias("matched_entity_ids"))
    return s1, pool, truth


def rows(df):
    return sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


def unfolds_last(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return 0 < plan.find("Generate explode(") < plan.find("Exchange")


@pytest.mark.parametrize("chunk", [1000, 7])
def test_classes_give_what_the_plain_joins_give(tables, monkeypatch, chunk):
    monkeypatch.setattr(block, "CHUNK", chunk)
    s1, pool, truth = tables
    exact = block.exact_name(s1, pool)
    plain = s1.alias("a").join(pool.alias("b"), ["country", "business_name"]).where("country != 'UNKNOWN'").select(F.col("a.entity_id").alias("s1_id"), F.col("b.entity_id").alias("pool_id"))
    assert rows(exact) == rows(plain)
    assert rows(features.labelled_names(s1, pool, truth)) == rows(features.labelled(plain, truth))
    assert rows(block.exact_lists(s1, pool)) == rows(block.id_lists(plain, s1))
    both = features.attributes(plain.union(features.positives(truth, s1, pool)).distinct(), s1, pool)
    assert rows(features.exact_or_linked(truth, s1, pool, features.measures(split=True))) == rows(features.features(both).withColumnsRenamed({"source1_entity_id": "s1_id", "candidate_entity_id": "pool_id"}))


def test_labels_and_lists_unfold_after_the_last_shuffle(tables):
    s1, pool, truth = tables
    assert unfolds_last(features.labelled_names(s1, pool, truth))
    assert "Generate explode(pool_ids" not in block.exact_lists(s1, pool)._jdf.queryExecution().executedPlan().toString()


def test_counts_give_the_scores_of_lists(tables):
    s1, pool, truth = tables
    score = {"match_probability": evaluate.linear(features.measures(split=True))}
    named = {"s1_id": "source1_entity_id", "pool_id": "candidate_entity_id"}
    scores, linked = (f(truth, s1, pool, score).withColumnsRenamed(named) for f in (features.exact_or_linked, features.linked))
    lists = evaluate.sweep(scores, s1)
    assert rows(evaluate.f05_of_counts(scores, linked, truth)) == rows(evaluate.per_entity(truth, lists, evaluate.THRESHOLDS))
    assert rows(evaluate.best(scores, s1)) == rows(lists.select("threshold", "source1_entity_id", (F.col("matched_entity_ids") != "").alias("matched")))


def test_a_list_of_an_id_with_two_names_holds_both(spark):
    s1 = spark.createDataFrame([("S1-1", "a", "", "US"), ("S1-1", "b", "", "US"), ("S1-2", "c", "", "US")], ENTITY)
    pool = spark.createDataFrame([("S2-1", "b", "", "US"), ("S2-0", "a", "", "US"), ("S2-0", "b", "", "US")], ENTITY)
    assert {tuple(r) for r in block.exact_lists(s1, pool).collect()} == {("S1-1", "S2-0,S2-1"), ("S1-2", "")}


def test_idf_is_given_for_every_gram_that_repeats(spark, sf):
    from weftlink.plans import fixtures, registry

    counts = block.gram_counts(fixtures.er_view(spark, sf).pool).groupBy("country", "gram").count().where("count >= 2")
    assert rows(registry.queries()["tfidf_idf"](spark, sf).select("country", "gram")) == rows(counts.select("country", "gram"))
