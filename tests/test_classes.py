"""Linked and random pairs as classes: what the plain joins give, with work that grows with the records."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from weftlink.operators import block, evaluate, features, model, profile

ENTITY = "entity_id string, business_name string, business_address string, country string"


@pytest.fixture(scope="module")
def tables(spark):
    def side(p, n):
        return spark.createDataFrame([(f"{p}-{i}", f"name {i % 3}" if i % 5 else None, f"{i % 2} high st" if i % 4 else "", "US" if i % 7 else "UNKNOWN") for i in range(n)], ENTITY).persist()

    s1, pool = side("S1", 40), side("S2", 50)
    hot = ",".join(f"S2-{i}" for i in range(0, 60))  # ten of them don't exist, and none of the pool is outside
    lists = F.when(F.col("entity_id").endswith("1"), hot).when(F.col("entity_id").endswith("2"), "S2-4,S2-4,S2-7").otherwise("")
    return s1, pool, s1.select(F.col("entity_id").alias("source1_entity_id"), lists.alias("matched_entity_ids"))


def rows(df):
    return sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


@pytest.mark.parametrize("chunk", [1000, 7])
def test_link_classes_unfold_to_the_linked_pairs(tables, monkeypatch, chunk):
    monkeypatch.setattr(block, "CHUNK", chunk)
    s1, pool, truth = tables
    classes = features.link_classes(truth, s1, pool)
    plain = features.pair_classes(features.positives(truth, s1, pool).distinct(), s1, pool)
    assert rows(block.expanded(classes)) == rows(block.expanded(plain))
    if chunk == 1000:
        assert classes.count() < plain.count() / 2


def test_negatives_are_the_first_draws_outside_the_truth(tables):
    """In rounds, also where the truth holds nearly all or all of the pool."""
    s1, pool, truth = tables
    got = features.negatives(s1, pool, truth, each=3)
    links = {tuple(r) for r in features.exploded(truth, "matched_entity_ids").collect()}
    pairs = [tuple(r) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and not links & set(pairs)
    held = {s: len({p for q, p in links if q == s and int(p[3:]) < 50}) for s, in s1.select("entity_id").collect()}
    assert {s: sum(p[0] == s for p in pairs) for s in held} == {s: min(3, 50 - n) for s, n in held.items()}
    few = features.negatives(s1, pool, truth.withColumn("matched_entity_ids", F.lit(",".join(f"S2-{i}" for i in range(48)))), each=3)
    assert few.groupBy("s1_id").agg(F.sort_array(F.collect_list("pool_id")).alias("p")).where(F.col("p") == F.array(F.lit("S2-48"), F.lit("S2-49"))).count() == 40


def test_medians_and_means_of_counted_values(spark):
    rnd = random.Random(3)
    data = [(g, None if rnd.random() < 0.1 else rnd.choice([0.0, 1.0, 0.5, rnd.random()]), rnd.randint(1, 9)) for g in (0, 1) for _ in range(400)]
    df = spark.createDataFrame([*data, (2, 0.25, 7)], "is_match int, m double, n long")
    got = {r.is_match: r for r in profile.separability(df, ["m"]).collect()}
    for g in (0, 1, 2):
        values = [v for k, v, n in [*data, (2, 0.25, 7)] if k == g and v is not None for _ in range(n)]
        assert got[g]["median"] == pytest.approx(statistics.median(values)) and got[g]["mean"] == pytest.approx(statistics.mean(values))


def test_trees_take_cells_for_rows(spark):
    """Equal rows are trained on as one with their number, and log losses are those of the rows one by one."""
    base = [(0.9, 0.8, 0.7, 1, 1), (0.2, 0.1, 0.0, 0, 0), (0.9, 0.1, 0.0, 1, 0)]
    names = ", ".join(f"{f} double" for f in model.FEATURES) + ", is_match long"
    one = spark.createDataFrame([(*map(float, r[:4]), r[4]) for k, r in enumerate(base) for _ in range(20 * (k + 1))], names)
    counted = spark.createDataFrame([(*map(float, r[:4]), r[4], 20 * (k + 1)) for k, r in enumerate(base)], names + ", n long")
    assert model.cells(one).count() == 3 and rows(model.cells(one)) == rows(model.cells(counted))
    a, b = (model.fit(x, 3, depth=2) for x in (one, counted))
    assert rows(model.logs(spark, a, one, counted)) == rows(model.logs(spark, b, counted, one))
    scored = model.score(a, counted).collect()
    assert len({r.match_probability for r in scored}) > 1


def test_sweep_shuffles_a_pair_once(spark, tables):
    s1 = tables[0].limit(3)
    scores = spark.createDataFrame([("S1-0", "S2-1", 0.9), ("S1-0", "S2-1", 0.72), ("S1-0", "S2-0", 0.76), ("S1-1", "S2-3", 0.1)], "source1_entity_id string, candidate_entity_id string, match_probability double")
    got = {(r.threshold, r.source1_entity_id): r.matched_entity_ids for r in evaluate.sweep(scores, s1).collect()}
    assert len(got) == 18 and got[0.7, "S1-0"] == "S2-0,S2-1" and got[0.75, "S1-0"] == "S2-0,S2-1" and got[0.8, "S1-0"] == "S2-1" and got[0.9, "S1-0"] == "" and got[0.7, "S1-1"] == ""
    assert evaluate.sweep(scores, s1)._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1


def test_scores_by_record_do_not_unfold_the_pool(spark, sf, monkeypatch):
    """F0.5 and the share of singletons come from class pairs: the plan unfolds only the s1 side."""
    from weftlink.plans import registry

    monkeypatch.setattr(block, "expanded", None)
    for name in ("f05_per_entity", "f05_macro_by_threshold", "singleton_share", "linear_score_thresholds"):
        assert "Generate explode(pool_ids" not in registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_members_unfold_as_arrays(spark):
    side = lambda p, n: spark.createDataFrame([(f"{p}-{i}", "hot", "", "US") for i in range(n)], ENTITY)
    blocks = block.exact_name_blocks(side("S1", 30), side("S2", 20), 100)
    assert blocks.expanded(7).distinct().count() == blocks.expanded().count() == 600
    plan = block.NameBlocks(blocks.pairs.limit(0), blocks.members).expanded()._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(pool_ids" in plan


@pytest.mark.parametrize("chunk", [1000, 7])
def test_exact_features_unfold_after_the_last_shuffle(tables, monkeypatch, chunk):
    """Those of the listed pairs with their labels, and none is shuffled; a record without truth and one with a long list are there."""
    monkeypatch.setattr(block, "CHUNK", chunk)
    s1, pool, truth = tables
    pairs = block.exact_name(s1, pool)
    plain = features.features(features.attributes(pairs, s1, pool))
    labels = features.labelled(pairs, truth).withColumnsRenamed({"s1_id": "source1_entity_id", "pool_id": "candidate_entity_id"})
    got = features.exact_features(s1, pool, truth)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.find("Generate explode(pool_ids") < plan.find("Exchange")
    assert rows(got) == rows(plain.join(labels, ["source1_entity_id", "candidate_entity_id"])) and got.where("is_match = 1").count() > 0
    assert rows(features.exact_features(s1, pool)) == rows(plain)
