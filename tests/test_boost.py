"""Leaf-wise trees against a booster in plain Python, and their log loss against Spark's trees."""

import math
import random

import pytest
from pyspark.sql import functions as F

from weftlink.operators import boost, model

NAMES = ["a", "b", "c"]


def table(spark, n, seed=3):
    made = random.Random(seed)
    rows = []
    for _ in range(n):
        a, b, c = made.random(), made.randint(0, 4) / 4, float(made.random() > 0.5)
        rows.append((a, b, c, int(a * 0.6 + b * 0.3 + c * 0.2 + made.gauss(0, 0.15) > 0.55)))
    return rows, spark.createDataFrame(rows, "a double, b double, c double, is_match int")


def plain_fit(rows, edges, iterations, rate, depth, leaves, least_rows, least_hessian):
    """Scores of the rows: leaves are split one at a time, each time that with the greatest gain, from the rows themselves."""
    size = {k: sum(y == k for *_, y in rows) for k in (0, 1)}
    weight = {k: len(rows) / (2 * size[k]) for k in (0, 1)}
    scores = [0.0] * len(rows)
    for _ in range(iterations):
        p = [1 / (1 + math.exp(-s)) for s in scores]
        g = [weight[r[-1]] * (q - r[-1]) for r, q in zip(rows, p, strict=True)]
        h = [weight[r[-1]] * q * (1 - q) for r, q in zip(rows, p, strict=True)]

        def best(own):
            gs, hs, found = sum(g[i] for i in own), sum(h[i] for i in own), None
            for f in range(len(edges)):
                for e in edges[f]:
                    left = [i for i in own if rows[i][f] <= e]
                    gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                    if min(len(left), len(own) - len(left)) < least_rows or min(hl, hs - hl) < least_hessian:
                        continue
                    gain = gl * gl / hl + (gs - gl) ** 2 / (hs - hl) - gs * gs / hs
                    if gain > 1e-12 and (found is None or gain > found[0] + 1e-12):
                        found = (gain, f, e)
            return found

        parts = [(list(range(len(rows))), 0)]
        while len(parts) < leaves:
            open_ = [(s[0], k, s) for k, (own, d) in enumerate(parts) if d < depth and (s := best(own))]
            if not open_:
                break
            _, k, (_, f, e) = max(open_, key=lambda x: (x[0], -x[1]))
            own, d = parts.pop(k)
            parts += [([i for i in own if rows[i][f] <= e], d + 1), ([i for i in own if rows[i][f] > e], d + 1)]
        for own, _ in parts:
            value = -rate * sum(g[i] for i in own) / sum(h[i] for i in own)
            for i in own:
                scores[i] += value
    return [1 / (1 + math.exp(-s)) for s in scores]


@pytest.mark.parametrize("leaves", [4, 31])
def test_same_scores_as_a_plain_booster(spark, monkeypatch, leaves):
    monkeypatch.setattr(boost, "SETTLED", 2)  # scores are written between rounds
    rows, df = table(spark, 90)
    fitted = boost.fit(df.repartition(3), NAMES, iterations=5, rate=0.3, depth=3, leaves=leaves, bins=16, least_rows=4)
    assert len(fitted.trees) == 5 and max(t.feature.count(-1) for t in fitted.trees) <= leaves
    want = plain_fit(rows, fitted.edges, 5, 0.3, 3, leaves, 4, 1e-3)
    got = [r.match_probability for r in boost.score(fitted, df).collect()]
    assert got == pytest.approx(want, abs=1e-9)


def test_logs_importances_and_files(spark, tmp_path):
    rows, df = table(spark, 200)
    fitted = boost.fit(df, NAMES, iterations=6, rate=0.2, depth=4)
    logs = boost.logs(fitted, df, df).orderBy("iteration").collect()
    assert [r.iteration for r in logs] == list(range(1, 7))
    assert [r.train_logloss for r in logs] == sorted((r.train_logloss for r in logs), reverse=True)
    scores = [r.match_probability for r in boost.score(fitted, df).collect()]
    losses = [-math.log(p if y else 1 - p) for (*_, y), p in zip(rows, scores, strict=True)]
    assert logs[-1].val_logloss == pytest.approx(sum(losses) / len(losses))
    shares = {r.feature: r for r in boost.importances(spark, fitted).collect()}
    assert sum(r.gain for r in shares.values()) == pytest.approx(1.0) and shares["a"].gain > 0.3 and shares["a"].splits > 0
    boost.save(spark, fitted, str(tmp_path / "m"))
    assert boost.load(spark, str(tmp_path / "m")) == fitted


def test_edge_cases(spark):
    _, df = table(spark, 60)
    missing = df.withColumn("a", F.when(F.col("b") > 0.5, F.col("a"))).withColumn("match_probability", F.lit("x"))
    fitted = boost.fit(missing, NAMES, iterations=2, depth=2)
    assert boost.score(fitted, missing).where("match_probability between 0 and 1").count() == 60
    none = boost.fit(df.where("false"), NAMES, iterations=2)
    assert none.trees == [] and {r.match_probability for r in boost.score(none, df).collect()} == {0.5}
    single = boost.fit(df.where("is_match = 1"), NAMES, iterations=2)
    assert all(len(t.feature) == 1 for t in single.trees)
    same = boost.fit(df.select(*(F.lit(1.0).alias(n) for n in NAMES), "is_match"), NAMES, iterations=1)
    assert len(same.trees[0].feature) == 1


def test_near_the_loss_of_trees_that_grow_by_level(spark):
    """Rows like the linkage features: after 20 rounds at rate 0.2 the loss is within 0.05 of Spark's trees of the same depth and rate."""
    made = random.Random(1)
    rows = []
    for _ in range(600):
        y = int(made.random() < 0.3)
        rows.append((min(1.0, max(0.0, made.gauss(0.8 if y else 0.5, 0.15))), min(1.0, max(0.0, made.gauss(0.6 if y else 0.2, 0.2))), made.random(), 1, y))
    df = spark.createDataFrame(rows, "name_jaro_winkler_score double, name_3gram_jaccard double, address_token_jaccard double, exact_country_match long, is_match int")
    ours = boost.logs(boost.fit(df, iterations=20, rate=0.2, depth=4), df, df).orderBy("iteration").collect()[-1].train_logloss
    by_level = model.logs(spark, model.fit(df, 20, step=0.2, depth=4), df, df).orderBy("iteration").collect()[-1].train_logloss
    assert abs(ours - by_level) < 0.05, (ours, by_level)
