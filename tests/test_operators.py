import math

import pytest
from pyspark.sql import functions as F

from weftlink.operators import block, evaluate, features, model, profile, sample
from weftlink.plans import registry
from weftlink.plans.fixtures import er_view
from weftlink.sources import io

ENTITY = "entity_id string, business_name string, business_address string, country string"


@pytest.fixture(scope="module")
def small(spark):
    s1 = spark.createDataFrame([("S1-1", "acme inc", "1 high st", "US"), ("S1-2", "", "x", "US"), ("S1-3", "only here", "", "FR"), ("S1-4", "acme inc", "1 high st", "UNKNOWN")], ENTITY)
    pool = spark.createDataFrame([("S2-1", "acme inc", "1 high st", "US"), ("S3-1", "acme inc", "2 high st", "FR"), ("S2-2", "", "", "US"), ("S2-3", "acme inc", "", "UNKNOWN"), ("S3-2", "acme inc", "", "US")], ENTITY)
    return s1, pool


def test_exact_names(small):
    s1, pool = small
    assert {tuple(r) for r in block.exact_name(s1, pool).collect()} == {("S1-1", "S2-1"), ("S1-1", "S3-2")}
    assert ("S1-2", "S2-2") in {tuple(r) for r in block.exact_name(s1, pool, match_empty_names=True).collect()}
    lists = {r[0]: r[1] for r in block.id_lists(block.exact_name(s1, pool), s1).collect()}
    assert lists == {"S1-1": "S2-1,S3-2", "S1-2": "", "S1-3": "", "S1-4": ""}


def test_no_cartesian(small, spark):
    s1, pool = small
    for df in (block.exact_name(s1, pool), block.tfidf_cosine(s1, pool), block.ngram_jaccard(s1, pool)):
        plan = df._jdf.queryExecution().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_tfidf_and_jaccard(spark):
    names = [f"{a} {b} company" for a in ("north", "south", "green", "blue", "old") for b in ("river", "stone", "bakery", "motors", "optics", "paper", "travel", "energy")]
    pool = spark.createDataFrame([(f"S2-{i}", n, "", "US") for i, n in enumerate(names * 2)], ENTITY)
    s1 = spark.createDataFrame([("S1-1", "north river compny", "", "US"), ("S1-2", "zzz", "", "US")], ENTITY)
    cos = {r.pool_id for r in block.tfidf_cosine(s1, pool, max_df=0.5).collect()}
    assert cos == {"S2-0", "S2-40"}
    assert {r.pool_id for r in block.ngram_jaccard(s1, pool, 0.6).collect()} == {"S2-0", "S2-40"}
    assert block.tfidf_cosine(s1, pool.limit(5)).count() == 0


def test_attributes_and_labels(small, spark):
    s1, pool = small
    pairs = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "missing")], "s1_id string, pool_id string")
    rows = {r.candidate_entity_id: r for r in features.features(features.attributes(pairs, s1, pool)).collect()}
    assert rows["S2-1"].name_jaro_winkler_score == 1 and rows["missing"].exact_country_match == 0 and rows["missing"].name_3gram_jaccard == 0
    truth = spark.createDataFrame([("S1-1", "S2-1,S9-9"), ("S1-2", "")], "source1_entity_id string, matched_entity_ids string")
    assert {r.pool_id: r.is_match for r in features.labelled(pairs, truth).collect()} == {"S2-1": 1, "missing": 0}
    assert [tuple(r) for r in features.positives(truth, s1, pool).collect()] == [("S1-1", "S2-1")]
    negatives = features.negatives(s1, pool, truth)
    assert negatives.join(features.exploded(truth, "matched_entity_ids"), ["s1_id", "pool_id"]).count() == 0


def test_negatives_are_exactly_as_many_as_asked(spark, small):
    """Two for each record from a pool of five, also where the truth holds three of them; fewer only where no more are left."""
    s1, pool = small
    truth = spark.createDataFrame([("S1-1", "S2-1,S3-1,S2-2"), ("S1-2", "S2-1,S3-1,S2-2,S2-3"), ("S1-3", "S2-1,S3-1,S2-2,S2-3,S3-2"), ("S1-4", None)], "source1_entity_id string, matched_entity_ids string")
    got = [tuple(r) for r in features.negatives(s1.union(s1), pool.union(pool.limit(2)), truth).collect()]
    own = {k: {p for s, p in got if s == k} for k in ("S1-1", "S1-2", "S1-3", "S1-4")}
    assert len(got) == len(set(got)) and own["S1-1"] == {"S2-3", "S3-2"} and own["S1-2"] == {"S3-2"} and not own["S1-3"] and len(own["S1-4"]) == 2
    many = spark.range(400).select(F.concat(F.lit("S2-"), "id").alias("entity_id"))
    drawn = features.negatives(many.withColumn("entity_id", F.concat(F.lit("S1-"), "entity_id")), many, truth, each=7)
    assert drawn.distinct().count() == 2800 and drawn.groupBy("pool_id").count().agg(F.max("count")).first()[0] < 40
    assert features.negatives(s1, pool.where("false"), truth).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 500, 1000, 1200])
def test_first_by_hash(spark, n):
    import hashlib

    df = spark.range(1000).select(F.col("id").cast("string").alias("k"), "id")
    order = sorted(map(str, range(1000)), key=lambda k: (hashlib.md5(f"{k}42".encode()).hexdigest(), k))
    assert {r.k for r in sample.first_by_hash(df, "k", n).collect()} == set(order[:n])
    assert {r.k for r in sample.first_by_hash(df, "k", n, rest=True).collect()} == set(order[n:])


def test_splits(spark, sf):
    view = er_view(spark, sf)
    parts = sample.three_way(view.s1, "entity_id")
    sizes = {k: v.count() for k, v in parts.items()}
    n = view.s1.count()
    assert sum(sizes.values()) == n and sizes["test"] == math.ceil(0.1 * n) and parts["train"].join(parts["val"], "entity_id").count() == 0
    s1, pools, truth = sample.sample_preserving_truth(view.s1, [view.s2, view.s3], view.truth)
    need = features.exploded(truth, "matched_entity_ids").select(F.col("pool_id").alias("entity_id"))
    assert need.join(pools[0].unionByName(pools[1]), "entity_id", "left_anti").count() == 0 and s1.count() == round(0.2 * n)


def test_results_are_candidates(spark, sf):
    view = er_view(spark, sf)
    pairs = block.exact_name(view.s1, view.pool)
    scores = evaluate.linear_score(features.features(features.attributes(pairs, view.s1, view.pool)))
    lists = evaluate.sweep(scores, view.s1)
    assert lists.groupBy("threshold").count().where(F.col("count") != view.s1.count()).count() == 0
    found = features.exploded(lists, "matched_entity_ids").distinct()
    assert found.join(pairs, ["s1_id", "pool_id"], "left_anti").count() == 0
    matched = [r.n for r in lists.groupBy("threshold").agg(F.sum(F.size(F.split("matched_entity_ids", ","))).alias("n")).orderBy("threshold").collect()]
    assert matched == sorted(matched, reverse=True)


def test_repeated_rows_count_once(spark):
    """Truth and results that repeat a record: the last by a given order, else the greatest list; blank ids are none."""
    lists = "source1_entity_id string, matched_entity_ids string, at int"
    truth = spark.createDataFrame([("a", "x", 1), ("a", "y", 0), ("b", None, 0), ("b", None, 1), ("c", " , x,\t", 0), ("d", "x,x", 0)], lists)
    results = spark.createDataFrame([("a", "x", 1), ("a", "x,y", 0), ("a", "x,y", 0), ("b", " ", 0), ("d", "x", 0), ("d", "", 1)], lists)
    got = {r.source1_entity_id: r.f05 for r in evaluate.per_entity(truth, results, order="at").collect()}
    assert got == {"a": 1.0, "b": 1.0, "c": 0.0, "d": 0.0}
    assert {r.source1_entity_id: round(r.f05, 6) for r in evaluate.per_entity(truth, results).collect()} == {"a": 0.555556, "b": 1.0, "c": 0.0, "d": 1.0}
    assert evaluate.macro(evaluate.per_entity(truth, results)).first().entities == 4
    levels = evaluate.per_entity(truth, results.withColumn("threshold", F.lit(0.8)), [0.7, 0.8])
    assert levels.count() == 8 and levels.where("threshold = 0.7 and source1_entity_id = 'a'").first().f05 == 0
    assert block.id_lists(spark.createDataFrame([("a", "p")], "s1_id string, pool_id string"), truth.select(F.col("source1_entity_id").alias("entity_id"))).count() == 4


def test_f05_by_threshold_is_that_of_the_lists(spark):
    """One pass over the scores against the lists of each threshold; repeated pairs and rows, unknown records, no scores."""
    import random

    made = random.Random(3)
    ids = [f"r{i}" for i in range(40)]
    scores = [(made.choice(ids), f"p{made.randrange(6)}", made.choice([0.1, 0.5, 0.7, 0.8, 0.85, 0.95, 0.99])) for _ in range(300)]
    truth = [(r, ",".join(f"p{k}" for k in range(6) if made.random() < 0.3) or None, k) for k, r in enumerate(ids[:30] + ids[5:9])]
    scores = spark.createDataFrame(scores, "source1_entity_id string, candidate_entity_id string, match_probability double")
    truth = spark.createDataFrame(truth, "source1_entity_id string, matched_entity_ids string, line int")
    levels = [0.05 * i for i in range(20)]
    records = truth.select(F.col("source1_entity_id").alias("entity_id")).distinct()
    want = evaluate.macro(evaluate.per_entity(truth, evaluate.sweep(scores, records, levels), levels), ["threshold"])
    out = evaluate.f05_by_threshold(scores, truth, levels)
    plan = out._jdf.queryExecution().executedPlan().toString()
    rounded = lambda df: {(round(r.threshold, 9), round(r.macro_f05, 9), r.entities) for r in df.collect()}
    assert rounded(out) == rounded(want) and out.count() == 20
    assert plan.count("Exchange hashpartitioning(source1_entity_id") == 1 and plan.count("Exchange hashpartitioning") == 2  # the other has a row per threshold


@pytest.mark.parametrize(("n", "most"), [(0, 10), (1, 10), (2, 10), (1001, 10), (5000, 50), (5000, 1_000_000)])
def test_medians(spark, n, most):
    """The middle of each group's values, with ties, nulls and a null group, also where brackets are sketched again."""
    import random
    import statistics

    made = random.Random(n)
    rows = [(made.choice(["a", "b", None]), made.choice([made.random(), 0.5, float(made.randrange(3)), -made.random() * 1e9, None])) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.median for r in profile.medians(df, ["g"], most=most, steps=50).collect()}
    groups = {g: [v for k, v in rows if k == g and v is not None] for g in {k for k, _ in rows}}
    assert got == pytest.approx({g: statistics.median(v) for g, v in groups.items() if v})


def test_splits_and_samples_of_repeated_ids(spark):
    rows = spark.createDataFrame([(f"i{n % 50}", "US", n) for n in range(200)], "entity_id string, country string, n int")
    parts = {k: {r.entity_id for r in v.collect()} for k, v in sample.three_way(rows, "entity_id").items()}
    assert (len(parts["test"]), len(parts["val"]), len(parts["train"])) == (5, 10, 35) and len(set().union(*parts.values())) == 50
    held = sample.holdout(rows, "entity_id", "US", "DE")
    assert held["val"].count() == 40 and held["test"].count() == 0
    some, (pool,), truth = sample.sample_preserving_truth(rows, [rows], None)
    assert some.count() == 40 and truth is None and pool.count() == 40
    places = sample.shuffled(rows.dropDuplicates(["entity_id"]), "entity_id").collect()
    import hashlib

    assert [r.entity_id for r in sorted(places, key=lambda r: r.place)] == sorted((f"i{n}" for n in range(50)), key=lambda k: hashlib.md5(f"{k}42".encode()).hexdigest())


def test_vocabulary_cap(spark):
    """The most frequent grams, ties by gram, whatever the cap."""
    pool = spark.createDataFrame([(f"S2-{i}", n, "", c) for c in ("US", "FR") for i, n in enumerate(["abc abd", "abc abe", "abd abe", "xyz", "xyz abc", "qrs", "qrs"])], ENTITY)
    counts = block.gram_counts(pool).groupBy("country", "gram").agg(F.sum("tf").alias("t"), F.count("*").alias("df")).where("df >= 2").collect()
    for cap in (1, 3, 4, 6, 100):
        got = {(r.country, r.gram) for r in block.vocabulary(pool, max_df=1.0, max_features=cap).collect()}
        assert got == {(c, r.gram) for c in ("US", "FR") for r in sorted((r for r in counts if r.country == c), key=lambda r: (-r.t, r.gram))[:cap]}


def test_profiles_ignore_nulls(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",), ("",)], "v string")
    assert profile.missing(df, ["v"]).first().missing == 2
    row = profile.uniqueness(df, ["v"]).first()
    assert (row.distinct_values, row.records) == (2, 4)
    p = profile.percentiles(spark.createDataFrame([(1,), (2,), (3,), (10,)], "n int"), F.col("n")).first()
    assert (p.p25, p.p50, p.p75, p.mean) == (1, 2, 3, 4.0)


def test_model(spark, tmp_path):
    rows = spark.createDataFrame([(i / 40, i / 50, i / 60, 1, int(i > 25)) for i in range(40)], "name_jaro_winkler_score double, name_3gram_jaccard double, address_token_jaccard double, exact_country_match long, is_match long")
    fitted = model.fit_or_load(rows, str(tmp_path / "m"), iterations=4, depth=2)
    logs = [r.train_logloss for r in model.logs(spark, fitted, rows, rows).orderBy("iteration").collect()]
    assert logs == sorted(logs, reverse=True)
    again = model.fit_or_load(rows, str(tmp_path / "m"), mode="load")
    assert model.score(again, rows).where("(match_probability > 0.5) = (is_match = 1)").count() == 40
    assert sum(r.importance for r in model.importances(spark, again).collect()) == pytest.approx(1.0)


def test_model_logs_are_log_losses_of_the_scores(spark):
    """The last log row against plain Python: balanced weights in training, none in validation; scores in (0, 1)."""
    names = "name_jaro_winkler_score double, name_3gram_jaccard double, address_token_jaccard double, exact_country_match long, is_match long"
    rows = spark.createDataFrame([(i % 17 / 17, i % 13 / 13, i % 7 / 7, i % 2, int(i % 17 > 11)) for i in range(300)], names)
    fitted = model.fit(rows, 7, depth=3)
    scored = [(r.is_match, r.match_probability) for r in model.score(fitted, rows).collect()]
    share = sum(y for y, _ in scored) / len(scored)
    losses = [(0.5 / share if y else 0.5 / (1 - share), -math.log(p if y else 1 - p)) for y, p in scored]
    logs = model.logs(spark, fitted, rows, rows).orderBy("iteration").collect()
    assert [r.iteration for r in logs] == list(range(1, 8))
    assert logs[-1].val_logloss == pytest.approx(sum(x for _, x in losses) / len(losses))
    assert logs[-1].train_logloss == pytest.approx(sum(w * x for w, x in losses) / sum(w for w, _ in losses))


def test_hard_examples(spark):
    """The first pair by ids of those that meet the conditions, in either class."""
    from weftlink.plans import registry

    rows = spark.createDataFrame([("b", "x", 1, 0.1, 1), ("a", "z", 1, 0.19, 0), ("a", "y", 1, 0.2, 1), ("a", "w", 0, 0.51, 0), ("c", "v", 0, 0.6, 1), ("c", "w", 0, 0.9, 1), ("a", "q", 0, 0.5, 1)], "s1_id string, pool_id string, is_match int, name_token_jaccard double, country_match int")
    real, registry._judged = registry._judged, lambda spark, sf_dir: rows
    try:
        assert tuple(registry.queries()["hard_positive"](spark, "")["s1_id", "pool_id"].first()) == ("a", "z")
        assert tuple(registry.queries()["hard_negative"](spark, "")["s1_id", "pool_id"].first()) == ("c", "v")
    finally:
        registry._judged = real


def test_tsv_round_trip(spark, tmp_path):
    rows = [("S1-1", 'quote " and\ttab', "NA", "US"), ("007", "", None, "null")]
    df = spark.createDataFrame(rows, io.ENTITY)
    io.write_tsv(df, str(tmp_path / "x"))
    got = {r.entity_id: r for r in io.read_tsv(spark, str(tmp_path / "x"), io.ENTITY).collect()}
    assert got["S1-1"].business_name == 'quote " and\ttab' and got["S1-1"].business_address == "" and got["007"].country == ""
    kept = {r.entity_id: r for r in io.read_tsv(spark, str(tmp_path / "x"), io.ENTITY, fill=False).collect()}
    assert kept["007"].country is None
    counts = io.line_counts(spark, str(tmp_path / "x"), "*.csv")
    assert counts.agg(F.sum("records")).first()[0] == 2 and io.records_of(counts, "nowhere") == 0
    assert io.inventory(spark, str(tmp_path / "x"), "*.csv").count() >= 1
    io.write_tsv(df, str(tmp_path / "home" / "train" / "a.tsv"))
    assert [tuple(r) for r in io.table_inventory(spark, str(tmp_path / "home")).select("split", "file", "records").collect()] == [("train", "a.tsv", 2)]
    with pytest.raises(ValueError, match="more than 1 rows"):
        io.markdown(df, "Rows", most=1)
    with pytest.raises(Exception, match="already exists"):
        io.write_tsv(df, str(tmp_path / "x"))
    version = io.write_version(df, str(tmp_path / "v"))
    assert spark.read.parquet(version).count() == 2 and io.write_version(df, str(tmp_path / "v")) != version
    report = tmp_path / "r.md"
    io.append_report(str(report), io.markdown(df.select("entity_id"), "Rows"), truncate=True)
    io.append_report(str(report), "end")
    assert report.read_text().startswith("## Rows") and report.read_text().endswith("end\n")


def test_last_line_wins(spark, tmp_path):
    """Truth and result files with repeated records, in files that are split and in several files."""
    from weftlink.plans import linkage

    lines = [f"r{i % 50}\t{'S2-' + str(i)}" for i in range(4000)]
    (tmp_path / "truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = io.read_tsv(spark, str(tmp_path / "truth.tsv"), io.TRUTH, line=True)
        assert rows.rdd.getNumPartitions() > 3
        assert {tuple(r) for r in evaluate.last_rows(rows, ["source1_entity_id"]).collect()} == {(f"r{i % 50}", f"S2-{i}") for i in range(3950, 4000)}
        for k in (1, 2, 3):
            (tmp_path / f"source{k}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n")
        (tmp_path / "ground_truth.tsv").write_text((tmp_path / "truth.tsv").read_text())
        assert linkage.Dataset.read_tsv(spark, str(tmp_path)).truth.count() == 50
        (tmp_path / "found.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "\n".join([*lines[-50:-25], "r25\tS2-0", "r0\tS2-3950,S2-9"]) + "\n")
        row = linkage.evaluate_files(spark, str(tmp_path / "truth.tsv"), str(tmp_path / "found.tsv")).first()
        assert row.entities == 50 and row.macro_f05 == pytest.approx((24 + 0.625 / 1.125) / 50)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_versions(spark, small, tmp_path):
    """Of two writers that start from one version one wins; readers find the newest and any other; without a base both get in."""
    from concurrent.futures import ThreadPoolExecutor

    s1, pool = small
    home = str(tmp_path / "v")
    assert io.versions(spark, home) == [] and io.commit_version(s1, home, after=0) == 1
    with pytest.raises(io.VersionConflict):
        io.commit_version(pool, home, after=0)

    def write(df):
        try:
            return io.commit_version(df, home, after=1)
        except io.VersionConflict:
            return None

    with ThreadPoolExecutor(4) as threads:
        results = list(threads.map(write, [pool, pool.limit(1), pool.limit(2), pool.limit(3)]))
    assert sorted(r is None for r in results) == [False, True, True, True] and io.versions(spark, home) == [1, 2]
    won = [5, 1, 2, 3][results.index(2)]
    assert io.read_version(spark, home).count() == won and io.read_version(spark, home, 1).count() == 4
    with ThreadPoolExecutor(3) as threads:
        assert sorted(threads.map(lambda df: io.commit_version(df, home), [s1, pool, s1])) == [3, 4, 5]
    for bad in (lambda: io.read_version(spark, home, 9), lambda: io.commit_version(s1, home, after=9), lambda: io.read_version(spark, str(tmp_path / "none"))):
        with pytest.raises(ValueError, match="no version"):
            bad()


def test_bucketed_lookups_need_no_shuffle_of_records(spark, small, tmp_path):
    s1, pool = small
    tables = [io.write_bucketed(x, f"bucketed_{k}_{tmp_path.name.replace('-', '_')}", "entity_id", str(tmp_path / k), 4) for k, x in (("s1", s1), ("pool", pool))]
    pairs = block.exact_name(s1, pool)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out, plain = features.attributes(pairs, *tables), features.attributes(pairs, s1, pool)
        shuffles = [x._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for x in (out, plain)]
        assert shuffles[0] == shuffles[1] - 2  # one for each side's records
        assert {tuple(r) for r in out.collect()} == {tuple(r) for r in plain.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_stream(spark, small, tmp_path):
    from weftlink.streaming.incremental import match_stream

    s1, pool = small
    s1.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(s1.schema).parquet(str(tmp_path / "in"))
    match_stream(stream, pool, lambda df, n: seen.extend(df.collect()), str(tmp_path / "ck")).awaitTermination(120)
    assert {(r.source1_entity_id, r.candidate_entity_id) for r in seen} == {("S1-1", "S2-1"), ("S1-1", "S3-2")}


def test_frequent_grams_find_partners(spark, tmp_path):
    """Names that every record of a country bears are candidates of the registered query, though all their grams are frequent."""
    docs = [(i, "same words in each text", "en", f"src{i % 3:02d}") for i in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()["block_tfidf_cosine"](spark, str(tmp_path)).collect()
    assert len(got) == 10 * 20 and {r.cosine for r in got} == {1.0}
