from pyspark.sql import functions as F

from weftlink.plans import linkage
from weftlink.plans.fixtures import er_view


def test_files_to_scores(spark, sf, tmp_path):
    view = er_view(spark, sf)
    data = linkage.Dataset(view.s1, view.s2, view.s3, view.truth)
    data.write(str(tmp_path / "raw"))
    clean = linkage.preprocess(linkage.Dataset.read(spark, str(tmp_path / "raw")))
    clean.write(str(tmp_path / "clean"))
    data = linkage.Dataset.read(spark, str(tmp_path / "clean"))
    parts = linkage.splits(data)
    assert sum(p.s1.count() for p in parts.values()) == data.s1.count() and parts["val"].s2.count() == data.s2.count()
    held = linkage.country_splits(data, "EN", "DE")
    assert held["test"].s1.where("country != 'DE'").isEmpty()
    assert linkage.downsample(data, 0.5).s1.count() == round(0.5 * data.s1.count())

    linkage.run_blocking(data, str(tmp_path / "candidates"), max_df=0.5)
    lists = spark.read.parquet(str(tmp_path / "candidates"))
    assert lists.count() == data.s1.count()
    linkage.run_features(data, lists, str(tmp_path / "features"))
    rows = spark.read.parquet(str(tmp_path / "features"))
    assert rows.where("is_match = 1").count() > 0
    linkage.train_and_predict(rows, rows, data.s1, str(tmp_path / "model"), str(tmp_path / "results"), thresholds=[0.4, 0.5], iterations=3)
    scores = linkage.evaluate_predictions(data.truth, spark.read.parquet(str(tmp_path / "results"))).collect()
    assert [r.threshold for r in scores] == [0.4, 0.5] and all(r.macro_f05 > 0.5 for r in scores)


def test_tsv_without_truth(spark, tmp_path):
    for k in (1, 2, 3):
        (tmp_path / f"source{k}.tsv").write_text(f"entity_id\tbusiness_name\tbusiness_address\tcountry\nS{k}-1\tFoo Company\tHigh Street\tus\nS{k}-2\tNA\t\t\n")
    data = linkage.preprocess(linkage.Dataset.read_tsv(spark, str(tmp_path), truth=False))
    got = {r.entity_id: r for r in data.pool.collect()}
    assert got["S2-1"].business_name == "foo co" and got["S3-1"].country == "US" and got["S3-2"].country == "UNKNOWN" and got["S2-2"].business_name == ""
    linkage.run_blocking(data, str(tmp_path / "c"))
    lists = {r[0]: r[1] for r in spark.read.parquet(str(tmp_path / "c")).collect()}
    assert lists == {"S1-1": "S2-1,S3-1", "S1-2": ""}
    linkage.run_features(data, spark.read.parquet(str(tmp_path / "c")), str(tmp_path / "f"))
    assert "is_match" not in spark.read.parquet(str(tmp_path / "f")).columns
    assert spark.read.parquet(str(tmp_path / "f")).agg(F.min("name_jaro_winkler_score")).first()[0] == 1.0
