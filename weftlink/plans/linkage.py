"""The stages of a linkage run, from files to files. Every output is a new directory; inputs are never overwritten."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import block, boost, evaluate, features, model, sample
from ..sources import io


@dataclass(frozen=True)
class Dataset:
    """Three sources and the truth of one split; the truth may be missing."""

    s1: DataFrame
    s2: DataFrame
    s3: DataFrame
    truth: DataFrame | None = None

    @property
    def pool(self) -> DataFrame:
        return self.s2.unionByName(self.s3)

    @classmethod
    def read_tsv(cls, spark: SparkSession, home: str, truth: bool = True) -> Dataset:
        """source1.tsv, source2.tsv, source3.tsv and ground_truth.tsv below ``home``; of truth lines that repeat a record the last counts."""
        s1, s2, s3 = (io.read_tsv(spark, f"{home}/source{k}.tsv", io.ENTITY) for k in (1, 2, 3))
        return cls(s1, s2, s3, evaluate.last_rows(io.read_tsv(spark, f"{home}/ground_truth.tsv", io.TRUTH, line=True), ["source1_entity_id"]) if truth else None)

    @classmethod
    def read(cls, spark: SparkSession, home: str, truth: bool = True) -> Dataset:
        s1, s2, s3 = (spark.read.schema(io.ENTITY).parquet(f"{home}/source{k}") for k in (1, 2, 3))
        return cls(s1, s2, s3, spark.read.schema(io.TRUTH).parquet(f"{home}/ground_truth") if truth else None)

    def write_tsv(self, home: str) -> None:
        for name, df in (("source1", self.s1), ("source2", self.s2), ("source3", self.s3), ("ground_truth", self.truth)):
            if df is not None:
                io.write_tsv(df, f"{home}/{name}.tsv")

    def write(self, home: str) -> None:
        for name, df in (("source1", self.s1), ("source2", self.s2), ("source3", self.s3), ("ground_truth", self.truth)):
            if df is not None:
                df.write.parquet(f"{home}/{name}")

    def restricted(self, ids: DataFrame) -> Dataset:
        """The split of these s1 ids: s1 and truth filtered, pools shared."""
        truth = None if self.truth is None else sample.keep_ids(self.truth, ids.select(F.col("entity_id").alias("source1_entity_id")), "source1_entity_id")
        return Dataset(sample.keep_ids(self.s1, ids.select("entity_id"), "entity_id"), self.s2, self.s3, truth)


def preprocess(data: Dataset) -> Dataset:
    """Names, addresses and countries normalised."""

    def clean(df: DataFrame) -> DataFrame:
        country = text.normalize_country(F.nullif("country", F.lit("")))
        return df.select("entity_id", text.normalize("business_name").alias("business_name"), text.normalize("business_address").alias("business_address"), country.alias("country"))

    return Dataset(clean(data.s1), clean(data.s2), clean(data.s3), data.truth)


def splits(data: Dataset, seed: int = 42) -> dict[str, Dataset]:
    """Random 70/20/10 by s1 record."""
    return {name: data.restricted(ids) for name, ids in sample.three_way(data.s1, "entity_id", seed=seed).items()}


def country_splits(data: Dataset, train_country: str = "US", test_country: str = "INDIA", seed: int = 42) -> dict[str, Dataset]:
    """One country 80/20 for training and validation, another as test."""
    return {name: data.restricted(ids) for name, ids in sample.holdout(data.s1, "entity_id", train_country, test_country, seed=seed).items()}


def downsample(data: Dataset, fraction: float = 0.2, seed: int = 42) -> Dataset:
    s1, (s2, s3), truth = sample.sample_preserving_truth(data.s1, [data.s2, data.s3], data.truth, fraction, seed)
    return Dataset(s1, s2, s3, truth)


def run_blocking(data: Dataset, out: str, **fit: float) -> None:
    """Candidate lists of all s1 records."""
    block.id_lists(block.candidates(data.s1, data.pool, **fit), data.s1).write.parquet(out)


def run_features(data: Dataset, candidates: DataFrame, out: str) -> None:
    """Features of all candidate pairs, with is_match if the data has a truth."""
    pairs = features.exploded(candidates)
    rows = features.features(features.attributes(pairs, data.s1, data.pool))
    if data.truth is not None:
        labels = features.labelled(pairs, data.truth).select(F.col("s1_id").alias("source1_entity_id"), F.col("pool_id").alias("candidate_entity_id"), "is_match")
        rows = rows.join(labels, ["source1_entity_id", "candidate_entity_id"])
    rows.write.parquet(out)


def run_exact_features(data: Dataset, out: str) -> None:
    """``run_features`` of the exact-name block, without its lists; only where an id has several rows are they made."""
    if features.repeated_ids(data.s1, data.pool):
        run_features(data, block.exact_lists(data.s1, data.pool), out)
    else:
        features.exact_features(data.s1, data.pool, data.truth).write.parquet(out)


def train_and_predict(train: DataFrame, test: DataFrame, s1: DataFrame, model_path: str, out: str, mode: str = "train", thresholds: list[float] | None = None, val: DataFrame | None = None, logs: str | None = None, by_leaf: bool = False, **settings: float) -> None:
    """Result lists for every threshold, one directory each, in one job; with ``val`` and ``logs``, the log loss of every iteration as CSV.

    Trees grow level by level (Spark's), or leaf by leaf with ``by_leaf``.
    """
    trees = boost if by_leaf else model
    fitted = trees.fit_or_load(train, model_path, mode, **settings)
    if val is not None and logs is not None:
        losses = boost.logs(fitted, train, val) if by_leaf else model.logs(train.sparkSession, fitted, train, val)
        losses.coalesce(1).write.csv(logs, header=True)
    evaluate.sweep(trees.score(fitted, test), s1, thresholds).write.partitionBy("threshold").parquet(out)


def evaluate_predictions(truth: DataFrame, results: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """macro F0.5 of each threshold, by default of those that have results (a directory each)."""
    levels = thresholds if thresholds is not None else sorted(r.threshold for r in results.select("threshold").distinct().collect())
    return evaluate.macro(evaluate.per_entity(truth, results, levels), ["threshold"]).orderBy("threshold")


def evaluate_files(spark: SparkSession, truth: str, results: str) -> DataFrame:
    """macro F0.5 of a result TSV against a truth TSV; of lines that repeat a record the last counts in either."""
    a, b = (io.read_tsv(spark, x, io.TRUTH, line=True) for x in (truth, results))
    return evaluate.macro(evaluate.per_entity(a, b))
