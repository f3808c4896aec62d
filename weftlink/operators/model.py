"""The gradient-boosted match classifier."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import io

FEATURES = ["name_jaro_winkler_score", "name_3gram_jaccard", "address_token_jaccard", "exact_country_match"]


def vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def cells(rows: DataFrame, label: str = "is_match") -> DataFrame:
    """(features, label, n): rows of equal features and label with their number, written once.

    They weigh as much as the rows do one by one, so a pass over them takes the time of different rows. ``n``, if rows
    have it, is the number of pairs that a row stands for.
    """
    n = F.sum("n") if "n" in rows.columns else F.count(F.lit(1))
    return io.written(rows.groupBy(*FEATURES, label).agg(n.cast("long").alias("n")), "cells")


def balanced(cells: DataFrame, label: str = "is_match") -> DataFrame:
    """A weight of n_all / (2 * n_class) for each of a cell's rows."""
    counts = {r[label]: r["size"] for r in cells.groupBy(label).agg(F.sum("n").alias("size")).collect()}  # two rows
    n = sum(counts.values())
    weight = F.lit(1.0)
    for value, size in counts.items():
        weight = F.when(F.col(label) == value, n / (2 * size)).otherwise(weight)
    return cells.withColumn("weight", F.col("n") * weight)


def fit(rows: DataFrame, iterations: int = 100, step: float = 0.05, depth: int = 6, seed: int = 42) -> GBTClassificationModel:
    """Spark's trees on the ``cells`` of rows. Bounds of splits come from at most 10,000 cells, whatever their number, as Spark chooses them."""
    trees = GBTClassifier(labelCol="is_match", featuresCol="features", weightCol="weight", maxIter=iterations, stepSize=step, maxDepth=depth, seed=seed)
    return trees.fit(vectors(balanced(cells(rows))))


def fit_or_load(rows: DataFrame, path: str, mode: str = "train", **settings: float) -> GBTClassificationModel:
    if mode == "load":
        return GBTClassificationModel.load(path)
    model = fit(rows, **settings)
    model.write().overwrite().save(path)
    return model


def score(model: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    return model.transform(vectors(rows)).withColumn("match_probability", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def logs(spark: SparkSession, model: GBTClassificationModel, train: DataFrame, val: DataFrame) -> DataFrame:
    """(iteration, train_logloss, val_logloss): the binary log loss is half of Spark's; train is weighted, validation isn't."""
    a = model.evaluateEachIteration(vectors(balanced(cells(train))))
    b = model.evaluateEachIteration(vectors(cells(val).withColumn("weight", F.col("n").cast("double"))))
    return spark.createDataFrame([(i + 1, x / 2, y / 2) for i, (x, y) in enumerate(zip(a, b, strict=True))], "iteration int, train_logloss double, val_logloss double")


def importances(spark: SparkSession, model: GBTClassificationModel) -> DataFrame:
    return spark.createDataFrame([(n, float(model.featureImportances[i])) for i, n in enumerate(FEATURES)], "feature string, importance double")
