"""Deterministic exact-size samples and splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text


def order_key(c: Column, seed: int) -> Column:
    return F.md5(F.concat(c.cast("string"), F.lit(str(seed))).cast("binary"))


def first_by_hash(df: DataFrame, key: str, n: int, seed: int = 42, rest: bool = False) -> DataFrame:
    """The n rows that come first by md5(key, seed), or all others if ``rest``.

    A histogram over the first four hex digits (at most 65,536 rows) tells how many rows lie before each prefix. Only
    the one prefix that holds the n-th row is ranked, so no task orders the table.
    """
    rows = df.withColumn("__h", order_key(F.col(key), seed)).withColumn("__p", F.substring("__h", 1, 4))
    counts = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    cut = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).where((F.col("__before") < n) & (F.col("__before") + F.col("__n") >= n)).select(F.col("__p").alias("__cut"), "__before")
    found = cut.first()  # a single row, or none if n covers nothing or all
    if found is None:
        return df if (n > 0) != rest else df.limit(0)
    inside = Window.partitionBy("__p").orderBy("__h", key)
    edge = rows.where(F.col("__p") == found["__cut"]).withColumn("__in", F.row_number().over(inside) + found["__before"] <= n)
    clear = rows.where(F.col("__p") != found["__cut"]).withColumn("__in", F.col("__p") < found["__cut"])
    return clear.unionByName(edge).where(~F.col("__in") if rest else F.col("__in")).select(df.columns)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows with ``place``, their place from 0 in the order of md5(key, seed), ties by key.

    Hash prefixes of four hex digits are counted; a row's place is the rows of lower prefixes and its rank within its own.
    """
    rows = df.withColumn("__h", order_key(F.col(key), seed)).withColumn("__p", F.substring("__h", 1, 4))
    counts = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))  # at most 65,536 rows
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy("__h", key)) - 1
    return rows.join(F.broadcast(counts.select("__p", before.alias("__before"))), "__p").withColumn("place", F.col("__before") + inside).select(*df.columns, "place")


def sample_fraction(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Exactly round(fraction * n) rows, halves to even."""
    return first_by_hash(df, key, round(fraction * df.count()), seed)


def split(df: DataFrame, key: str, test_size: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) with ceil(test_size * n) rows in test."""
    n = math.ceil(test_size * df.count())
    return first_by_hash(df, key, n, seed, rest=True), first_by_hash(df, key, n, seed)


def three_way(df: DataFrame, key: str, test_size: float = 0.1, val_size: float = 0.2, seed: int = 42) -> dict[str, DataFrame]:
    """Test first, then validation as val_size/(1-test_size) of the remainder; distinct keys are split, and all rows of a key go with it."""
    rest, test = split(df.select(key).distinct(), key, test_size, seed)
    train, val = split(rest, key, val_size / (1 - test_size), seed)
    return {name: keep_ids(df, ids, key) for name, ids in (("train", train), ("val", val), ("test", test))}


def holdout(df: DataFrame, key: str, train_country: str, test_country: str, val_size: float = 0.2, seed: int = 42) -> dict[str, DataFrame]:
    """One country split by distinct keys into train and validation, another kept whole as test."""
    own = df.where(F.upper("country") == train_country)
    train, val = split(own.select(key).distinct(), key, val_size, seed)
    return {"train": keep_ids(own, train, key), "val": keep_ids(own, val, key), "test": df.where(F.upper("country") == test_country)}


def keep_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return df.join(ids.distinct(), on, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return df.join(ids.distinct(), on, "left_anti")


def sample_pool(pool: DataFrame, required: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """All required ids, and a sample of the others."""
    return keep_ids(pool, required, "entity_id").unionByName(sample_fraction(drop_ids(pool, required, "entity_id"), "entity_id", fraction, seed))


def sample_preserving_truth(s1: DataFrame, pools: list[DataFrame], truth: DataFrame | None, fraction: float = 0.2, seed: int = 42) -> tuple[DataFrame, list[DataFrame], DataFrame | None]:
    """The rows of a sample of s1's distinct ids, their truth rows, and pools that keep every id the truth needs; the truth may be missing."""
    ids = sample_fraction(s1.select("entity_id").distinct(), "entity_id", fraction, seed)
    rows, required = None, s1.select("entity_id").limit(0)
    if truth is not None:
        rows = keep_ids(truth, ids.select(F.col("entity_id").alias("source1_entity_id")), "source1_entity_id")
        required = rows.select(F.explode(text.id_list("matched_entity_ids")).alias("entity_id"))
    return keep_ids(s1, ids, "entity_id"), [sample_pool(p, required, fraction, seed) for p in pools], rows
