"""Thresholds, result lists and the macro F0.5 score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

THRESHOLDS = [0.70, 0.75, 0.80, 0.85, 0.90, 0.95]


def linear(of: dict[str, Column]) -> Column:
    """A fixed linear score of the four features, for plans that need a deterministic one."""
    return F.round(0.4 * of["name_jaro_winkler_score"] + 0.3 * of["name_3gram_jaccard"] + 0.2 * of["address_token_jaccard"] + 0.1 * of["exact_country_match"], 9)


def linear_score(features: DataFrame) -> DataFrame:
    return features.withColumn("match_probability", linear({c: F.col(c) for c in features.columns}))


def decide(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.withColumn("is_predicted_match", (F.col("match_probability") > threshold).cast("int"))


def sweep(scores: DataFrame, s1: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """(threshold, source1_entity_id, matched_entity_ids) for all thresholds in one job, a row for every s1 record; pairs are shuffled once."""
    steps = THRESHOLDS if thresholds is None else thresholds
    above = scores.where(F.col("match_probability") > min(steps, default=0.0)) if steps else scores.limit(0)
    hits = above.groupBy("source1_entity_id").agg(F.collect_set(F.struct(F.col("candidate_entity_id").alias("id"), F.col("match_probability").alias("p"))).alias("hits"))
    rows = s1.select(F.col("entity_id").alias("source1_entity_id")).join(hits, "source1_entity_id", "left").withColumn("threshold", F.explode(F.array(*map(F.lit, steps))))
    return rows.select("threshold", "source1_entity_id", F.coalesce(text.joined(F.transform(F.filter("hits", lambda h: h["p"] > F.col("threshold")), lambda h: h["id"])), F.lit("")).alias("matched_entity_ids"))


def f05(truth: Column, predicted: Column) -> Column:
    """F0.5 of two id arrays: both empty 1, one empty 0."""
    hits = F.size(F.array_intersect(truth, predicted))
    p, r = hits / F.size(predicted), hits / F.size(F.array_distinct(truth))
    return F.when(F.size(truth) == 0, F.when(F.size(predicted) == 0, 1.0).otherwise(0.0)).when((F.size(predicted) == 0) | (hits == 0), 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def last_rows(lists: DataFrame, by: list[str], order: str | None = None) -> DataFrame:
    """One row per record: of rows that repeat one, the last by ``order``.

    Tables read from files may have a column ``line``, their order there, which is used if no other is named; without
    either, as a table has no order of its own, the greatest list counts.
    """
    order = order or ("line" if "line" in lists.columns else "matched_entity_ids")
    return lists.groupBy(*by).agg(F.max_by("matched_entity_ids", order).alias("matched_entity_ids"))


def f05_by_threshold(scores: DataFrame, truth: DataFrame, thresholds: list[float] | None = None, order: str | None = None) -> DataFrame:
    """(threshold, macro_f05, entities): macro F0.5 of the pairs above each threshold, straight from their scores.

    The same as ``macro`` of ``per_entity`` of ``sweep``, with one shuffle of the scores for any number of thresholds:
    scores and truth lists meet by record, and each record is judged at all thresholds where it lies. Records of the truth
    without a score count as predicted empty, others don't count. Of rows that repeat a pair the highest score decides.
    """
    levels = F.array(*map(F.lit, THRESHOLDS if thresholds is None else thresholds))
    order = order or ("line" if "line" in truth.columns else "matched_entity_ids")
    lists = truth.select("source1_entity_id", F.struct(F.coalesce("matched_entity_ids", F.lit("")).alias("ids"), F.col(order).alias("at")).alias("own"), F.lit(None).cast("struct<p:double,id:string>").alias("hit"))
    hits = scores.select("source1_entity_id", F.lit(None).cast(lists.schema["own"].dataType).alias("own"), F.struct(F.col("match_probability").cast("double").alias("p"), F.col("candidate_entity_id").alias("id")).alias("hit"))
    each = lists.unionByName(hits).groupBy("source1_entity_id").agg(F.max_by("own.ids", "own.at").alias("ids"), F.count("own").alias("rows"), F.max("own.ids").alias("greatest"), F.collect_set("hit").alias("hits")).where("rows > 0")
    each = each.select(F.array_distinct(text.id_list(F.coalesce("ids", "greatest"))).alias("own"), "hits")

    def judged(t: Column) -> Column:
        found = F.array_distinct(F.transform(F.filter("hits", lambda h: h["p"] > t), lambda h: h["id"]))
        return F.struct(t.alias("threshold"), F.transform(F.array(found), lambda x: f05(F.col("own"), x))[0].alias("f05"))

    return macro(each.select(F.explode(F.transform(levels, judged)).alias("x")).select("x.threshold", "x.f05"), ["threshold"])


def best(scores: DataFrame, s1: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """(threshold, source1_entity_id, matched): whether ``sweep`` would find a list, from each record's greatest score."""
    levels = F.array(*map(F.lit, THRESHOLDS if thresholds is None else thresholds))
    top = scores.groupBy("source1_entity_id").agg(F.max("match_probability").alias("top"))
    rows = s1.select(F.col("entity_id").alias("source1_entity_id")).join(top, "source1_entity_id", "left").withColumn("threshold", F.explode(levels))
    return rows.select("threshold", "source1_entity_id", F.coalesce(F.col("top") > F.col("threshold"), F.lit(False)).alias("matched"))


def f05_of_counts(scores: DataFrame, linked: DataFrame, truth: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """(threshold, source1_entity_id, f05) as by ``per_entity`` of ``sweep``, for pairs and truth records that don't repeat.

    ``scores`` holds all pairs, ``linked`` those of the truth. Only counts of pairs above each threshold are shuffled.
    ``n``, if a table has it, is the number of an s1 record's pairs that a row stands for.
    """
    levels = THRESHOLDS if thresholds is None else thresholds
    above = lambda x, name: x.groupBy("source1_entity_id").agg(F.array(*(F.sum(F.when(F.col("match_probability") > t, F.col("n") if "n" in x.columns else F.lit(1)).otherwise(0)) for t in levels)).alias(name))
    own = truth.select("source1_entity_id", F.size(F.array_distinct(text.id_list("matched_entity_ids"))).alias("own"))
    rows = own.join(above(scores, "found"), "source1_entity_id", "left").join(above(linked, "hits"), "source1_entity_id", "left").select("source1_entity_id", "own", "found", "hits", F.posexplode(F.array(*map(F.lit, levels))).alias("at", "threshold"))
    own, found, hits = F.col("own"), *(F.coalesce(F.get(c, "at"), F.lit(0)) for c in ("found", "hits"))
    p, r = hits / found, hits / own
    f05 = F.when(own == 0, F.when(found == 0, 1.0).otherwise(0.0)).when((found == 0) | (hits == 0), 0.0).otherwise(1.25 * p * r / (0.25 * p + r))
    return rows.select("threshold", "source1_entity_id", f05.alias("f05"))


def per_entity(truth: DataFrame, results: DataFrame, thresholds: list[float] | None = None, order: str | None = None) -> DataFrame:
    """f05 of each truth record, for each of ``thresholds`` if given; a record without a result counts as predicted empty.

    Repeated rows of a record, in either table, count once: see ``last_rows``.
    """
    by = ["threshold"] if thresholds is not None else []
    own = last_rows(truth, ["source1_entity_id"], order).select("source1_entity_id", F.array_distinct(text.id_list("matched_entity_ids")).alias("own"))
    if thresholds is not None:
        own = own.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    found = last_rows(results, [*by, "source1_entity_id"], order).select(*by, "source1_entity_id", F.array_distinct(text.id_list("matched_entity_ids")).alias("found"))
    both = own.join(found, [*by, "source1_entity_id"], "left")
    return both.select(*by, "source1_entity_id", f05(F.col("own"), F.coalesce("found", F.array().cast("array<string>"))).alias("f05"))


def macro(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    return scores.groupBy(*(by or [])).agg(F.avg("f05").alias("macro_f05"), F.count(F.lit(1)).alias("entities"))


def singletons(results: DataFrame) -> DataFrame:
    empty = F.count_if(F.col("matched_entity_ids") == "")
    return results.agg(F.count(F.lit(1)).alias("records"), empty.alias("singletons"), (100 * empty / F.count(F.lit(1))).alias("singleton_share"))
