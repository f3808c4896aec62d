"""The entity-resolution view of the documents table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


@dataclass
class View:
    s1: DataFrame
    s2: DataFrame
    s3: DataFrame
    truth: DataFrame

    @property
    def pool(self) -> DataFrame:
        return self.s2.unionByName(self.s3)


def first_tokens(rows: DataFrame, column: str, n: int, head: int = 500) -> DataFrame:
    """rows with ``t``, which begins with the first n tokens of the simplified text, for every text what the whole of it gives.

    A text's first ``head`` characters are simplified by themselves. If they hold more than n tokens, the first n of them
    are complete, as another follows; else the whole text is simplified. So is a text with a capital sigma among them,
    the only letter whose lower case depends on what follows.
    """
    words = lambda c: F.filter(F.split(text.simplify(c), " "), lambda t: t != "")
    start = F.substring(column, 1, head)
    rows = rows.withColumn("t", words(start))
    return rows.withColumn("t", F.when((F.size("t") > n) & ~F.contains(start, F.lit("\u03a3")), F.col("t")).otherwise(words(column)))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, business_name, business_address, country and link (a key that linked records share)."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.substring("source", 4, 9).cast("int").alias("source"), "text")
    rows = first_tokens(rows, "text", 20)
    cut = lambda a, n: F.array_join(F.slice("t", a, n), " ")
    name = F.concat(F.lit("S"), (F.col("source") % 3 + 1).cast("string"), F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 7, "0"))
    return rows.select(name.alias("entity_id"), cut(1, 4).alias("business_name"), cut(5, 8).alias("business_address"), F.upper("lang").alias("country"), cut(13, 8).alias("link"))


_ENTITIES: dict[tuple[str, str], DataFrame] = {}


def er_view(spark: SparkSession, sf_dir: str) -> View:
    """The sources and truth of a data directory. The entities, which stand for input tables, are derived from the texts once and kept on memory and disk."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _ENTITIES:
        _ENTITIES[at] = entities(spark, sf_dir)
    rows = _ENTITIES[at]
    if not rows.storageLevel.useDisk:  # new, or after a clearCache
        rows.persist()
    s1, s2, s3 = (rows.where(F.col("entity_id").startswith(f"S{k}-")) for k in (1, 2, 3))
    right = s2.unionByName(s3).where(F.col("link") != "")
    lists = right.groupBy("link").agg(F.array_join(F.array_sort(F.collect_set("entity_id")), ",").alias("ids"))  # once for all that share a link
    truth = s1.select("entity_id", "link").join(lists, "link", "left").select(F.col("entity_id").alias("source1_entity_id"), F.coalesce("ids", F.lit("")).alias("matched_entity_ids"))
    return View(*(x.drop("link") for x in (s1, s2, s3)), truth)
