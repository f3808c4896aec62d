"""The corpus pipeline: language, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of docs, whatever their names; texts and, in step with them, n_chars are
all that a stage changes. Every stage reads whole texts of any length; rows without a doc_id are documents like others;
an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm import common
from weftlink.llm.queries import WORD_VOCABULARY, table, vocabulary

LEAST_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: not und, and a fifth of the letter trigrams at least known in that language.

    Null, empty and letterless texts go, repeated rows stay. The filters learn from all labelled rows of docs, also from
    those they judge: a language with few documents would else be unknown, and these would be rejected.
    """
    from weftlink.llm.langid import fit, in_known_language

    return in_known_language(docs, fit(docs), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id.

    Null and wordless texts are alike to nothing and stay. Rows that repeat a doc_id and text are one; different texts
    under one doc_id are judged each by its own text, so none is lost with its id.
    """
    from weftlink.llm.minhash import deduplicate

    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; null and empty texts hold none. All rows of a doc_id go if one holds an item."""
    from weftlink.llm.decontaminate import decontaminate

    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; null texts stay null, repeated rows stay repeated."""
    from weftlink.llm.pii import redact

    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences with their ids; a null or empty text has just the end id, repeated rows each."""
    from weftlink.llm.packing import pack

    return pack(docs, vocabulary(WORD_VOCABULARY)).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", packing)]

# Neither language filters nor a tokenizer can be written as SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage writes on its way is deleted when its output is there; the outputs stay."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = common.fresh(spark, f"pipeline-{name}")
        with common.passing(spark):
            docs = common.settle(stage(spark, docs, sf_dir), name, path)
    return docs
