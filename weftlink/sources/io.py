"""TSV and Parquet in and out, file inventory, reports."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import NA_SPELLINGS

ENTITY = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType, fill: bool = True, line: bool = False) -> DataFrame:
    """All columns as strings; missing spellings become null, and empty if ``fill``. The first column, an id, is left alone.

    With ``line``, a last column orders rows as the files do: by the file's name, the offset of the split that a task
    reads, and the row's place in it. Whether a file is split or not, a later line has a greater value.
    """
    raw = spark.read.schema(schema).csv(path, sep="\t", header=True, quote='"', escape='"')
    first, *rest = raw.columns
    place = [F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("offset"), F.monotonically_increasing_id().alias("row")).alias("line")] if line else []
    out = raw.select(F.coalesce(first, F.lit("")).alias(first), *(F.when(~F.col(c).isin(NA_SPELLINGS), F.col(c)).alias(c) for c in rest), *place)
    return out.na.fill("") if fill else out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); in local mode, if unset, in a temporary one."""
    sc = spark.sparkContext
    home = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not home:
        if not re.match(r"local($|\[)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        home = "file://" + tempfile.mkdtemp(prefix="weftlink-")
    return f"{home.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: what is used more than once is computed once, and lineage ends here."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """A new folder of tab-separated files with a header; a path that is there is an error."""
    df.write.csv(path, sep="\t", header=True, quote='"', escape='"', emptyValue="")


def write_version(df: DataFrame, home: str) -> str:
    """The path of a new version's data, committed to the log of ``home``; a path that is being read is never overwritten."""
    return version_path(df.sparkSession, home, commit_version(df, home))


def _log(spark: SparkSession, home: str):
    """(file system, log folder) of a versioned table, by Spark's own file systems."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{home.rstrip('/')}/_versions")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, home: str) -> list[int]:
    """Committed versions in order; none for a new place."""
    fs, log = _log(spark, home)
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(log) if x.getPath().getName().isdigit()) if fs.exists(log) else []


def version_path(spark: SparkSession, home: str, version: int | None = None) -> str:
    """The data of a version, by default of the newest."""
    known = versions(spark, home)
    if not known or version is not None and version not in known:
        raise ValueError(f"no version {'' if version is None else version} in {home}")
    return f"{home.rstrip('/')}/{spark.read.text(f'{home.rstrip('/')}/_versions/{known[-1] if version is None else version:020d}/entry').first().value}"


def read_version(spark: SparkSession, home: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(version_path(spark, home, version))


class VersionConflict(Exception):
    """Another writer has committed since the version that a write was based on."""


def commit_version(df: DataFrame, home: str, after: int | None = None) -> int:
    """Write df to a folder of its own, then make it the version that follows ``after`` (0: the first), by default the newest.

    The log has an entry for each version, which names its folder. An entry is a folder of one file that is made aside
    and put in place by a rename that fails where the number is taken; so of writers with the same number one wins. With
    ``after`` given, the others get VersionConflict and nothing changes; without, they take the next number.
    """
    spark, home = df.sparkSession, home.rstrip("/")
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{home}/{name}")
    while True:
        known = versions(spark, home)
        last = (known or [0])[-1] if after is None else after
        if last and last not in known:
            raise ValueError(f"no version {last} in {home}")
        if _claimed(spark, home, name, last + 1):
            return last + 1
        if after is not None:
            raise VersionConflict(f"version {last + 1} of {home} is taken")


def _claimed(spark: SparkSession, home: str, name: str, version: int) -> bool:
    """Whether the entry of a version, which names a folder, could be put in place."""
    fs, log = _log(spark, home)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    aside, target = path(f"{home}/_entries/{name}"), path(log, f"{version:020d}")
    if fs.exists(target):
        return False
    out = fs.create(path(aside, "entry"), True)
    out.write(bytearray(f"{name}\n".encode()))
    out.close()
    fs.mkdirs(log)
    try:
        moved = fs.rename(aside, target)
    except Exception:  # some file systems raise where others return false
        moved = False
    inside = path(target, name)  # where a rename puts the entry if the target was made in the meantime
    late = bool(moved) and fs.exists(inside)
    for left in (inside, aside):
        if fs.exists(left):
            fs.delete(left, True)
    return bool(moved) and not late


def inventory(spark: SparkSession, path: str, pattern: str = "*", exclude: str | None = None) -> DataFrame:
    """(split, file, path, size_mb) of all files below a path, split being the folder a file is in; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    parts = F.split("path", "/")
    files = files.select(F.element_at(parts, -2).alias("split"), F.element_at(parts, -1).alias("file"), "path", F.round(F.col("length") / 1e6, 6).alias("size_mb"))
    return files.where(~F.col("path").contains(exclude)) if exclude else files


def table_inventory(spark: SparkSession, path: str, pattern: str = "*.csv", exclude: str | None = None) -> DataFrame:
    """(split, file, size_mb, records) of tables written as folders of files: file is a table's folder, split the folder around it.

    Records are lines less a header in each file that has any line; only text lines are read.
    """
    files = inventory(spark, path, pattern, exclude)
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("at"))
    lines = lines.groupBy("at").agg((F.count(F.lit(1)) - 1).alias("records"))
    both = files.withColumn("at", F.regexp_replace("path", "^file:/+", "/")).join(lines, "at", "left")
    return both.groupBy(F.element_at(F.split("path", "/"), -3).alias("split"), F.element_at(F.split("path", "/"), -2).alias("file")).agg(F.round(F.sum("size_mb"), 6).alias("size_mb"), F.sum(F.coalesce("records", F.lit(0))).alias("records"))


def read_tables(spark: SparkSession, path: str, schema: T.StructType, exclude: str | None = None) -> DataFrame:
    """All tables below a path but those whose path holds ``exclude``, as one, with ``file``, the folder each row came from."""
    raw = spark.read.schema(schema).option("recursiveFileLookup", "true").csv(path, sep="\t", header=True, quote='"', escape='"')
    at = F.col("_metadata.file_path")
    rows = raw.where(~at.contains(exclude)) if exclude else raw
    return rows.select("*", F.element_at(F.split(at, "/"), -2).alias("file")).na.fill("")


def records_by_name(counts: DataFrame, names: list[str]) -> DataFrame:
    """(file, records) for each name, 0 for those without a count."""
    asked = counts.sparkSession.createDataFrame([(n,) for n in names], "file string")
    return asked.join(counts.select("file", "records"), "file", "left").select("file", F.coalesce("records", F.lit(0)).alias("records"))


def write_bucketed(df: DataFrame, name: str, key: str, path: str, buckets: int = 64) -> DataFrame:
    """A table whose files are dealt and sorted by ``key``: joins on it with another of as many buckets need no shuffle, and with others none on this side."""
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("errorifexists").saveAsTable(name)
    return df.sparkSession.table(name)


def line_counts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, records): lines less the header, at least 0."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))
    return lines.groupBy("file").agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("records"))


def records_of(counts: DataFrame, file: str) -> int:
    """A file's count, 0 if it isn't there."""
    row = counts.where(F.col("file") == file).first()
    return int(row.records) if row else 0


def schema_rows(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "column_name string, column_type string")


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small result as a Markdown section; one of more than ``most`` rows is an error, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report section of more than {most} rows")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(str(x) for x in r) + " |" for r in rows]) + "\n"


def append_report(path: str, section: str, truncate: bool = False) -> None:
    with open(path, "w" if truncate else "a", encoding="utf-8") as out:
        out.write(section + "\n")
