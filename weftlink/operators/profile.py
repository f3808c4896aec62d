"""Data profiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..sources import io


def value_counts(df: DataFrame, c: str, by: list[str] | None = None) -> DataFrame:
    """Counts and percentages of a column's values; the total is a one-row aggregate of the counts."""
    counts = df.groupBy(*(by or []), F.coalesce(F.col(c), F.lit("MISSING")).alias(c)).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(*(by or []), c, "n", F.round(100 * F.col("n") / F.col("total"), 2).alias("percent"))


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls or empty texts per column, in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), (F.coalesce(F.col(c), F.lit("")) == "").alias("gone")) for c in columns))).alias("x")
    return df.select(pairs).groupBy("x.column_name").agg(F.count_if("x.gone").alias("missing"), F.count(F.lit(1)).alias("records")).withColumn("percent", F.round(100 * F.col("missing") / F.col("records"), 2))


def histogram(df: DataFrame, value: Column, name: str) -> DataFrame:
    return df.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def percentiles(df: DataFrame, value: Column, at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Nearest-rank percentiles of an integer, from its histogram: percentile_disc aggregates (value, count) pairs."""
    v = df.select(value.cast("long").alias("v"))
    return v.agg(*(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY v)").cast("long").alias(f"p{round(100 * p)}") for p in at), F.avg("v").alias("mean"))


def uniqueness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values and their share per column; duplicates are removed before they are counted."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns))).alias("x")
    per = df.select(pairs).groupBy("x.column_name", "x.value").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("column_name").agg(F.count("value").alias("distinct_values"), F.sum("n").alias("records")).withColumn("percent", F.round(100 * F.col("distinct_values") / F.col("records"), 2))


def top_values(df: DataFrame, c: str, k: int = 10) -> DataFrame:
    """The k most frequent values, ties by value."""
    return df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), c).limit(k)


def match_counts(truth: DataFrame) -> DataFrame:
    ids = text.id_list("matched_entity_ids")
    of = lambda p: F.size(F.filter(ids, lambda x: x.startswith(p)))
    return truth.select("source1_entity_id", F.size(ids).alias("n"), of("S2-").alias("n2"), of("S3-").alias("n3"))


def composition(df: DataFrame, c: str) -> DataFrame:
    counts = text.composition(c)
    return df.agg(*(F.sum(v).alias(k) for k, v in counts.items()))


def medians(rows: DataFrame, by: list[str], value: str = "v", most: int = 1_000_000, steps: int = 1000) -> DataFrame:
    """by and median of a double for each group: the middle value, or the mean of the two middle ones; nulls don't count.

    A mergeable quantile sketch of each group brackets the middle ranks between two of its quantiles; a second pass
    counts what lies below the bracket and each value inside, and only these are ordered. While a bracket may still hold
    more than ``most`` rows, it is sketched again by itself. Quantiles are off by at most a tenth of a step in rank, the
    bracket is wider than that.
    """
    v = rows.select(F.struct(*by).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")  # a struct, so that null is a group
    state, left = None, None
    while left is None or left > most:
        near = v.withColumns({"lo": F.lit(None).cast("double"), "size": F.lit(None).cast("long")}) if state is None else v.join(state, "g").where("v <= hi")
        out = F.col("v") < F.col("lo")  # null, so false, in the first round
        sketch = near.groupBy("g").agg(F.count(F.lit(1)).alias("seen"), F.first("size").alias("size"), F.count_if(out).alias("below"), F.percentile_approx(F.when(~F.coalesce(out, F.lit(False)), F.col("v")), [i / steps for i in range(steps + 1)], 10 * steps).alias("q"))
        n, m = F.coalesce("size", "seen"), F.col("seen") - F.col("below")
        at = lambda k: steps * (k - F.col("below")) / m  # noqa: E731, B023
        first = F.greatest(F.floor(at(F.floor((n - 1) / 2))) - 1, F.lit(0)).cast("int")
        last = F.least(F.ceil(at(F.floor(n / 2))) + 1, F.lit(steps)).cast("int")
        state = io.written(sketch.select("g", n.alias("size"), F.get("q", first).alias("lo"), F.get("q", last).alias("hi"), F.ceil(m * (last - first + 1) / steps).alias("most")), "bracket")
        was, left = left, state.where("lo < hi").agg(F.max("most").alias("most")).first().most or 0
        if was is not None and left >= was:  # repeats of few values: counting them is cheap
            break
    values = v.join(state, "g").where("v <= hi").groupBy("g", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("same"), F.first("size").alias("n"))
    upto = F.sum("same").over(Window.partitionBy("g").orderBy(F.asc_nulls_first("v")))  # null stands for all below the bracket
    middle = values.select("g", "v", "n", (upto - F.col("same")).alias("start"), upto.alias("stop"))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    hits = middle.select("g", "v", ((F.col("start") <= low) & (low < F.col("stop"))).cast("int").alias("a"), ((F.col("start") <= high) & (high < F.col("stop"))).cast("int").alias("b"))
    return hits.where("a + b > 0").groupBy("g").agg((F.sum(F.col("v") * (F.col("a") + F.col("b"))) / 2).alias("median")).select("g.*", "median")


def weighted_medians(counts: DataFrame, by: list[str], value: str = "v", n: str = "n", steps: int = 1000) -> DataFrame:
    """``medians`` of rows that are given as distinct values of each group with their numbers ``n``.

    Quantiles of the distinct values cut each group into ranges, whose numbers tell in which ones the middle ranks lie;
    only the values there are ordered.
    """
    rows = counts.select(F.struct(*by).alias("g"), F.col(value).cast("double").alias("v"), F.col(n).alias("n")).where("v is not null")
    cuts = rows.groupBy("g").agg(F.percentile_approx("v", [i / steps for i in range(1, steps)], 10 * steps).alias("q"), F.sum("n").alias("total"))
    cuts = io.written(cuts.withColumn("q", F.array_distinct("q")), "quantiles")  # a row for each group
    part = F.coalesce(F.nullif(F.array_position(F.transform("q", lambda x: F.col("v") <= x), True), F.lit(0)), F.lit(steps + 1))
    dealt = io.written(rows.join(F.broadcast(cuts), "g").select("g", "v", "n", "total", part.alias("part")), "ranges")
    sums = dealt.groupBy("g", "part").agg(F.sum("n").alias("size"), F.first("total").alias("total"))  # at most ``steps`` of a group
    before = F.sum("size").over(Window.partitionBy("g").orderBy("part")) - F.col("size")
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    kept = sums.withColumn("before", before).where((F.col("before") <= high) & (F.col("before") + F.col("size") > low)).select("g", "part", "before")
    upto = F.sum("n").over(Window.partitionBy("g", "part").orderBy("v")) + F.col("before")
    middle = dealt.join(F.broadcast(kept), ["g", "part"]).select("g", "v", "n", "total", upto.alias("stop")).withColumn("start", F.col("stop") - F.col("n"))
    times = ((F.col("start") <= low) & (low < F.col("stop"))).cast("int") + ((F.col("start") <= high) & (high < F.col("stop"))).cast("int")
    return middle.withColumn("times", times).where("times > 0").groupBy("g").agg((F.sum(F.col("v") * F.col("times")) / 2).alias("median")).select("g.*", "median")


def separability(pairs: DataFrame, measures: list[str], label: str = "is_match") -> DataFrame:
    """Mean and median of each measure in either class; ``n``, if pairs have it, is the number of pairs that a row stands for."""
    n = F.col("n") if "n" in pairs.columns else F.lit(1)
    long = pairs.select(label, n.cast("long").alias("n"), F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in measures))).alias("x")).select(label, "x.measure", "x.v", "n")
    long = io.written(long.groupBy(label, "measure", "v").agg(F.sum("n").alias("n")), "measures")
    means = long.groupBy(label, "measure").agg((F.sum(F.col("v") * F.col("n")) / F.sum(F.when(F.col("v").isNotNull(), F.col("n")))).alias("mean"))
    middle = weighted_medians(long, [label, "measure"]).withColumnsRenamed({label: "l", "measure": "m"})
    return means.join(middle, F.col(label).eqNullSafe(F.col("l")) & (F.col("measure") == F.col("m")), "left").select(label, "measure", "mean", "median")
