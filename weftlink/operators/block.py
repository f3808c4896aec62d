"""Candidate generation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..sources import io

CHUNK = 1000  # ids of a name that lie in one array, so that a row unfolds into a million pairs at most
BLOCK = 8192  # names of a country and side that meet those of another block in one group


def spread(df: DataFrame) -> int:
    """Partitions for rows that are few and small but unfold into many: a fixed number, which AQE doesn't coalesce."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def exact_classes(s1: DataFrame, pool: DataFrame, carry: tuple[list[str], list[str]] = ([], []), match_empty_names: bool = False, chunk: int | None = None) -> DataFrame:
    """Pairs with equal names in the same known country as pairs of classes: (country, business_name, s1_ids, pool_ids).

    Each id of one array pairs with each of the other; columns that are carried from s1 and from the pool, as an address,
    tell classes apart and get the endings _1 and _2. A name of more than ``CHUNK`` records on a side is dealt into parts
    of about that many, and every part meets every part of the other side in a partition of its own. So what is shuffled
    grows with the records, and pairs only come about where they are used. Ids that repeat within a name count each.
    """
    name, chunk = ["country", "business_name"], chunk or CHUNK
    rows = [x.where(text.known_country("country")) for x in (s1, pool)]
    if not match_empty_names:
        rows = [x.where(F.col("business_name") != "") for x in rows]
    both = rows[0].select(*name, F.lit(1).alias("side")).unionByName(rows[1].select(*name, F.lit(2).alias("side")))
    sizes = both.groupBy(*name).agg(*(F.count_if(F.col("side") == k).alias(f"n{k}") for k in (1, 2))).where(F.greatest("n1", "n2") > chunk).where(F.least("n1", "n2") > 0)
    parts = sizes.select(*name, *(F.ceil(F.col(f"n{k}") / chunk).alias(f"parts{k}") for k in (1, 2)))  # at most a row for each CHUNK records
    sides = []
    for k, x in enumerate(rows, 1):
        part = F.pmod(F.xxhash64("entity_id"), F.coalesce(f"parts{k}", F.lit(1))).alias(f"part{k}")
        others = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(f"parts{3 - k}", F.lit(1)) - 1)).alias(f"part{3 - k}")
        dealt = x.join(F.broadcast(parts), name, "left").select(*name, "entity_id", f"parts{3 - k}", part, *(F.col(c).alias(f"{c}_{k}") for c in carry[k - 1]))
        classes = dealt.groupBy(*name, f"part{k}", f"parts{3 - k}", *(f"{c}_{k}" for c in carry[k - 1])).agg(F.collect_list("entity_id").alias("s1_ids" if k == 1 else "pool_ids"))
        sides.append(classes.select(*name, f"part{k}", others, *classes.columns[4:]).repartition(spread(s1), *name, "part1", "part2"))
    return sides[0].join(sides[1], [*name, "part1", "part2"]).drop("part1", "part2")


def expanded(classes: DataFrame) -> DataFrame:
    """A row (s1_id, pool_id) for each pair of the ids in s1_ids and pool_ids, with all other columns."""
    rest = [c for c in classes.columns if c not in ("s1_ids", "pool_ids")]
    return classes.select(*rest, "pool_ids", F.explode("s1_ids").alias("s1_id")).select("s1_id", F.explode("pool_ids").alias("pool_id"), *rest)


def exact_name(s1: DataFrame, pool: DataFrame, match_empty_names: bool = False) -> DataFrame:
    """(s1_id, pool_id) with equal names in the same known country; a name that many records share is dealt over tasks."""
    return expanded(exact_classes(s1, pool, match_empty_names=match_empty_names).select("s1_ids", "pool_ids"))


def of_names(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Pairs (country, name_1, name_2) of names as pairs of records (s1_id, pool_id), with the further columns of pairs.

    The ids of a name come in arrays of about ``CHUNK``; ids that repeat within a name count once.
    """
    name = ["country", "business_name"]
    out = pairs
    for k, x, ids in ((1, s1, "s1_ids"), (2, pool, "pool_ids")):
        rows = x.select(*name, "entity_id").distinct()
        parts = rows.groupBy(*name).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK).select(*name, F.ceil(F.col("n") / CHUNK).alias("parts"))
        part = F.pmod(F.xxhash64("entity_id"), F.coalesce("parts", F.lit(1))).alias(f"part{k}")
        members = rows.join(F.broadcast(parts), name, "left").groupBy("country", F.col("business_name").alias(f"name_{k}"), part).agg(F.collect_list("entity_id").alias(ids))
        out = out.join(members, ["country", f"name_{k}"])
    return expanded(out.repartition(spread(s1), "name_1", "name_2", "part1", "part2").drop("country", "name_1", "name_2", "part1", "part2"))


def several_names(s1: DataFrame, pool: DataFrame) -> bool:
    """Whether an id has rows of different names or countries, so that pairs of names can repeat a pair of ids."""
    apart = lambda x: x.groupBy("entity_id").agg((F.min(n) != F.max(n)).alias("apart")).where("apart")
    n = F.struct(F.coalesce("country", F.lit("")), F.coalesce("business_name", F.lit("")))
    return not apart(s1).unionByName(apart(pool)).isEmpty()


def met(left: DataFrame, right: DataFrame, least: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(country, name_1, name_2, total) of the names whose sum of products of weights over equal grams is above ``least`` of their needs.

    Both sides hold (country, business_name, grams, weights, need), grams as hashes. The names of a country are dealt into
    blocks of about ``BLOCK`` a side, and each pair of blocks is a group of its own, multiplied as two matrices. What may
    be above is summed gram by gram in the same task, in double precision: no other pair is ever written.
    """
    sizes = [x.groupBy("country").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(f"blocks{k}")) for k, x in ((1, left), (2, right))]
    blocks = F.broadcast(sizes[0].join(sizes[1], "country"))  # a row for each country
    sides = []
    for k, x in ((1, left), (2, right)):
        others = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"blocks{3 - k}") - 1)).alias(f"block{3 - k}")
        dealt = x.join(blocks, "country").select(*(F.col(c).alias(c) for c in x.columns), F.pmod(F.xxhash64("business_name"), F.col(f"blocks{k}")).alias(f"block{k}"), others)
        sides.append(dealt.repartition(spread(left), "country", "block1", "block2").groupBy("country", "block1", "block2"))

    def pairs(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = list(above(a, b, least)) if len(a) and len(b) else []
        i, j, total = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1, 2))
        return pd.DataFrame({"country": a["country"].to_numpy()[i], "name_1": a["business_name"].to_numpy()[i], "name_2": b["business_name"].to_numpy()[j], "total": total.astype(float)})

    return sides[0].cogroup(sides[1]).applyInPandas(pairs, "country string, name_1 string, name_2 string, total double")


def above(a: pd.DataFrame, b: pd.DataFrame, least: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int = 512, step: int = 1024, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in a and in b of the rows whose sum of products is above ``least``, and the sum.

    Grams fall into ``width`` columns, weights of one column are added: as none is negative, a product of the two
    matrices is never less than the sum over equal grams. Those above are summed exactly, ``most`` pairs at a time.
    """

    def flat(x: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = x["grams"].map(len).to_numpy()
        return np.concatenate([[0], np.cumsum(n)]), np.concatenate(x["grams"].to_numpy()), np.concatenate(x["weights"].to_numpy())

    def dense(first: np.ndarray, grams: np.ndarray, weights: np.ndarray) -> np.ndarray:
        n = len(first) - 1
        at = np.repeat(np.arange(n), np.diff(first)) * width + grams % width
        return np.bincount(at, weights, n * width).reshape(n, width).astype(np.float32)

    (first_a, grams_a, weights_a), (first_b, grams_b, weights_b) = flat(a), flat(b)
    known = np.unique(grams_b)
    keys_b = np.repeat(np.arange(len(b)), np.diff(first_b)) * len(known) + np.searchsorted(known, grams_b)
    order = np.argsort(keys_b)
    keys_b, weights_b_sorted = keys_b[order], weights_b[order]
    place = np.searchsorted(known, grams_a)
    place = np.where(known[np.minimum(place, len(known) - 1)] == grams_a, place, -1) if len(known) else np.full(len(grams_a), -1)

    def summed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n = first_a[i + 1] - first_a[i]
        pair = np.repeat(np.arange(len(i)), n)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first_a[i], n)
        pair, at = pair[place[at] >= 0], at[place[at] >= 0]
        key = j[pair] * len(known) + place[at]
        hit = np.minimum(np.searchsorted(keys_b, key), max(0, len(keys_b) - 1))
        same = keys_b[hit] == key if len(keys_b) else np.zeros(0, bool)
        return np.bincount(pair[same], weights_a[at[same]] * weights_b_sorted[hit[same]], len(i))

    need_a, need_b = a["need"].to_numpy(float), b["need"].to_numpy(float)
    right = dense(first_b, grams_b, weights_b).T
    for start in range(0, len(a), step):
        stop = min(start + step, len(a))
        low, high = first_a[start], first_a[stop]
        part = dense(first_a[start : stop + 1] - low, grams_a[low:high], weights_a[low:high])
        bound = least(need_a[start:stop, None].astype(np.float32), need_b[None, :].astype(np.float32)) - np.float32(1e-3)  # more than single precision can lose
        i, j = np.nonzero(part @ right > bound)
        i = i + start
        for k in range(0, len(i), most):
            x, y = i[k : k + most], j[k : k + most]
            total = summed(x, y)
            kept = total > least(need_a[x], need_b[y]) - 1e-9  # the query's own measure decides on what is so close
            yield x[kept], y[kept], total[kept]


@dataclass(frozen=True)
class NameBlocks:
    """Exact-name candidates: pairs (s1_id, pool_id), and for names that too many records share only their members.

    members: (country, business_name, side, id), side 1 for s1 and 2 for the pool; each side of a name pairs with all of
    the other.
    """

    pairs: DataFrame
    members: DataFrame

    def expanded(self, chunk: int = CHUNK) -> DataFrame:
        """All pairs, for steps that need each; members meet as arrays of about ``chunk`` ids, which unfold after the last shuffle."""
        left, right = (self.members.where(F.col("side") == k).select(F.col("id").alias("entity_id"), "country", "business_name") for k in (1, 2))
        return self.pairs.unionByName(expanded(exact_classes(left, right, chunk=chunk).select("s1_ids", "pool_ids")))


def exact_name_blocks(s1: DataFrame, pool: DataFrame, most: int = 1_000_000) -> NameBlocks:
    """As ``exact_name``, but a name that would give more than ``most`` pairs in a country stays a block of members.

    Both sides are counted by name first, so the size of what is kept grows with the records and not with the square of
    a name's. Ids that repeat within a name count each.
    """
    name = ["country", "business_name"]
    sides = [x.where(text.known_country("country") & (F.col("business_name") != "")).select(F.col("entity_id").alias("id"), *name).withColumn("side", F.lit(k)) for k, x in ((1, s1), (2, pool))]
    both = sides[0].unionByName(sides[1])
    n = lambda k: F.count_if(F.col("side") == k).cast("double")
    hot = io.written(both.groupBy(*name).agg((n(1) * n(2)).alias("pairs")).where(F.col("pairs") > most).select(*name), "hot-names")
    left, right = (x.join(hot, name, "left_anti") for x in sides)
    pairs = left.select(F.col("id").alias("s1_id"), *name).join(right.select(F.col("id").alias("pool_id"), *name), name).select("s1_id", "pool_id")
    return NameBlocks(pairs, both.join(hot, name, "left_semi").select(*name, "side", "id"))


def gram_counts(rows: DataFrame) -> DataFrame:
    """(country, entity_id, key, gram, tf) of padded 3-grams of names in known countries; every row is a document, key a hash of its country and name."""
    bags = rows.where(text.known_country("country")).select("country", "entity_id", F.xxhash64("country", "business_name").alias("key"), text.padded_grams("business_name").alias("grams"))
    tf = lambda g: (F.size("grams") - F.size(F.array_remove("grams", g))).cast("long")
    one = F.explode(F.transform(F.array_distinct("grams"), lambda g: F.struct(g.alias("gram"), tf(g).alias("tf"))))
    return bags.select("country", "entity_id", "key", one.alias("g")).select("country", "entity_id", "key", "g.gram", "g.tf")


def vocabulary(pool: DataFrame, counts: DataFrame | None = None, min_df: int = 2, max_df: float = 0.03, max_features: int = 150_000) -> DataFrame:
    """(country, gram, df, idf) fitted on the pool, per country.

    Grams in fewer than min_df or more than max_df of a country's records are dropped, which bounds the postings that
    are joined later; then the most frequent max_features stay, ties by gram. Frequencies are written once. Only in
    countries that have more grams are they ranked, and there only those that tie at the cut.
    """
    counts = gram_counts(pool) if counts is None else counts
    sizes = pool.where(text.known_country("country")).groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    df = counts.groupBy("country", "gram").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    kept = io.written(df.join(sizes, "country").where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n"))), "gram-df")
    if not kept.groupBy("country").count().where(F.col("count") > max_features).isEmpty():
        totals = kept.groupBy("country", "total").agg(F.count(F.lit(1)).alias("same"))  # few rows: most grams share their total
        before = F.coalesce(F.sum("same").over(Window.partitionBy("country").orderBy(F.desc("total")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        kept = kept.join(totals.withColumn("before", before).where(F.col("before") < max_features), ["country", "total"])
        edge = kept.where(F.col("before") + F.col("same") > max_features).withColumn("rank", F.row_number().over(Window.partitionBy("country", "total").orderBy("gram")))
        kept = kept.where(F.col("before") + F.col("same") <= max_features).unionByName(edge.where(F.col("before") + F.col("rank") <= max_features).drop("rank"))
    return kept.select("country", "gram", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(country, entity_id, gram, w) of unit length per record; grams off the vocabulary are dropped first."""
    return vectors(counts, vocab).select("country", "entity_id", F.explode("grams").alias("g")).select("country", "entity_id", "g.gram", "g.w")


def vectors(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(country, entity_id, key, grams): each record's grams as (df, gram, w) from rare to frequent, w of unit length.

    Rows that repeat a record give one; further columns of counts, as a side, tell records apart and stay.
    """
    record = [c for c in counts.columns if c not in ("gram", "tf")]
    raw = counts.join(vocab.select("country", "gram", "df", "idf"), ["country", "gram"]).withColumn("raw", F.col("tf") * F.col("idf"))
    sets = raw.groupBy(*record).agg(F.sort_array(F.collect_set(F.struct("df", "gram", F.col("raw").alias("w")))).alias("grams"), F.sum(F.col("raw") * F.col("raw")).alias("squares"), F.count(F.lit(1)).alias("n"))
    norm = F.sqrt(F.col("squares") * F.size("grams") / F.col("n"))
    return sets.select(*record, F.zip_with("grams", F.array_repeat(norm, F.size("grams")), lambda g, x: F.struct(g["df"].alias("df"), g["gram"].alias("gram"), (g["w"] / x).alias("w"))).alias("grams"))


def bounded(records: DataFrame, threshold: float) -> DataFrame:
    """The vectors with ``kept``, their rarest grams that must be posted, and ``rest``, a bound on what the others add; side is 1 or 2.

    What the grams from one on can add to a cosine with the other side is at most the length of that part, and at most
    the sum of its weights times each gram's greatest weight on the other side. Grams are kept while the lesser bound is
    above the threshold: two records whose cosine is above it share a gram that both keep, as one's last kept gram comes
    first in the order and all that the two share up to there is kept by both.
    """
    grams = records.select("side", "country", "entity_id", "key", F.explode("grams").alias("g")).select("side", "country", "entity_id", "key", "g.*")
    most = grams.groupBy("country", "gram").agg(*(F.max(F.when(F.col("side") == k, F.col("w"))).alias(f"most{k}") for k in (1, 2)))
    rows = grams.join(most, ["country", "gram"]).withColumn("most", F.coalesce(F.when(F.col("side") == 1, F.col("most2")).otherwise(F.col("most1")), F.lit(0.0)))
    sets = rows.groupBy("side", "country", "entity_id", "key").agg(F.sort_array(F.collect_list(F.struct("df", "gram", "w", "most"))).alias("grams"))

    def step(acc: Column, g: Column) -> Column:
        squares, product = acc["squares"] + g["w"] * g["w"], acc["product"] + g["w"] * g["most"]
        bound = F.least(F.sqrt(squares), product)
        over = bound > threshold - 1e-9
        return F.struct(squares.alias("squares"), product.alias("product"), (acc["kept"] + over.cast("int")).alias("kept"), F.when(over, acc["rest"]).otherwise(bound).alias("rest"))

    first = F.struct(F.lit(0.0).alias("squares"), F.lit(0.0).alias("product"), F.lit(0).alias("kept"), F.lit(0.0).alias("rest"))
    sets = sets.select("*", F.aggregate(F.reverse("grams"), first, step).alias("x"))
    return sets.where("x.kept > 0").select("side", "country", "entity_id", "key", F.map_from_arrays(F.col("grams.gram"), F.col("grams.w")).alias("weights"), F.slice(F.transform("grams", lambda g: F.struct(g["df"].alias("df"), g["gram"].alias("gram"), g["w"].alias("w"))), F.lit(1), F.col("x.kept")).alias("kept"), F.col("x.rest").alias("rest"))


def postings(rows: DataFrame, side: int) -> DataFrame:
    """(country, gram) with w, id, key, rest and the last kept (df, gram) of records, names ending in ``side``."""
    last = F.element_at("kept", -1)
    out = rows.select("country", F.col("entity_id").alias("id"), "key", "rest", F.struct(last["df"], last["gram"]).alias("last"), F.explode("kept").alias("g"))
    return out.select("country", F.col("g.gram").alias("gram"), *(F.col(c).alias(f"{c.removeprefix('g.')}{side}") for c in ("id", "key", "rest", "last", "g.w")))


def bounded_sides(s1: DataFrame, pool: DataFrame, threshold: float, vocab: DataFrame | None = None, **fit: float) -> tuple[DataFrame, DataFrame]:
    """``bounded`` of s1 and of the pool, computed together and written once; the vocabulary is the pool's, if none is given."""
    vocab = vocabulary(pool, **fit) if vocab is None else vocab
    counts = gram_counts(s1).withColumn("side", F.lit(1)).unionByName(gram_counts(pool).withColumn("side", F.lit(2)))
    both = io.written(bounded(vectors(counts, vocab), threshold), "bounded-vectors")
    return both.where("side = 1"), both.where("side = 2")


def name_cosines(s1: DataFrame, pool: DataFrame, threshold: float = 0.65, **fit: float) -> DataFrame:
    """(country, name_1, name_2, cosine) of distinct names above the threshold; the vocabulary counts the pool's records.

    Names of which no gram can lift a pair above it are left out (see ``bounded``); the others meet by their whole
    vectors. Bounds by part of a vector let through a hundred times as many pairs as are above.
    """
    names = [x.select("country", "business_name").distinct().withColumn("entity_id", F.col("business_name")) for x in (s1, pool)]
    left, right = bounded_sides(*names, threshold, vocabulary(pool, **fit))
    whole = lambda x: x.select("country", F.col("entity_id").alias("business_name"), F.transform(F.map_keys("weights"), lambda g: F.xxhash64(g)).alias("grams"), F.map_values("weights").alias("weights"), F.lit(threshold).alias("need"))
    return met(whole(left), whole(right), np.minimum).withColumnRenamed("total", "cosine").where(F.col("cosine") > threshold)


def tfidf_cosine(s1: DataFrame, pool: DataFrame, threshold: float = 0.65, **fit: float) -> DataFrame:
    """(s1_id, pool_id, cosine) above the threshold, from the cosines of distinct names. Of rows that repeat an id, the greatest cosine counts."""
    out = of_names(name_cosines(s1, pool, threshold, **fit), s1, pool)
    return out.groupBy("s1_id", "pool_id").agg(F.max("cosine").alias("cosine")) if several_names(s1, pool) else out


def ngram_jaccard(s1: DataFrame, pool: DataFrame, threshold: float = 0.4, n: int = 3) -> DataFrame:
    """(s1_id, pool_id, jaccard) above the threshold over distinct character grams of names.

    Distinct names meet by their grams, are measured again on the whole sets, and only then unfold into records.
    """

    def sets(rows: DataFrame) -> DataFrame:
        names = rows.where(text.known_country("country")).select("country", "business_name").distinct().withColumn("grams", text.char_grams("business_name", n)).where(F.size("grams") > 0)
        return names.select("country", "business_name", F.transform("grams", lambda g: F.xxhash64(g)).alias("grams"), F.transform("grams", lambda _: F.lit(1.0)).alias("weights"), (F.size("grams") * threshold / (1 + threshold)).alias("need"))

    names = met(sets(s1), sets(pool), np.add).drop("total")  # common > threshold * (a + b - common)
    measured = names.withColumn("jaccard", text.gram_jaccard("name_1", "name_2", n)).where(F.col("jaccard") > threshold)
    return of_names(measured, s1, pool)


def exact_lists(s1: DataFrame, pool: DataFrame, name: str = "candidate_entity_ids") -> DataFrame:
    """``id_lists`` of ``exact_name``: a list is made once for each name and country, and joined to the records that bear it.

    Only ids whose rows differ in name or country have their lists put together.
    """
    key = ["country", "business_name"]
    known = lambda x: x.where(text.known_country("country") & (F.col("business_name") != ""))
    lists = known(pool).groupBy(*key).agg(F.array_sort(F.collect_set("entity_id")).alias("ids")).withColumn(name, F.array_join("ids", ","))
    keys = s1.select("entity_id").distinct().join(known(s1).groupBy("entity_id").agg(F.collect_set(F.struct(*key)).alias("keys")), "entity_id", "left").withColumn("n", F.coalesce(F.size("keys"), F.lit(0)))
    one = keys.where("n <= 1").select("entity_id", F.get("keys", F.lit(0)).alias("k")).select("entity_id", "k.*").join(lists.drop("ids"), key, "left").select("entity_id", F.coalesce(name, F.lit("")).alias(name))
    each = keys.where("n > 1").select("entity_id", F.explode("keys").alias("k")).select("entity_id", "k.*").join(lists.drop(name), key, "left")
    several = each.groupBy("entity_id").agg(text.joined(F.flatten(F.collect_list("ids"))).alias(name))
    return one.unionByName(several).withColumnRenamed("entity_id", "source1_entity_id")


def candidates(s1: DataFrame, pool: DataFrame, **fit: float) -> DataFrame:
    """Distinct pairs of both passes, made distinct as pairs of names."""
    equal = [x.where(text.known_country("country") & (F.col("business_name") != "")).select("country", F.col("business_name").alias("name_1")).distinct() for x in (s1, pool)]
    equal = equal[0].join(equal[1], ["country", "name_1"], "left_semi").withColumn("name_2", F.col("name_1"))
    out = of_names(equal.unionByName(name_cosines(s1, pool, **fit).select("country", "name_1", "name_2")).distinct(), s1, pool)
    return out.distinct() if several_names(s1, pool) else out


def id_lists(pairs: DataFrame, s1: DataFrame, name: str = "candidate_entity_ids") -> DataFrame:
    """One row per s1 id, also if rows repeat it: its sorted distinct partners as a comma list, empty if none."""
    lists = pairs.groupBy(F.col("s1_id").alias("source1_entity_id")).agg(F.array_join(F.array_sort(F.collect_set("pool_id")), ",").alias(name))
    return s1.select(F.col("entity_id").alias("source1_entity_id")).distinct().join(lists, "source1_entity_id", "left").select("source1_entity_id", F.coalesce(name, F.lit("")).alias(name))
