"""Pair attributes, features and labels."""

from __future__ import annotations

from functools import reduce
from itertools import count, islice
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.similarity import jaro_winkler
from ..sources import io
from . import block, sample

ATTRIBUTES = ["business_name", "business_address", "country"]
TOKENS = "address_tokens"
STEPS = 1024  # that negative draws choose from


def exploded(lists: DataFrame, name: str = "candidate_entity_ids") -> DataFrame:
    """(s1_id, pool_id) of comma lists; empty lists give no row."""
    return lists.select(F.col("source1_entity_id").alias("s1_id"), F.explode(text.id_list(name)).alias("pool_id"))


def attributes(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Pairs with both records' attributes; ids that are not found have empty ones."""
    left = s1.select(F.col("entity_id").alias("s1_id"), *(F.col(c).alias(f"{c}_1") for c in ATTRIBUTES))
    right = pool.select(F.col("entity_id").alias("pool_id"), *(F.col(c).alias(f"{c}_2") for c in ATTRIBUTES))
    out = pairs.join(left, "s1_id", "left").join(right, "pool_id", "left")
    return out.select("s1_id", "pool_id", *(F.coalesce(f"{c}_{k}", F.lit("")).alias(f"{c}_{k}") for k in (1, 2) for c in ATTRIBUTES))


def looked_up(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with the attributes that table has under their id, as found_ columns; empty where it has none."""
    own = table.select("entity_id", *(F.col(c).alias(f"found_{c}") for c in ATTRIBUTES))
    return rows.join(own, "entity_id", "left").withColumns({f"found_{c}": F.coalesce(f"found_{c}", F.lit("")) for c in ATTRIBUTES})


def measures(split: bool = False) -> dict[str, Column]:
    """The four features of attributed pairs, and the Levenshtein distance of the names; ``split``: the addresses' distinct tokens are there."""
    return {
        "exact_country_match": text.same_country("country_1", "country_2"),
        "name_jaro_winkler_score": jaro_winkler("business_name_1", "business_name_2"),
        "name_3gram_jaccard": text.gram_jaccard("business_name_1", "business_name_2"),
        "address_token_jaccard": text.set_jaccard(F.col(f"{TOKENS}_1"), F.col(f"{TOKENS}_2")) if split else text.token_jaccard("business_address_1", "business_address_2"),
        "name_levenshtein": F.levenshtein("business_name_1", "business_name_2"),
    }


def features(attributed: DataFrame) -> DataFrame:
    return attributed.select(F.col("s1_id").alias("source1_entity_id"), F.col("pool_id").alias("candidate_entity_id"), *(c.alias(name) for name, c in measures().items()))


def exact_or_linked(truth: DataFrame, s1: DataFrame, pool: DataFrame, columns: dict[str, Column], addresses: bool = True) -> DataFrame:
    """(s1_id, pool_id) of the exact-name block and of the truth, each pair once, with columns of both records' attributes.

    The same as ``attributes`` of both kinds of pairs, for ids that don't repeat: pairs of classes unfold without a shuffle.
    """
    return block.expanded(exact_or_linked_classes(truth, s1, pool, columns, addresses))


def exact_or_linked_classes(truth: DataFrame, s1: DataFrame, pool: DataFrame, columns: dict[str, Column], addresses: bool = True) -> DataFrame:
    """``exact_or_linked`` as pairs of classes (s1_ids, pool_ids): records of equal name and address are one class, columns are computed for pairs of classes.

    ``addresses``: whether the columns need them; then the distinct tokens of each are there too, as address_tokens_1 and _2.
    """
    carry = ["business_address", TOKENS] if addresses else []
    left, right = (x.withColumn(TOKENS, F.array_distinct(text.tokens("business_address"))) for x in (s1, pool))
    found = block.exact_classes(left, right, (carry, carry)).withColumns({f"{c}_{k}": F.col(c) for c in ("business_name", "country") for k in (1, 2)})
    same = text.known_country("country_1") & (F.col("country_1") == F.col("country_2")) & (F.col("business_name_1") != "") & (F.col("business_name_1") == F.col("business_name_2"))
    both = (found, link_classes(truth, s1, pool).where(~same))
    return reduce(DataFrame.unionByName, (x.select("s1_ids", "pool_ids", *(c.alias(name) for name, c in columns.items())) for x in both))


def linked(truth: DataFrame, s1: DataFrame, pool: DataFrame, columns: dict[str, Column], outside: bool = False) -> DataFrame:
    """(s1_id, pool_id) of the truth whose records both exist, with columns of their attributes; ``outside``: only those that the exact-name block lacks.

    Lists get the s1 record's attributes before they unfold.
    """
    left, right = (x.withColumn(TOKENS, F.array_distinct(text.tokens("business_address"))).select(F.col("entity_id").alias(name), *(F.col(c).alias(f"{c}_{k}") for c in [*ATTRIBUTES, TOKENS])) for k, name, x in ((1, "s1_id", s1), (2, "pool_id", pool)))
    lists = truth.where(F.col("matched_entity_ids") != "").join(left, F.col("source1_entity_id") == F.col("s1_id"))
    pairs = lists.select(*left.columns, F.explode(F.array_distinct(text.id_list("matched_entity_ids"))).alias("pool_id")).join(right, "pool_id")
    same = text.known_country("country_1") & (F.col("country_1") == F.col("country_2")) & (F.col("business_name_1") != "") & (F.col("business_name_1") == F.col("business_name_2"))
    return (pairs.where(~F.coalesce(same, F.lit(False))) if outside else pairs).select("s1_id", "pool_id", *(c.alias(name) for name, c in columns.items()))


def repeated_ids(*tables: DataFrame) -> bool:
    """Whether an id has more than one row in a table."""
    found = [x.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1") for x in tables]
    return any(not x.isEmpty() for x in found)


def labelled_names(s1: DataFrame, pool: DataFrame, truth: DataFrame) -> DataFrame:
    """``labelled`` of ``exact_name``: s1 records of equal name and truth list are one class, labelled against each part of the name's pool ids before pairs unfold."""
    lists = truth.groupBy(F.col("source1_entity_id").alias("entity_id")).agg(text.joined(F.flatten(F.collect_set(text.id_list("matched_entity_ids")))).alias("own"))
    classes = block.exact_classes(s1.join(lists, "entity_id", "left"), pool, (["own"], []))
    hits = F.array(F.array_intersect("pool_ids", text.id_list("own_1")))  # evaluated once, as a lambda's variable
    judged = F.transform(hits, lambda h: F.transform("pool_ids", lambda x: F.struct(x.alias("id"), F.array_contains(h, x).cast("long").alias("is_match"))))[0]
    return block.expanded(classes.select("s1_ids", judged.alias("pool_ids"))).select("s1_id", F.col("pool_id.id").alias("pool_id"), F.col("pool_id.is_match").alias("is_match"))


def exact_features(s1: DataFrame, pool: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """``features`` of ``exact_name``, with is_match if there is a truth, for ids that don't repeat.

    Measures are taken for pairs of classes: s1 records of equal name, address and truth list, and pool records of equal
    name and address. Pairs unfold after the last shuffle.
    """
    carry = ["business_address", TOKENS]
    left, right = (x.withColumn(TOKENS, F.array_distinct(text.tokens("business_address"))) for x in (s1, pool))
    if truth is not None:
        lists = truth.groupBy(F.col("source1_entity_id").alias("entity_id")).agg(text.joined(F.flatten(F.collect_set(text.id_list("matched_entity_ids")))).alias("own"))
        left = left.join(lists.where(F.col("own") != ""), "entity_id", "left")
    found = block.exact_classes(left, right, ([*carry, *["own"] * (truth is not None)], carry)).withColumns({f"{c}_{k}": F.col(c) for c in ("business_name", "country") for k in (1, 2)})
    of = [c.alias(name) for name, c in measures(split=True).items()]
    if truth is None:
        pairs = block.expanded(found.select("s1_ids", "pool_ids", *of))
    else:
        own = F.coalesce(text.id_list("own_1"), F.array().cast("array<string>"))
        hits = F.array(F.when(F.col("own_1").isNull(), own).otherwise(F.array_intersect("pool_ids", own)))  # evaluated once, as a lambda's variable
        judged = F.transform(hits, lambda h: F.transform("pool_ids", lambda x: F.struct(x.alias("id"), F.array_contains(h, x).cast("long").alias("is_match"))))[0]
        pairs = block.expanded(found.select("s1_ids", judged.alias("pool_ids"), *of)).withColumns({"is_match": F.col("pool_id.is_match"), "pool_id": F.col("pool_id.id")})
    return pairs.withColumnsRenamed({"s1_id": "source1_entity_id", "pool_id": "candidate_entity_id"})


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """pairs (s1_id, pool_id) with is_match: 1 if the pair is in the truth's lists."""
    links = exploded(truth, "matched_entity_ids").distinct().withColumn("hit", F.lit(1))
    return pairs.join(links, ["s1_id", "pool_id"], "left").withColumn("is_match", F.coalesce("hit", F.lit(0)).cast("long")).drop("hit")


def positives(truth: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Truth pairs whose records both exist."""
    pairs = exploded(truth, "matched_entity_ids")
    return pairs.join(s1.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi").join(pool.select(F.col("entity_id").alias("pool_id")), "pool_id", "left_semi").select("s1_id", "pool_id")


def link_classes(truth: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """``positives`` as pairs of classes (s1_ids, pool_ids) with both sides' attributes and distinct address tokens, for ids and truth records that don't repeat.

    Each id of one array pairs with each of the other. s1 records of equal list and attributes are one class, a list
    unfolds once for all records that have it, and its records of equal attributes are a class too. So rows grow with the
    records and not with the square of a link's; arrays hold about ``block.CHUNK`` ids.
    """
    own = lambda x, k: x.select("entity_id", *(F.coalesce(c, F.lit("")).alias(f"{c}_{k}") for c in ATTRIBUTES))
    lists = truth.where(F.col("matched_entity_ids") != "").select("source1_entity_id", F.sha2("matched_entity_ids", 256).alias("list"), "matched_entity_ids")
    left = lists.select(F.col("source1_entity_id").alias("entity_id"), "list").join(own(s1, 1), "entity_id")
    members = lists.groupBy("list").agg(F.first("matched_entity_ids").alias("ids")).select("list", F.explode(F.array_distinct(text.id_list("ids"))).alias("entity_id"))
    rows = [left, members.join(own(pool, 2), "entity_id")]
    both = rows[0].select("list", F.lit(1).alias("side")).unionByName(rows[1].select("list", F.lit(2).alias("side")))
    sizes = both.groupBy("list").agg(*(F.count_if(F.col("side") == k).alias(f"n{k}") for k in (1, 2))).where(F.greatest("n1", "n2") > block.CHUNK)
    parts = F.broadcast(sizes.select("list", *(F.greatest(F.ceil(F.col(f"n{k}") / block.CHUNK), F.lit(1)).alias(f"parts{k}") for k in (1, 2))))  # at most a row for each CHUNK records
    sides = []
    for k, x in enumerate(rows, 1):
        part = F.pmod(F.xxhash64("entity_id"), F.coalesce(f"parts{k}", F.lit(1))).alias(f"part{k}")
        others = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(f"parts{3 - k}", F.lit(1)) - 1)).alias(f"part{3 - k}")
        own_columns = [f"{c}_{k}" for c in ATTRIBUTES]
        classes = x.join(parts, "list", "left").groupBy("list", part, f"parts{3 - k}", *own_columns).agg(F.collect_list("entity_id").alias("s1_ids" if k == 1 else "pool_ids"))
        sides.append(classes.select("list", f"part{k}", others, *own_columns, "s1_ids" if k == 1 else "pool_ids").repartition(block.spread(s1), "list", "part1", "part2"))
    both = sides[0].join(sides[1], ["list", "part1", "part2"]).drop("list", "part1", "part2")
    return both.withColumns({f"{TOKENS}_{k}": F.array_distinct(text.tokens(f"business_address_{k}")) for k in (1, 2)})


def pair_classes(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Attributed pairs in the form of ``link_classes``, each a class of its own."""
    rows = attributes(pairs, s1, pool)
    arrays = [F.array(c).alias(f"{c}s") for c in ("s1_id", "pool_id")]
    return rows.select(*arrays, *(c for c in rows.columns if c not in ("s1_id", "pool_id")), *(F.array_distinct(text.tokens(f"business_address_{k}")).alias(f"{TOKENS}_{k}") for k in (1, 2)))


def judged_classes(truth: DataFrame, s1: DataFrame, pool: DataFrame, labels: tuple[int, ...] = (1, 0)) -> DataFrame:
    """The truth's pairs and ``negatives``, with is_match 1 and 0, as classes: see ``link_classes``; n is the number of pairs of each. Other ``labels``: only one kind."""
    kinds = []
    if 1 in labels:
        kinds.append((pair_classes(positives(truth, s1, pool), s1, pool) if repeated_ids(s1, pool) else link_classes(truth, s1, pool), 1))
    if 0 in labels:
        kinds.append((pair_classes(negatives(s1, pool, truth), s1, pool), 0))
    rows = [x.withColumn("is_match", F.lit(k).cast("long")) for x, k in kinds]
    return reduce(DataFrame.unionByName, rows).withColumn("n", F.size("s1_ids").cast("long") * F.size("pool_ids"))


def negatives(s1: DataFrame, pool: DataFrame, truth: DataFrame, each: int = 2, seed: int = 42) -> DataFrame:
    """(s1_id, pool_id): exactly ``each`` pool records per s1 record that aren't in its truth; fewer only if the pool has no more.

    Pool records are numbered in the order of a hash. An s1 record's own hash gives a first number and a step that has no
    factor in common with their count n, so first + j * step mod n goes through all numbers without a repeat. At most as
    many draws are made as are wanted and the truth can spoil, in rounds of growing size for the records that lack some;
    the first that are left stay. A truth list is held once for all records that have it. Ids that repeat count once.
    """
    ranked = io.written(sample.shuffled(pool.select("entity_id").distinct(), "entity_id", seed), "pool-places").withColumnRenamed("entity_id", "pool_id")
    n = max(1, ranked.count())  # an empty pool has no place to meet
    steps = list(islice((k for k in count(1) if gcd(k, n) == 1), STEPS))
    digits = lambda a, size: F.conv(F.substring(sample.order_key(F.col("s1_id"), seed), a, size), 16, 10).cast("long")
    lists = truth.where(F.col("matched_entity_ids") != "").select(F.col("source1_entity_id").alias("s1_id"), F.sha2("matched_entity_ids", 256).alias("list"), "matched_entity_ids")
    held = lists.groupBy("list").agg(F.first("matched_entity_ids").alias("ids")).select("list", F.explode(F.array_distinct(text.id_list("ids"))).alias("pool_id")).withColumn("hit", F.lit(True))
    held = io.written(held, "list-members")  # a list unfolds once for all records that have it
    spoiling = lists.groupBy("s1_id").agg(F.collect_set("list").alias("lists"), F.sum(F.size(text.id_list("matched_entity_ids"))).alias("links"))
    ids = s1.select(F.col("entity_id").alias("s1_id")).distinct().join(spoiling, "s1_id", "left")
    draws = F.least(F.lit(n).cast("long"), each + F.coalesce("links", F.lit(0)))
    want = ids.select("s1_id", "lists", draws.alias("draws"), F.lit(each).alias("missing"), digits(1, 15).alias("first"), F.get(F.array(*map(F.lit, steps)), (digits(16, 8) % len(steps)).cast("int")).alias("step"))
    out, done, width = None, 0, 2 * each
    while True:  # most records need few draws; each round makes more for those that still lack some
        drawn = want.where(F.col("draws") > done).withColumn("draw", F.explode(F.sequence(F.lit(done).cast("long"), F.least(F.col("draws"), F.lit(done + width)) - 1)))
        picked = drawn.withColumn("place", F.pmod(F.col("first") + F.col("draw") * F.col("step"), F.lit(n))).join(ranked.select("place", "pool_id"), "place")
        checked = picked.select("s1_id", "pool_id", "missing", "draw", F.explode_outer("lists").alias("list")).join(held, ["list", "pool_id"], "left")
        left = checked.groupBy("s1_id", "draw").agg(F.first("pool_id").alias("pool_id"), F.first("missing").alias("missing"), F.max("hit").alias("hit")).where("hit is null")
        left = left.withColumn("rank", F.row_number().over(Window.partitionBy("s1_id").orderBy("draw"))).where("rank <= missing").select("s1_id", "pool_id")
        left = io.written(left, "negatives")
        out, done, width = left if out is None else out.unionByName(left), done + width, 2 * width
        found = left.groupBy("s1_id").agg(F.count(F.lit(1)).cast("int").alias("found"))
        want = want.where(F.col("draws") > done).join(found, "s1_id", "left").withColumn("missing", F.col("missing") - F.coalesce("found", F.lit(0))).where("missing > 0").drop("found")
        want = io.written(want, "to-draw")
        if want.isEmpty():
            return out
