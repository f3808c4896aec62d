"""Near-duplicate documents by min-max hashing of word shingles."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

PERMUTATIONS = 64
ROWS = 4
SMALL = 30  # shingles of a set up to which its least ones are bucket keys as well
_FACTORS = common.mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def min_max(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, 128) signature: minimum and maximum of each of 64 permutations, so one evaluation gives two values.

    Text i has hashes[first[i]:first[i+1]], not empty. Values 2k and 2k+1 belong to permutation k.
    """
    out = np.empty((len(first) - 1, 2 * PERMUTATIONS), np.uint32)
    starts = first[:-1]
    with np.errstate(over="ignore"):
        for k, a in enumerate(_FACTORS):
            y = ((hashes * a) >> np.uint64(32)).astype(np.uint32)
            out[:, 2 * k] = np.minimum.reduceat(y, starts)
            out[:, 2 * k + 1] = np.maximum.reduceat(y, starts)
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(texts, 128/rows) 64-bit keys; a band holds ``rows`` values, of two permutations for four rows."""
    n, width = signature.shape
    with np.errstate(over="ignore"):
        parts = signature.reshape(n, width // rows, rows).astype(np.uint64)
        key = np.full((n, width // rows), 0x1D8E4E27C47D124F, np.uint64)
        for r in range(rows):
            key = common.mix(key * np.uint64(0x9FB21C651E98DF25) + parts[:, :, r])
        return common.mix(key + np.arange(width // rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def sketch(signature: np.ndarray) -> np.ndarray:
    """(texts, 4) words with two bits of each value: texts of Jaccard similarity s differ in about 128 * (1 - s) of the 256 bits."""
    bits = np.concatenate([signature & 1, signature >> 1 & 1], axis=1).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def least_keys(own: np.ndarray, percent: int) -> list[int]:
    """Bucket keys of a small set (its hashes in ascending order): the least n - ceil(threshold * n) + 1 of them.

    Two sets over the threshold share one of these, so a pair with a set of up to ``percent`` percent of SMALL shingles
    always meets in a bucket, where bands only make it likely.
    """
    n = len(own)
    return common.mix(own[: n - -(-percent * n // 100) + 1] ^ np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64).tolist() if n <= SMALL else []


def signatures(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the whole shingle set, null if empty), bands (bucket keys), b0..b3 (the sketch)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        names = ["doc_id", "n_shingles", "set_key", "bands", "b0", "b1", "b2", "b3"]
        for b in batches:
            for lo, hi in common.slices(b.column("text"), 500_000):
                part = b.slice(lo, hi - lo)
                hashes, first, _ = common.shingle_hashes(pc.cast(part.column("text"), pa.binary()).to_pylist(), width)
                n = len(part)
                some = np.flatnonzero(np.diff(first))
                keys, sizes, least = [None] * n, np.zeros(n, np.int64), [[]] * n
                for i in some.tolist():
                    own = np.unique(hashes[first[i] : first[i + 1]])
                    sizes[i] = len(own)
                    least[i] = least_keys(own, percent)
                    keys[i] = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                all_bands, all_bits = [None] * n, np.zeros((n, 4), np.int64)
                if len(some):
                    signature = min_max(hashes, np.append(first[some], len(hashes)))
                    for i, row in zip(some.tolist(), bands(signature).tolist(), strict=True):
                        all_bands[i] = row + least[i]
                    all_bits[some] = sketch(signature)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(keys, pa.binary()), pa.array(all_bands, pa.list_(pa.int64())), *(pa.array(np.ascontiguousarray(all_bits[:, k])) for k in range(4))], names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>, b0 long, b1 long, b2 long, b3 long")


def verified(pairs: DataFrame, docs: DataFrame, percent: int, width: int = 5) -> DataFrame:
    """The pairs (a, b) of doc_ids whose whole shingle sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for lo, hi in common.slices(batch.column("text_a"), 500_000):
                part = batch.slice(lo, hi - lo)
                n, keep = len(part), []
                left, right = (pc.cast(part.column(c), pa.binary()).to_pylist() for c in ("text_a", "text_b"))
                distinct = list(dict.fromkeys(right))
                at = {t: n + i for i, t in enumerate(distinct)}
                hashes, first, _ = common.shingle_hashes(left + distinct, width)
                sets: dict[int, np.ndarray] = {}
                for i in range(n):
                    j = at[right[i]]
                    if j not in sets:
                        sets[j] = np.unique(hashes[first[j] : first[j + 1]])
                    x, y = np.unique(hashes[first[i] : first[i + 1]]), sets[j]
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both) > 0)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("t"))
    left = texts.select(F.col("id").alias("a"), F.col("t").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("t").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable over links (a, b); nodes without links are absent.

    Every round takes the least label among neighbours and then that label's own label, so chains shorten as well, until
    no label changes; labels only become smaller, so that comes. Each round's table is written to the shared folder.
    """
    edges = common.settle(links.select("a", "b").union(links.select("b", "a")).toDF("u", "v").distinct(), "edges")
    labels = common.settle(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = common.settle(step.join(up, "label", "left").select("node", "was", F.least("label", "up").alias("label")), "labels")
        if labels.where("label != was").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def shingle_sets(docs: DataFrame, nodes: DataFrame, width: int = 5) -> DataFrame:
    """nodes (node, ...) with size and set: the distinct 64-bit shingle hashes of each node's text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for lo, hi in common.slices(batch.column("text"), 500_000):
                part = batch.slice(lo, hi - lo)
                hashes, first, _ = common.shingle_hashes(pc.cast(part.column("text"), pa.binary()).to_pylist(), width)
                sets = [np.unique(hashes[i:j]).view(np.int64) for i, j in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(list(map(len, sets)), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "size", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string"))
    found = texts.join(nodes.select("node"), "node").mapInArrow(run, "node long, size long, set array<long>")
    return nodes.join(found, "node")


def prefix_links(sets: DataFrame, percent: int) -> DataFrame:
    """All links (a, b) between nodes with different labels, from sets (node, label, size, set); exact.

    Prefix filtering: with each set's shingles in ascending order of how many sets hold them, two sets over the
    threshold share one among the first size - ceil(threshold * size) + 1 of each, at places that leave room for the
    overlap they need. What the copies of one original have in common is frequent, so what is joined is mostly what few
    share. In the postings of a shingle only nodes off its most frequent label look for partners, and only among nodes of
    like size: postings are dealt by shingle and size band. Counts are written before they are joined, so a join reads
    its shuffles directly and the engine can split the partition of a frequent shingle.
    """
    named = sets.select("node", "label", "size", F.xxhash64("set").alias("own"), "set")  # hashed once, not per shingle
    shingles = named.select("node", "label", "size", "own", F.explode("set").alias("shingle"))
    held = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("held"), F.min("label").alias("x"), F.max("label").alias("y")).where("held > 1")
    held = common.settle(held.select("shingle", "held", (F.col("x") != F.col("y")).alias("several")), "held")
    ranked = shingles.join(held, "shingle", "left").withColumn("place", F.row_number().over(Window.partitionBy("node", "own").orderBy(F.coalesce("held", F.lit(1)), "shingle")))
    need = lambda n: F.ceil(F.lit(percent) * n / 100)
    band = F.floor(F.log(F.col("size")) / math.log(100.01 / percent))  # sizes over the threshold are at most one band apart
    prefix = ranked.where((F.col("place") <= F.col("size") - need(F.col("size")) + 1) & F.col("several")).select("shingle", "node", "label", "size", "place", band.alias("band"))
    prefix = common.settle(prefix, "prefixes")
    main = prefix.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("shingle").agg(F.max(F.struct("n", "label")).alias("m"))
    main = common.settle(main.select("shingle", F.col("m.label").alias("main")), "main-labels")
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band")
    one = prefix.join(main, "shingle").where("label != main").select("shingle", near, F.col("node").alias("node_a"), F.col("label").alias("label_a"), F.col("size").alias("size_a"), F.col("place").alias("place_a"))
    one = common.settle(one, "seekers")
    two = prefix.select("shingle", "band", F.col("node").alias("node_b"), F.col("label").alias("label_b"), F.col("size").alias("size_b"), F.col("place").alias("place_b"))
    overlap = F.ceil(F.lit(percent) * (F.col("size_a") + F.col("size_b")) / (100 + percent))
    room = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) + 1
    sizes = (100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))
    pairs = one.join(two, ["shingle", "band"]).where(F.col("label_a") != F.col("label_b")).where(sizes).where(room >= overlap)
    pairs = common.settle(pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct(), "prefix-pairs")
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)).select("a", "b").distinct()


def repeated(rows: DataFrame) -> DataFrame:
    """The doc_ids of several rows."""
    return rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")


def link_components(docs: DataFrame, percent: int = 75, most_bits: int = 66, width: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and set_key.

    Documents are linked if 100 * intersection >= percent * union of their sets of ``width``-word shingles; component_id
    is the smallest doc_id reachable, and kept marks that document. Null or wordless texts have no shingles and are
    linked with nothing. Rows with the same doc_id are one node, also if their texts differ: they share a component. A
    null doc_id has a null component_id and is kept. Sets hold 64-bit hashes of shingles. A very long text is worked on
    alone. An empty table gives no rows; other columns are ignored, whatever their names.

    Equal sets form a class, named by its smallest doc_id, before anything is compared. The classes of a band bucket are
    compared with the bucket's smallest first, unless their sketches differ in more than ``most_bits`` of 256 bits (5
    standard deviations at 75 percent); those links join most groups of copies into one component. Classes that share a
    bucket with another component are then compared across components by prefix filtering, which misses no link. Sets of
    up to SMALL shingles are also in the buckets of their least ones, so bands decide for larger pairs only.
    """
    rows = common.settle(signatures(docs, width, percent), "signatures")
    some = rows.where("n_shingles > 0 and doc_id is not null")
    classes = common.settle(some.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), *(F.first(f"b{k}").alias(f"b{k}") for k in range(4))), "classes")
    repeats = common.settle(repeated(rows), "repeated-ids")
    repeating = not repeats.isEmpty()
    if repeating:  # one row of each text of a doc_id is enough to compare
        texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        docs = texts.join(repeats, "doc_id", "left_anti").unionByName(texts.join(repeats, "doc_id", "left_semi").distinct())
    entries = classes.select("node", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot != last")
    members = common.settle(entries.join(buckets.select("key", "pivot"), "key"), "members")

    def named(side: str) -> DataFrame:
        return classes.select(F.col("node").alias(side), *(F.col(f"b{k}").alias(f"{side}{k}") for k in range(4)))

    apart = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(1, 4)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
    tried = members.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    tried = common.settle(tried.join(named("a"), "a").join(named("b"), "b").where(apart <= most_bits).select("a", "b"), "tried")
    links = verified(tried, docs, percent, width)
    if repeating:
        own = some.join(repeats, "doc_id", "left_semi").select("doc_id", "set_key").distinct().join(classes.select("set_key", "node"), "set_key")
        links = links.union(own.where("doc_id != node").select("doc_id", "node"))
    links = common.settle(links, "links")
    labels = components(links)
    placed = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed = placed.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("key")
    open_ = common.settle(placed.join(mixed, "key").select("node", "label").distinct(), "open")
    if not open_.isEmpty():
        more = common.settle(prefix_links(common.settle(shingle_sets(docs, open_, width), "open-sets"), percent), "more-links")
        labels = components(links.union(more))
    named_classes = classes.select("set_key", "node").join(labels, "node", "left").select("set_key", F.coalesce("label", "node").alias("component_id"))
    linked = some.select("doc_id", "n_shingles", "set_key").join(named_classes, "set_key")
    alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", "set_key", F.col("doc_id").alias("component_id"))
    if repeating:
        whole = linked.join(repeats, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("whole"))
        alone = alone.join(whole, "doc_id", "left").select("doc_id", "n_shingles", "set_key", F.coalesce("whole", "component_id").alias("component_id"))
    return linked.select("doc_id", "n_shingles", "set_key", "component_id").unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs with one row of each group of linked texts: that with the smallest doc_id.

    Here rows are what is linked, so no text is lost with another one that shares its doc_id: of rows that repeat a
    doc_id, those with equal texts are one, others are judged by their own texts (ties by the texts' hash). Rows without
    a doc_id stay. All columns stay as they are, whatever their names. An empty table stays empty.
    """
    repeats = common.settle(repeated(docs.select(F.col("doc_id").cast("long"))), "repeated-ids")
    if repeats.isEmpty():
        gone = link_components(docs, percent).where("not kept").select("doc_id")
        return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti").select(common.columns(docs))
    own, node, tie = common.unused(docs, "own_id", "node_id", "text_tie")
    text = F.col("text").cast("string")
    named = docs.where("doc_id is not null").withColumn(own, F.col("doc_id").cast("long")).withColumn(tie, F.xxhash64(text))
    several = named.join(repeats.toDF(own), own, "left_semi")
    first = common.settle(several.groupBy(own).agg(F.min(tie).alias(node)), "first-texts")
    key = F.when(F.col(node).isNull() | (F.col(node) == F.col(tie)), F.col(own)).otherwise(F.xxhash64(own, tie))
    keys = named.select(own, tie, text.alias("text")).join(first, own, "left").withColumn(node, key)
    linked = link_components(keys.select(F.col(node).alias("doc_id"), "text"), percent).select(F.col("doc_id").alias(node), "component_id").distinct()
    groups = keys.select(own, tie, node).distinct().join(linked, node)
    best = common.settle(groups.groupBy("component_id").agg(F.min(F.struct(own, tie)).alias("b")).select(f"b.{own}", f"b.{tie}"), "kept-rows")
    kept = named.join(best, [own, tie], "left_semi")
    once = kept.join(repeats.toDF(own), own, "left_anti").unionByName(kept.join(repeats.toDF(own), own, "left_semi").dropDuplicates([own, tie]))
    return once.select(common.columns(docs)).unionByName(docs.where("doc_id is null"))
