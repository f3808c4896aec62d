"""Benchmark items inside documents: size-partitioned containment MinHash with confirmation on whole shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCHEMA = "doc_id long, item_id long, n_shared long, n_item long"


def sketch_size(n: int, percent: int) -> int:
    """How many least hashes an item of ``n`` shingles keeps: one more than a text may lack that still holds the item."""
    return n - math.ceil(percent * n / 100) + 1


@dataclass
class ItemIndex:
    """A block of benchmark items: sorted sketch values with the item of each, and all hashes of each item.

    The sketch of an item is its bottom-k MinHash. Items are partitioned by size: k follows from the number of shingles,
    so that a text with at least ``percent`` of them holds one of the k or more, whatever its own length.
    """

    ids: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    values: np.ndarray
    owners: np.ndarray

    @classmethod
    def build(cls, items: list[tuple[int | None, bytes]], percent: int = 75, width: int = 5) -> ItemIndex:
        hashes, first, words = common.shingle_hashes([t for _, t in items], width)
        sets = [np.unique(hashes[first[i] : first[i + 1]]) for i in range(len(items)) if words[i] >= width]
        sketches = [s[: sketch_size(len(s), percent)] for s in sets]  # hashes are uniform, so the least are a random sample
        values, owners = np.concatenate([np.empty(0, np.uint64), *sketches]), np.repeat(np.arange(len(sets), dtype=np.int32), list(map(len, sketches)))
        order = np.argsort(values, kind="stable")
        ids = np.array([items[i][0] for i in range(len(items)) if words[i] >= width], object)
        return cls(ids, np.concatenate([np.empty(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum(list(map(len, sets)))]).astype(np.int64), values[order], owners[order])

    def candidates(self, own: np.ndarray, holder: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) pairs, each once, where ``own``, sorted distinct hashes within each ``holder``, meet a sketch."""
        if not len(self.values) or not len(own):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        left = np.searchsorted(self.values, own)
        hit = np.flatnonzero(self.values[np.minimum(left, len(self.values) - 1)] == own)
        left = left[hit]
        n = np.searchsorted(self.values, own[hit], "right") - left
        at = np.repeat(left - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pairs = np.unique(np.repeat(holder[hit], n) * len(self.ids) + self.owners[at])
        return pairs // max(len(self.ids), 1), pairs % max(len(self.ids), 1)

    def search(self, texts: list[bytes | None], percent: int, width: int) -> Iterator[tuple[int, object, int, int]]:
        """(text, item_id, shared, size) of the items that the texts hold."""
        own, first = _sets(texts, width)
        holder = np.repeat(np.arange(len(texts)), np.diff(first))
        for text, item in zip(*(x.tolist() for x in self.candidates(own, holder)), strict=True):
            item_set = self.hashes[self.first[item] : self.first[item + 1]]
            shared = len(np.intersect1d(item_set, own[first[text] : first[text + 1]], assume_unique=True))
            if 100 * shared >= percent * len(item_set):
                yield text, self.ids[item], shared, len(item_set)


def _sets(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, and where each text's begin; none for fewer than ``width`` words."""
    hashes, first, words = common.shingle_hashes(texts, width)
    sets = [np.unique(hashes[first[i] : first[i + 1]]) if words[i] >= width else np.empty(0, np.uint64) for i in range(len(texts))]
    return np.concatenate([np.empty(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum(list(map(len, sets)))]).astype(np.int64)


def _binary(column) -> list[bytes | None]:
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.cast(column, pa.binary()).to_pylist()


def _batch(rows: list, names: list[str]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)


def find(docs: DataFrame, items: DataFrame, percent: int = 75, width: int = 5, broadcast_chars: int = 16_000_000) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): items of which a document holds at least ``percent`` of the distinct shingles.

    items has item_id and text. Candidates come from the items' bottom-k MinHash sketches looked up among all shingles of
    a document; k grows with the item's size so that no holder is missed, also where the item's parts are scattered.
    Each is confirmed on the whole shingle sets, as 64-bit hashes. Documents are read once: items of up to
    ``broadcast_chars`` characters in all, which is counted first, are broadcast; more stay in tables, see ``find_joined``.
    Items of fewer than ``width`` words, null or empty items and null or empty documents match nothing. Rows with equal
    ids are reported each, in either table; a null id stays null. A very long text is worked on alone. Other columns are
    ignored, whatever their names; empty tables give no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    queries = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    size = queries.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    if size > broadcast_chars:
        return find_joined(texts, queries, percent, width)
    index = spark.sparkContext.broadcast(ItemIndex.build([(r.item_id, r.text.encode()) for r in queries.collect()], percent, width))  # at most broadcast_chars

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            for lo, hi in common.slices(b.column("text")):
                part = b.slice(lo, hi - lo)
                rows = [(part.column("doc_id")[text].as_py(), *found) for text, *found in index.value.search(_binary(part.column("text")), percent, width)]
                if rows:
                    yield _batch(rows, ["doc_id", "item_id", "n_shared", "n_item"])

    return texts.mapInArrow(run, SCHEMA)


FILTER_BITS = 1 << 27  # of the filter that documents' shingles pass first: 16 MB on the driver and in each worker


def find_joined(texts: DataFrame, queries: DataFrame, percent: int, width: int) -> DataFrame:
    """The same for any number of items, by joins; texts (doc_id, text) and queries (item_id, text) without null texts.

    One pass over the documents emits their shingles that a bit filter of all sketch values lets through. They meet the
    sketches by value; a candidate is confirmed by the task that gets both texts. Rows are named by their content's hash
    next to their id, so those that repeat are compared once and reported each.
    """
    spark = texts.sparkSession
    texts, queries = (x.withColumn("key", F.sha2("text", 256)) for x in (texts, queries))

    def values(of: str, column: str, bits=None):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                for lo, hi in common.slices(b.column("text")):
                    part = b.slice(lo, hi - lo)
                    own, first = _sets(_binary(part.column("text")), width)
                    row = np.repeat(np.arange(len(part)), np.diff(first))
                    if bits is None:
                        place = np.arange(len(own)) - first[row]
                        sizes = np.array([sketch_size(n, percent) for n in np.diff(first).tolist()], np.int64)
                        keep = place < sizes[row]
                    else:
                        slot = own & np.uint64(FILTER_BITS - 1)
                        keep = bits.value[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 == 1
                    yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(row[keep])), pa.array(own[keep].view(np.int64))], [column, "value"])

        source = queries if of == "items" else texts
        return source.select("key", "text").mapInArrow(run, f"{column} string, value long").distinct()

    sketches = common.settle(values("items", "item"), "item-sketches")
    slot = F.col("value").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = sketches.select(F.shiftright(slot, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    filled = np.zeros(FILTER_BITS // 64, np.int64)
    for batch in words.select("word", "bits").toArrow().to_batches():  # at most FILTER_BITS / 64 rows
        filled[batch.column("word").to_numpy()] = batch.column("bits").to_numpy()
    met = values("documents", "doc", spark.sparkContext.broadcast(filled.view(np.uint8)))
    pairs = common.settle(met.join(sketches, "value").select("doc", "item").distinct(), "item-candidates")

    def confirm(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for lo, hi in common.slices(b.column("doc_text"), 500_000):
                part = b.slice(lo, hi - lo)
                left, right = (_sets(_binary(part.column(c)), width) for c in ("doc_text", "item_text"))
                shared, sizes = [], np.diff(right[1]).tolist()
                for i in range(len(part)):
                    shared.append(len(np.intersect1d(*(x[f[i] : f[i + 1]] for x, f in (left, right)), assume_unique=True)))
                keep = pa.array([100 * s >= percent * n > 0 for s, n in zip(shared, sizes, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("item"), pa.array(shared, pa.int64()), pa.array(sizes, pa.int64())], ["doc", "item", "n_shared", "n_item"]).filter(keep)

    one = lambda x, name: x.select(F.col("key").alias(name), F.col("text").alias(f"{name}_text"))
    doc_texts = one(texts, "doc").join(pairs.select("doc").distinct(), "doc", "left_semi").distinct()
    found = pairs.join(doc_texts, "doc").join(one(queries, "item").distinct(), "item").select("doc", "item", "doc_text", "item_text").mapInArrow(confirm, "doc string, item string, n_shared long, n_item long")
    found = common.settle(found, "found-items")
    named = found.join(texts.select("doc_id", F.col("key").alias("doc")), "doc").join(queries.select("item_id", F.col("key").alias("item")), "item")
    return named.select("doc_id", "item_id", "n_shared", "n_item")


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = 75) -> DataFrame:
    """docs without the documents that hold an item; rows without a doc_id stay. All columns stay as they are."""
    found = common.settle(find(docs, items, percent).select("doc_id").distinct(), "contaminated")
    return docs.join(found, docs["doc_id"].cast("long") == found["doc_id"], "left_anti").select(common.columns(docs))
