"""Ranked lexical search: windowed bucket scoring over an inverted index of document segments."""

from __future__ import annotations

import heapq
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

WINDOW = 2048  # documents of a window: its scores take 16 KB
SEGMENT_DOCS = 1 << 16  # of a segment at most, so that two bytes number them
SEGMENT_POSTINGS = 1 << 20
ITEM_CHARS = 16_000_000  # of the items that are searched at once
PIECE = 1 << 20  # bytes of a text that are counted at once
# Bytes of words, A-Z lower-cased; all other ASCII bytes part words, and what lies beyond ASCII belongs to them.
_FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()

INDEX = "doc_ids array<bigint>, sizes array<bigint>, terms array<int>, counts array<bigint>, slots binary, tfs binary, n_docs bigint, n_terms bigint"


def term_counts(text: bytes) -> Counter:
    """Terms of a UTF-8 text with their numbers of occurrences. A long text is taken in pieces, cut between terms."""
    low = text.translate(_FOLD)
    if len(low) <= PIECE:
        return Counter(low.split())
    found, at = Counter(), 0
    while at < len(low):
        cut = low.find(b" ", at + PIECE)
        end = cut if cut >= 0 else len(low)
        found.update(low[at:end].split())
        at = end
    return found


class SegmentWriter:
    """Gathers documents' postings for the terms of ``numbers``; a full segment becomes a row of INDEX.

    A segment numbers its documents by slots in ascending doc_id order, nulls last, and holds each term's slots in order
    with the term's frequencies there. Documents without any of the terms only count in n_docs and n_terms.
    """

    def __init__(self, numbers: dict[bytes, int]):
        self.numbers = numbers
        self.clear()

    def clear(self) -> None:
        self.ids: list[int | None] = []
        self.sizes = array("q")
        self.owners, self.terms, self.tfs = array("i"), array("i"), array("q")
        self.n_docs = self.n_terms = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        counts = term_counts(text)
        if not counts:
            return
        size = counts.total()
        self.n_docs += 1
        self.n_terms += size
        hits = counts.keys() & self.numbers.keys()
        if hits:
            self.owners.extend([len(self.ids)] * len(hits))
            self.terms.extend([self.numbers[t] for t in hits])
            self.tfs.extend([counts[t] for t in hits])
            self.ids.append(doc_id)
            self.sizes.append(size)

    @property
    def full(self) -> bool:
        return len(self.ids) >= SEGMENT_DOCS or len(self.terms) >= SEGMENT_POSTINGS

    def row(self) -> dict:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        slot_of = np.empty(len(order), np.int64)
        slot_of[order] = np.arange(len(order))
        terms, slots, tfs = np.array(self.terms, np.int64), slot_of[np.array(self.owners, np.int64)], np.array(self.tfs, np.int64)
        place = np.argsort(terms * SEGMENT_DOCS + slots)
        own, counts = np.unique(terms, return_counts=True)
        small = np.uint16 if not len(tfs) or tfs.max() < 1 << 16 else np.int64
        out = {
            "doc_ids": [self.ids[i] for i in order], "sizes": np.array(self.sizes, np.int64)[order], "terms": own, "counts": counts,
            "slots": slots[place].astype("<u2").tobytes(), "tfs": tfs[place].astype(small).tobytes(), "n_docs": self.n_docs, "n_terms": self.n_terms,
        }
        self.clear()
        return out


def index(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """Segments of the documents that each task reads (INDEX), for the given terms; written to the shared folder."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(numbers)  # the terms of at most ITEM_CHARS characters

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        schema = pa.schema([("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("slots", pa.binary()), ("tfs", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64())])
        writer = SegmentWriter(known.value)
        done = lambda: pa.RecordBatch.from_pylist([writer.row()], schema)
        for b in batches:
            for lo, hi in common.slices(b.column("text")):
                part = b.slice(lo, hi - lo)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), pc.cast(part.column("text"), pa.binary()).to_pylist(), strict=True):
                    writer.add(doc_id, text)
                    if writer.full:
                        yield done()
        yield done()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return common.settle(texts.mapInArrow(run, INDEX), "postings")


class WindowedScorer:
    """Scores segments for many queries; keeps the best ``k`` documents of each, equal scores by ascending doc_id.

    queries: (term number, repeats) pairs of each. weights: of each term. mean: (N, L) of the whole collection.
    """

    def __init__(self, queries: list[list[tuple[int, int]]], weights: np.ndarray, mean: tuple[int, int], k: int):
        self.queries = [[(t, r) for t, r in q if weights[t] > 0] for q in queries]  # others add nothing
        self.weights, self.mean, self.k = weights, mean, k
        self.best: list[list[tuple[int, int, int]]] = [[] for _ in queries]  # min-heaps of (score, -null, -doc_id)

    def impacts(self, terms: np.ndarray, sizes: np.ndarray, slots: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        n, total = self.mean
        m = 100 - 75 + 75 * sizes * n // total
        return self.weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[slots]))

    def add(self, row: dict) -> None:
        """One segment: windows of slots one after another, in each all queries, of each its terms' postings there."""
        ids, sizes = row["doc_ids"], np.array(row["sizes"], np.int64)
        if not ids:
            return
        own, counts = np.array(row["terms"], np.int64), np.array(row["counts"], np.int64)
        terms, slots = np.repeat(np.arange(len(own)), counts), np.frombuffer(row["slots"], "<u2").astype(np.int64)
        tfs = np.frombuffer(row["tfs"], np.uint16 if len(row["tfs"]) == 2 * len(slots) else np.int64).astype(np.int64)
        values = self.impacts(own[terms], sizes, slots, tfs)
        place = {t: i for i, t in enumerate(own.tolist())}
        queries = [(q, [(place[t], r) for t, r in pairs if t in place]) for q, pairs in enumerate(self.queries)]
        # cursors[t][w]: the first posting of term t in window w or later
        n_windows = -(-len(ids) // WINDOW)
        cursors = np.searchsorted(terms * n_windows + slots // WINDOW, np.arange(len(own) * n_windows + 1))
        # words of an occupancy bitset, one entry for each term and 64 slots: distinct bits add up
        word = terms * (n_windows * WINDOW >> 6) + (slots >> 6)
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        bits = np.bitwise_or.reduceat(np.uint64(1) << (slots & 63).astype(np.uint64), heads)
        words, firsts = (word[heads] & (WINDOW // 64 - 1)), np.searchsorted(heads, cursors)
        local = slots & (WINDOW - 1)
        cursors, firsts = cursors.tolist(), firsts.tolist()
        scores, occupied = np.zeros(WINDOW, np.int64), np.zeros(WINDOW // 64, np.uint64)
        for w in range(n_windows):
            for q, pairs in queries:
                for t, repeats in pairs:
                    at = t * n_windows + w
                    a, b = cursors[at], cursors[at + 1]
                    if a < b:
                        scores[local[a:b]] += values[a:b] if repeats == 1 else values[a:b] * repeats
                        a, b = firsts[at], firsts[at + 1]
                        occupied[words[a:b]] |= bits[a:b]
                touched = np.flatnonzero(np.unpackbits(occupied.view(np.uint8), bitorder="little"))
                if len(touched):
                    self.harvest(q, scores[touched], touched, w * WINDOW, ids)
                    scores[touched] = 0
                    occupied[:] = 0

    def harvest(self, q: int, scores: np.ndarray, slots: np.ndarray, base: int, ids: list) -> None:
        heap = self.best[q]
        keep = np.flatnonzero(scores >= max(1, heap[0][0] if len(heap) == self.k else 1))
        if len(keep) > self.k:
            keep = keep[np.lexsort((keep, -scores[keep]))[: self.k]]
        for i in keep.tolist():
            doc = ids[base + int(slots[i])]
            entry = (int(scores[i]), 0 if doc is not None else -1, -(doc or 0))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)

    def rows(self) -> Iterable[tuple[int, int | None, int]]:
        return [(q, None if null else -doc, score) for q, heap in enumerate(self.best) for score, null, doc in heap]


def weight(n: int, df: int) -> int:
    return int(np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))))


def search_block(docs: DataFrame, items: list, id_type: str, k: int) -> DataFrame:
    """search for items (rows of item_id and text) whose texts fit in ITEM_CHARS characters or are a single one."""
    spark = docs.sparkSession
    numbers: dict[bytes, int] = {}
    queries = [[(numbers.setdefault(t, len(numbers)), r) for t, r in term_counts(i.text.encode()).items()] for i in items]
    segments = index(docs, numbers)
    total = segments.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    sums = segments.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df"))
    weights = np.zeros(len(numbers), np.int64)
    for r in sums.toLocalIterator():  # at most as many as the items have terms
        weights[r.terms] = weight(total.n, r.df)
    sent = spark.sparkContext.broadcast((queries, weights, (total.n or 0, total.l or 0), k))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = WindowedScorer(*sent.value)
        for b in batches:
            for i in range(len(b)):
                scorer.add(b.slice(i, 1).to_pylist()[0])
            common.release()
        q, d, s = zip(*scorer.rows(), strict=True) if any(scorer.best) else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(d, pa.int64()), pa.array(s, pa.int64())], ["query", "doc_id", "score"])

    found = segments.select("doc_ids", "sizes", "terms", "counts", "slots", "tfs").where(F.size("doc_ids") > 0).mapInArrow(run, "query int, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(items)], f"query int, item_id {id_type}")
    return ranked.join(names, "query").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_chars: int = ITEM_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of docs (doc_id, text) for each of items (item_id, text).

    Terms are maximal runs of letters and digits and of characters beyond ASCII, A-Z lower-cased. With N documents that
    have terms and L terms in them, a term in df documents weighs floor(1000 ln((2N+2)/(2df+1))); tf occurrences in a
    document of n terms add weight * (10^9 tf div (1000 tf + 8 m)), m = 25 + 75 n N div L, for each time that the item
    holds the term. Only scores above 0 count; equal scores rank by ascending doc_id, null last.

    Each task indexes the documents it reads, for the items' terms only, into segments of a bounded number of postings;
    texts are never shuffled. N, L and df are summed over the segments. Then each segment is traversed window by window:
    a query's postings in the window are scatter-added into an array of WINDOW scores, a bitset tells which are touched,
    and those go into a heap of k that lasts for all segments of a task. The tasks' heaps meet in a ranking per item.
    Items are searched in blocks of ``item_chars`` characters, one pass over the documents for each block.

    Null or empty texts on either side give no row, and neither do empty tables. Every row of docs is a document of its
    own, also if rows repeat its id, and a null doc_id stays null. Rows that repeat an item's id and text are one item;
    different texts under one item_id are ranked each. A very long text is counted in pieces. Other columns are ignored.
    """
    id_type = items.schema["item_id"].dataType.simpleString()
    asked = items.select("item_id", F.col("text").cast("string").alias("text")).where("text <> ''").distinct()
    chars = asked.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    blocks = max(1, -(-chars // item_chars))
    out = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()  # about item_chars characters
        found = search_block(docs, own, id_type, k)
        out = found if out is None else out.unionByName(found)
    return out
