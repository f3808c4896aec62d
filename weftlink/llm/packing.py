"""Packing of token sequences into fixed windows by best-fit decreasing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class OpenWindows:
    """Segment tree over remaining capacities 0..window: a node counts the open windows below it.

    ``take(need)`` finds the tightest open window with room for ``need`` in O(log window).
    """

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, room: int, name: int) -> None:
        self.at[room].append(name)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) of the smallest room >= need, removed from the tree; None if no window has it."""
        i, count = need + self.size, self.count
        while not count[i]:
            while i & 1:
                i >>= 1
            if i == 0:
                return None
            i += 1
            if i & (i - 1) == 0:  # stepped past the last node of a level
                return None
        while i < self.size:
            i *= 2
            if not count[i]:
                i += 1
        room = i - self.size
        name = self.at[room].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return room, name


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[list[list[int]], list[int]]:
    """Windows as lists of piece indexes, and the room left in each. Every length is in 1..window."""
    tree, windows, room = OpenWindows(window), [], []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n)
        if found is None:
            windows.append([i])
            room.append(left := window - n)
            w = len(windows) - 1
        else:
            left, w = found[0] - n, found[1]
            windows[w].append(i)
            room[w] = left
        if left:
            tree.put(left, w)
    return windows, room


def _packed(pieces: list, window: int, block: int, last: bool) -> tuple[list[list], list]:
    """Windows to write now, and pieces of loosely filled windows to try again with the next block (at most a quarter block)."""
    windows, room = best_fit_decreasing(np.array([p[2] for p in pieces], np.int64), window)
    order = sorted(range(len(windows)), key=room.__getitem__, reverse=True)
    again, held, done = [], 0, []
    for w in order:
        if not last and room[w] > window // 128 and held + window - room[w] <= block // 4:
            held += window - room[w]
            again += [pieces[i] for i in windows[w]]
        else:
            done.append([pieces[i] for i in windows[w]])
    return done, again


def pack(docs: DataFrame, tokenizer: str, kind: str = "word", window: int = 4096, end_id: int = 2, block: int = 8_000_000) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most ``window`` ids.

    Columns: doc_id, start and length (ids of the document), doc_tokens (with the end id), sequence_id, offset in the
    sequence, ids (little-endian unsigned 32-bit). Overlong documents are first cut into full windows, which are
    sequences of their own; the rests and the short documents go to the tightest window with room. Each task packs what
    it scans in blocks of about ``block`` ids, and windows that are not nearly full try again with the next block, so
    nothing is shuffled and memory is bounded by the block plus the longest document.
    Null or empty text: just the end id. Rows with the same doc_id are documents of their own. Null doc_id stays null.
    Of pieces of one length the one scanned first is placed first, of windows with one room the last one opened. A very
    long text is encoded alone. Other columns are ignored, whatever their names. An empty table gives no rows. Sequence ids are unique, not dense.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        enc = common.encoder(tokenizer, kind)
        end = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 32
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        types = [pa.int64()] * 6 + [pa.binary()]

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        def place(windows: list[list]) -> Iterator:
            nonlocal sequence
            rows, n = [], 0
            for w in windows:
                offset = 0
                for doc, start, length, total, ids in w:
                    rows.append((doc, start, length, total, sequence, offset, ids))
                    offset += length
                sequence += 1
                n += offset
                if n >= 1_000_000:
                    yield batch(rows)
                    rows, n = [], 0
            if rows:
                yield batch(rows)

        pool: list = []
        held = 0
        for b in batches:
            for lo, hi in common.slices(b.column("text")):
                part = b.slice(lo, hi - lo)
                full: list[list] = []
                encoded = enc.encode([t or "" for t in part.column("text").to_pylist()])
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoded, strict=True):
                    ids += end
                    total = len(ids) // 4
                    whole = total // window * window
                    for start in range(0, whole, window):
                        full.append([(doc, start, window, total, ids[4 * start : 4 * (start + window)])])
                    if total > whole:
                        pool.append((doc, whole, total - whole, total, ids[4 * whole :]))
                        held += total - whole
                yield from place(full)
                if held >= block:
                    done, pool = _packed(pool, window, block, False)
                    held = sum(p[2] for p in pool)
                    yield from place(done)
        if pool:
            yield from place(_packed(pool, window, block, True)[0])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
