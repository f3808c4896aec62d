"""Runs (maximal periodic stretches) of words, by suffix arrays and longest previous factors."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress, count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LEAST = 12
SCHEMA = "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, text string"
Run = tuple[int, int, int]  # first and last word, period


class Factors:
    """Names of all stretches of 2^k words in a batch of texts, and the suffix array that they give.

    ``levels[k][i]`` is equal for positions of one text whose first 2^k words are equal, and for no others; positions
    whose words end before that have a name of their own. Doubling stops when all names differ; each step sorts only the
    suffixes that still share a name. ``order`` is the suffix array, text after text, and ``split[x]`` the level at which
    the suffixes at x-1 and x were told apart.
    """

    def __init__(self, words: np.ndarray, first: np.ndarray):
        n, n_texts = len(words), len(first) - 1
        v = int(words.max()) + 1
        text = np.repeat(np.arange(n_texts), np.diff(first))
        ends = first[1:][text]
        level = text * v + words
        self.levels = [np.append(level, -1)]
        after = np.append(words[1:] + 1, 0)
        after[first[1:][np.diff(first) > 0] - 1] = 0
        key = level * (v + 1) + after
        order = np.argsort(key)
        new = np.diff(key[order], prepend=-1) != 0
        self.split = new.astype(np.int8)
        at = np.arange(n)
        level = np.empty(n, np.int64)
        level[order] = np.maximum.accumulate(np.where(new, at, 0))
        self.levels.append(np.append(level, -1))
        width = 2
        while True:
            open_ = np.flatnonzero(~new | ~np.append(new[1:], True))
            if not len(open_):
                break
            own = order[open_]
            follow = own + width
            key = level[own] * (n + 1) + np.where(follow < ends[own], level[np.minimum(follow, n - 1)] + 1, 0)
            again = np.argsort(key)
            own, key = own[again], key[again]
            order[open_] = own
            fresh = np.diff(key, prepend=-1) != 0
            self.split[open_[fresh & ~new[open_]]] = len(self.levels)
            new[open_] = fresh
            level = level.copy()
            level[own] = np.maximum.accumulate(np.where(fresh, open_, 0))
            self.levels.append(np.append(level, -1))
            width *= 2
        self.order = order

    def common_words(self, x: np.ndarray) -> np.ndarray:
        """Words that the suffixes at x-1 and x of the suffix array share: the LCP array at these places."""
        level = self.split[x].astype(np.int64)
        out = np.where(level >= 2, 1 << np.maximum(level - 1, 0), 0)
        i, j = self.order[x - 1], self.order[x]
        for k in range(int(level.max(initial=1)) - 2, -1, -1):
            may = np.flatnonzero(level - 2 >= k)
            same = self.levels[k][i[may] + out[may]] == self.levels[k][j[may] + out[may]]
            out[may] += same << k
        single = np.flatnonzero(level == 1)
        out[single] = self.levels[0][i[single]] == self.levels[0][j[single]]
        return out

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from i and from j on, i < j."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            out += (self.levels[k][i + out] == self.levels[k][j + out]) << k
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words that end at i and at j, these included, i < j."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - out - (1 << k) + 1, j - out - (1 << k) + 1
            out += ((a >= 0) & (self.levels[k][np.maximum(a, 0)] == self.levels[k][np.maximum(b, 0)])) << k
        return out


def blocks(order: list[int], lcp: list[int], base: int) -> tuple[list[int], list[int]]:
    """Starts and sources of a text's LZ blocks, from its part of the suffix array and of the LCP array.

    Positions leave the list of suffixes from the last to the first, so the neighbours of one that leaves lie before it
    in the text: the nearer of them is its longest previous factor. Then each block takes the factor at its start, or
    one new word. Positions are relative to ``base``.
    """
    n = len(order)
    rank = [0] * n
    for x, i in enumerate(order):
        rank[i - base] = x
    lcp = [*lcp, 0]
    before, after = list(range(-1, n)), list(range(1, n + 2))
    longest, source = [0] * n, [-1] * n
    for i in range(n - 1, -1, -1):
        x = rank[i]
        p, q, up, down = before[x], after[x], lcp[x], lcp[after[x]]
        if up >= down:
            lcp[q] = down
            if up:
                longest[i], source[i] = up, order[p] - base
        else:
            lcp[q] = up
            longest[i], source[i] = down, order[q] - base
        before[q] = p
        if p >= 0:
            after[p] = q
    starts, sources, at = [], [], 0
    while at < n:
        starts.append(at)
        sources.append(source[at])
        at += longest[at] or 1
    return starts, sources


def _counted(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number from 1) of each of ``sizes`` things."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1


def extended(factors: Factors, at: np.ndarray, before: np.ndarray, size: np.ndarray, low: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(first, last, period) of runs that touch block bounds: ``at``, with the sizes of the blocks before and after.

    A run that touches a bound has a whole period on one side of it. On the right it lies in the block that follows. On
    the left it is shorter than both blocks together, as a run that began a period before the block in front would have
    made that block longer. So each period up to these sizes is tried, by extending from the bound to both sides; of
    periods that give the same stretch the smallest counts.
    """
    need = -(-least // 2)  # words that must be equal at a distance of the period
    found = []
    for right in (True, False):
        owner, period = _counted(size if right else np.maximum(before + size - 1, 0))
        b = at[owner]
        i, j = (b, b + period) if right else (b - period, b)
        k = 1 if need >= 3 else 0
        name, step = factors.levels[k], 1 << k
        inside = (i >= low[owner]) & (j < len(name))
        i, j, period = i[inside], j[inside], period[inside]
        tied = (name[i] == name[j]) | ((i >= step) & (name[np.maximum(i - step, 0)] == name[np.maximum(j - step, 0)]))
        i, j, period = i[tied], j[tied], period[tied]
        ahead, back = factors.forward(i, j), factors.backward(i - 1, j - 1)
        good = (ahead + back >= period) & (ahead + back + period >= least)
        found.append(np.stack([(i - back)[good], (j - 1 + ahead)[good], period[good]]))
    first, last, period = np.concatenate(found, 1)
    order = np.lexsort((period, last, first))
    first, last, period = first[order], last[order], period[order]
    new = (np.diff(first, prepend=-1) != 0) | (np.diff(last, prepend=-1) != 0)
    return first[new], last[new], period[new]


def copied(found: list[Run], starts: list[int], sources: list[int], n: int, least: int) -> list[Run]:
    """All runs of a text, by start and period: ``found`` touch a block bound, the others lie inside a block.

    Those are copies of runs inside the block's source, so blocks are walked in order and the runs in the buckets of the
    source's places are put into the block's buckets; a source may reach into its block.
    """
    buckets: dict[int, list[Run]] = defaultdict(list)
    for run in found:
        buckets[run[0]].append(run)
    for at, end, source in zip(starts, [*starts[1:], n], sources, strict=True):
        shift, last = at - source, end - (at - source) - 2  # the last place from which a run is off the block's end
        if end - at < least + 2:
            continue
        for place in range(source + 1, last - least + 2):
            for a, b, q in buckets.get(place, ()):
                if b <= last:
                    buckets[place + shift].append((a + shift, b + shift, q))
    return sorted(chain.from_iterable(buckets.values()), key=lambda r: (r[0], r[2]))


def all_runs(words: np.ndarray, first: np.ndarray, least: int = LEAST) -> dict[int, list[Run]]:
    """Runs of each text that has any: words holds the texts' word numbers one after another, first where each begins.

    A run of ``least`` words repeats half as many, so texts whose suffixes share fewer are done with the LCP array.
    """
    if not len(words):
        return {}
    factors = Factors(words, first)
    need = max(1, -(-least // 2))
    sizes = np.diff(first)
    deep = 1 << np.maximum(factors.split.astype(np.int64), 1)  # more than the words shared at each place
    heads = first[:-1][sizes > 0]
    texts = np.flatnonzero(sizes > 0)[np.maximum.reduceat(deep, heads) > need]
    if not len(texts):
        return {}
    owner, place = _counted(sizes[texts])
    x = first[texts][owner] + place - 1
    lcp = np.zeros(len(x), np.int64)
    lcp[place > 1] = factors.common_words(x[place > 1])
    bounds = np.cumsum(sizes[texts]) - sizes[texts]
    rich = np.maximum.reduceat(lcp, bounds) >= need
    cut, at, before, size, low = {}, [], [], [], []
    for t, a in zip(texts[rich].tolist(), bounds[rich].tolist()):
        base, n = int(first[t]), int(sizes[t])
        starts, sources = cut[t] = blocks(factors.order[base : base + n].tolist(), lcp[a : a + n].tolist(), base)
        edges = np.array([*starts, n])
        width = np.diff(edges)
        at.append(edges + base)
        before.append(np.insert(width, 0, 0))
        size.append(np.append(width, 0))
        low.append(np.full(len(edges), base))
    if not cut:
        return {}
    begin, end, period = extended(factors, *map(np.concatenate, (at, before, size, low)), least)
    text = np.searchsorted(first, begin, "right") - 1
    out: dict[int, list[Run]] = defaultdict(list)
    for t, a, b, q in zip(text.tolist(), begin.tolist(), end.tolist(), period.tolist(), strict=True):
        base = int(first[t])
        out[t].append((a - base, b - base, q))
    return {t: copied(found, *cut[t], int(sizes[t]), least) for t, found in out.items()}


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words but those that a run holds after its first period."""
    keep = np.ones(len(words), bool)
    for first, last, period in found:
        keep[first + period : last + 1] = False
    return list(compress(words, keep.tolist()))


def runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period by start, then period), text (runs cut to one period).

    Words are maximal runs of characters other than blank and \\t..\\r, numbered from 0. A run is a stretch of words with
    smallest period q and at least max(``least``, 2q) words that no neighbouring word extends with that period. The text
    is the words, joined by one blank, without those that a run holds after its first q words.

    One row per row of docs (doc_id, text). Null or empty text: no words, no runs, empty text. Repeated rows stay
    repeated and a null doc_id stays null. Texts are worked on in slices of about half a million characters, a longer
    one alone, whole: it takes about 300 bytes of memory a word and n log n time. Empty tables give no rows; other
    columns are ignored, whatever their names. Nothing is shuffled.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in batches:
            for lo, hi in common.slices(b.column("text")):
                part = b.slice(lo, hi - lo)
                texts = [(t or b"").split() for t in pc.cast(part.column("text"), pa.binary()).to_pylist()]
                number = defaultdict(count().__next__)
                words = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64)
                found = all_runs(words, np.cumsum([0, *map(len, texts)]), least)
                rows = [[{"start": a, "length": e - a + 1, "period": q} for a, e, q in found.get(i, ())] for i in range(len(texts))]
                kept = [b" ".join(collapsed(t, found[i]) if i in found else t) for i, t in enumerate(texts)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(rows, kind), pc.cast(pa.array(kept, pa.binary()), pa.string())], ["doc_id", "n_words", "runs", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def planted(doc_id: Column, text: Column) -> Column:
    """The text, for one in ten documents with its end replaced by repeats of a few words: a known periodic part.

    With h the checksum of the id and g = h div 10, of n words those from a = g mod n on repeat with the period
    1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return F.when((h % 10 == 0) & (n > 0), made).otherwise(text)
