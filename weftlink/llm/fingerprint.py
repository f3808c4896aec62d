"""Document fingerprints: invertible Bloom lookup sketches of paragraph cells."""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

CELLS = 24
HASHES = 3
MEAN_WORDS = 3
LONGEST = 256
_CELL = np.dtype([("count", "<i4"), ("check", "<u4"), ("key", "<u8")])
_SPACES = np.array([*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_MARKS = np.array([ord(c) for c in ".!?\u3002\uff01\uff1f\u0964\u06d4\u061f"], np.uint32)  # sentence marks of several scripts
_UNSPACED = 0x0E00  # scripts from here on mostly set no blanks between words
_TURN = np.uint64(0x9FB21C651E98DF25)


_POWERS = np.cumprod(np.full(LONGEST, _TURN), dtype=np.uint64)


def digests(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, first): a 64-bit digest of each unit of each text; text i has keys[first[i]:first[i+1]], distinct.

    Units are the paragraphs of a text, cut into pieces by their content, with one rule for texts of any length: after a
    line break, after a word that ends in a sentence mark or whose hash is a multiple of MEAN_WORDS, in scripts without
    blanks after such a character, and after LONGEST characters. So an edit changes the units it touches and no others, and short texts have several.
    A digest is 48 bits of hash, of the unit and how often it came before in its text, and 16 bits of its length.
    """
    sizes = np.array([len(t or "") for t in texts], np.int64)
    codes = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts)), sizes)
    keep = np.flatnonzero(~np.isin(codes, _SPACES))
    if not len(keep):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    seen, owner = codes[keep], owner[keep]
    char = seen.astype(np.uint64) + np.uint64(1)
    text_start = np.diff(owner, prepend=-1) != 0
    word_start = (np.diff(keep, prepend=-2) > 1) | text_start
    broken = np.diff(np.cumsum(codes == 10)[keep], prepend=0) > 0
    # A hash of each word, or in unspaced scripts of each two characters, tells whether a unit ends there.
    begins = np.flatnonzero(word_start)
    last = np.append(begins[1:], len(char)) - 1
    inside = np.arange(len(char)) - np.repeat(begins, last - begins + 1)
    stop = np.zeros(len(char), bool)
    with np.errstate(over="ignore"):
        words = common.mix(np.add.reduceat(char * _POWERS[inside % LONGEST], begins))
        stop[last] = (words % np.uint64(MEAN_WORDS) == 0) | np.isin(seen[last], _MARKS)
        wide = np.flatnonzero(seen >= _UNSPACED)
        if len(wide):
            before = np.where(text_start[wide], np.uint64(0), char[wide - 1])
            stop[wide] |= (common.mix(char[wide] + common.mix(before)) % np.uint64(2 * MEAN_WORDS) == 0) | np.isin(seen[wide], _MARKS)
    unit_start = np.concatenate([[True], stop[:-1]]) | text_start | broken
    at = np.flatnonzero(unit_start)
    far = np.arange(len(char)) - np.repeat(at, np.diff(at, append=len(char)))
    at = np.flatnonzero(unit_start | (far % LONGEST == 0))
    lengths = np.diff(at, append=len(char))
    far = np.arange(len(char)) - np.repeat(at, lengths)
    with np.errstate(over="ignore"):
        mark = np.where(word_start & (far > 0), np.uint64(1) << np.uint64(40), np.uint64(0))  # a blank before the character
        h = common.mix(np.add.reduceat((char + mark) * _POWERS[far], at) + lengths.astype(np.uint64))
        whose = owner[at]
        order = np.lexsort((h, whose))
        same = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (whose[order][1:] == whose[order][:-1])])
        run = np.flatnonzero(~same)
        nth = np.arange(len(order)) - np.repeat(run, np.diff(run, append=len(order)))
        h, whose, lengths = h[order], whose[order], lengths[order]
        h = np.where(nth > 0, common.mix(h + nth.astype(np.uint64) * _TURN), h)
    keys = h >> np.uint64(16) << np.uint64(16) | lengths.astype(np.uint64)
    order = np.lexsort((keys, whose))
    keys, whose = keys[order], whose[order]
    one = np.concatenate([[True], (keys[1:] != keys[:-1]) | (whose[1:] != whose[:-1])])  # a key twice in a sketch would cancel itself
    return keys[one], np.searchsorted(whose[one], np.arange(len(texts) + 1))


class Sketches:
    """The sketches of many sets side by side; set i has 3 * thirds[i] cells, and each key one cell in each third.

    A cell holds a count, and the sums of its keys and of their checks (modulo 2^64). Sketches of one size and ``salt``
    are linear: ``minus`` gives those of the differences of two sets, where a key of the second set has a count of -1.
    """

    def __init__(self, keys: np.ndarray, owner: np.ndarray, thirds: np.ndarray, salt: int = 0):
        self.thirds, self.salt = np.asarray(thirds, np.int64), salt
        self.first = np.concatenate([[0], np.cumsum(HASHES * self.thirds)])
        self.count = np.zeros(self.first[-1], np.int64)
        self.key, self.check = np.zeros(self.first[-1], np.uint64), np.zeros(self.first[-1], np.uint64)
        self.add(keys, owner, np.ones(len(keys), np.int64))

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(np.empty(0, np.uint64), np.empty(0, np.int64), self.thirds, self.salt)
        out.count, out.key, out.check = self.count - other.count, self.key - other.key, self.check - other.check
        return out

    def _checks(self, keys: np.ndarray) -> np.ndarray:
        return common.mix(keys ^ np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)

    def _place(self, keys: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
        third = self.thirds[owner]
        with np.errstate(over="ignore"):
            h = common.mix(keys + np.uint64(0x165667B19E3779F9) * np.uint64(1 + HASHES * self.salt + k))
        return self.first[owner] + k * third + (h % third.astype(np.uint64)).astype(np.int64)

    def add(self, keys: np.ndarray, owner: np.ndarray, signs: np.ndarray) -> list[np.ndarray]:
        """Add keys, or take them out with a sign of -1; returns their cells in each third."""
        times = signs.view(np.uint64)
        key, check = keys * times, self._checks(keys) * times
        cells = [self._place(keys, owner, k) for k in range(HASHES)]
        for at in cells:
            np.add.at(self.count, at, signs)
            np.add.at(self.key, at, key)
            np.add.at(self.check, at, check)
        return cells

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner, key, sign) of all keys that can be recovered, and which sets were recovered whole.

        Third by third, the keys of all cells that hold just one are taken out of their other cells as well; a set has
        each key in one cell of a third, so none is taken twice. Only cells that a removal touched are looked at again.
        """
        n = len(self.thirds)
        cell_owner = np.repeat(np.arange(n), HASHES * self.thirds)
        inside = np.arange(self.first[-1]) - self.first[cell_owner]
        third = inside // np.maximum(self.thirds[cell_owner], 1)
        fresh = [np.flatnonzero(third == k) for k in range(HASHES)]
        out: list[tuple] = [(np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))]
        marks, budget = np.zeros(len(self.count), bool), 4 * len(self.count) + 1
        while any(map(len, fresh)) and budget > 0:
            for k in range(HASHES):
                cells, fresh[k] = fresh[k], np.empty(0, np.int64)
                pure = cells[np.abs(self.count[cells]) == 1]
                signs, owner = self.count[pure], cell_owner[pure]
                keys = self.key[pure] * signs.view(np.uint64)
                true = (self._checks(keys) == self.check[pure] * signs.view(np.uint64)) & (self._place(keys, owner, k) == pure)
                keys, owner, signs = keys[true], owner[true], signs[true]
                if not len(keys):
                    continue
                budget -= len(keys)
                touched = self.add(keys, owner, -signs)
                out.append((owner, keys, signs))
                for other in range(HASHES):
                    if other != k:
                        fresh[other] = np.concatenate([fresh[other], touched[other]])
                        marks[fresh[other]] = True
                        fresh[other] = np.flatnonzero(marks) if len(fresh[other]) > len(marks) // 16 else np.unique(fresh[other])
                        marks[fresh[other]] = False
        left = np.bincount(cell_owner, (self.count != 0) | (self.key != 0) | (self.check != 0), n)
        owner, keys, signs = (np.concatenate(x) for x in zip(*out, strict=True))
        return owner, keys, signs, left == 0

    def texts(self) -> list[str]:
        table = np.zeros(len(self.count), _CELL)
        table["count"], table["key"], table["check"] = self.count, self.key, self.check
        return [base64.b85encode(table[i:j].tobytes()).decode() for i, j in zip(self.first[:-1], self.first[1:], strict=True)]


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    return keys, np.repeat(np.arange(len(sets)), list(map(len, sets)))


def differences(pairs: list[tuple[np.ndarray, np.ndarray]], cells: int = CELLS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of digest sets, the digests only in the first and only in the second.

    The sketches of the two sets, in ``cells`` cells as in their fingerprints, are subtracted and peeled. Where that
    fails both are made again, larger and with other places: the squares of a difference's counts add up to about three
    per digest, which tells how much. Sizes at least double and are at most a cell in each third for every digest of
    both sets; a pair that still fails there is compared digest by digest, so the retries end.
    """
    done: list = [None] * len(pairs)
    open_ = np.arange(len(pairs))
    thirds, salt = np.full(len(pairs), max(1, cells // HASHES)), 0
    while len(open_):
        own = [pairs[i] for i in open_.tolist()]
        most = np.array([len(a) + len(b) for a, b in own])
        left, right = (Sketches(*_flat([p[side] for p in own]), thirds, salt) for side in (0, 1))
        table = left.minus(right)
        squares = np.add.reduceat(table.count**2, table.first[:-1])
        total = np.add.reduceat(table.count, table.first[:-1])
        guess = np.maximum(squares - total**2 // (HASHES * thirds), 0) // HASHES + np.abs(total) // HASHES
        who, k, sign, whole = table.peel()
        order = np.argsort(who, kind="stable")
        who, k, sign = who[order], k[order], sign[order]
        bounds = np.searchsorted(who, np.arange(len(own) + 1))
        for i in np.flatnonzero(whole).tolist():
            x, s = k[bounds[i] : bounds[i + 1]], sign[bounds[i] : bounds[i + 1]]
            done[open_[i]] = x[s > 0], x[s < 0]
        for i in np.flatnonzero(~whole & (thirds >= most)).tolist():
            a, b = own[i]
            done[open_[i]] = np.setdiff1d(a, b), np.setdiff1d(b, a)
        again = ~whole & (thirds < most)
        open_, thirds, salt = open_[again], np.minimum(np.maximum(2 * thirds, 2 * guess // HASHES), most)[again], salt + 1
    return done


def likenesses(pairs: list[tuple[np.ndarray, np.ndarray]], cells: int = CELLS) -> list[float]:
    """Characters of units in both, as a share of the mean of both totals; 1 for equal sets, also for two empty ones."""
    size = lambda x: int((x & np.uint64(0xFFFF)).sum())
    out = []
    for (a, b), (x, y) in zip(pairs, differences(pairs, cells), strict=True):
        total = size(a) + size(b)
        out.append(1.0 - (size(x) + size(y)) / total if total else 1.0)
    return out


def fingerprints(sets: list[np.ndarray], cells: int = CELLS) -> list[str]:
    """The sketch of each set in ``cells`` cells as text."""
    return Sketches(*_flat(sets), np.full(len(sets), max(1, cells // HASHES))).texts() if sets else []


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) replaced by the first as many code points of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def splitters(docs: DataFrame, parts: int) -> np.ndarray:
    """Ascending doc_ids that cut the table into about ``parts`` ranges, from one approximate-quantile pass over doc_id."""
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / parts for i in range(1, parts)], 20 * parts).alias("c")).first().c
    return np.unique(np.array(cuts or [], np.int64))


def constants(values: np.ndarray) -> Column:
    """An array of longs that the optimizer folds into one literal."""
    text = ",".join(map(str, values.tolist()))
    return F.split(F.lit(text), ",").cast("array<bigint>") if text else F.array().cast("array<bigint>")


def place(doc_id: Column, cuts: np.ndarray) -> Column:
    """How many cuts are at or below doc_id, in about twice the root of their number of comparisons; 0 for null."""
    step = max(1, int(len(cuts) ** 0.5))
    block = F.size(F.filter(constants(cuts[::step]), lambda c: c <= doc_id))
    inside = F.slice(constants(cuts), (block - 1) * step + 1, F.lit(step))
    return F.when(doc_id.isNull() | (block == 0), 0).otherwise((block - 1) * step + F.size(F.filter(inside, lambda c: c <= doc_id)))


def following_pairs(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows dealt and sorted so that within a range each document is followed by the next one in doc_id order.

    Columns: range, sentinel, doc_id, tie (of rows with one doc_id), text. A range ends in a copy of the first document
    of the next range that has one (of the first of all, at the end), marked as sentinel, so no task needs another.
    Null doc_ids come first. The driver holds a splitter and a first document's id for each range, four ranges for each
    shuffle partition.
    """
    parts = parts or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = splitters(docs, parts)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("range", place(F.col("doc_id"), cuts))
    first = rows.groupBy("range").agg(F.min(F.struct("doc_id", "tie")).alias("first")).collect()  # a row for each range
    order = sorted(r.range for r in first)
    before, null, head, tie = (np.zeros(len(cuts) + 1, np.int64) for _ in range(4))
    for r in first:
        null[r.range], head[r.range], tie[r.range] = r.first.doc_id is None, r.first.doc_id or 0, r.first.tie
    for i, r in enumerate(order):
        before[r] = order[i - 1]
    of = lambda values: F.get(constants(values), F.col("range"))
    known = F.coalesce("doc_id", F.lit(0).cast("long"))
    is_first = (of(null) == F.col("doc_id").isNull().cast("long")) & (of(head) == known) & (of(tie) == F.col("tie"))
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("sentinel"))
    copy = F.struct(of(before).cast("int").alias("range"), F.lit(True).alias("sentinel"))
    dealt = rows.select("doc_id", "tie", "text", F.explode(F.when(is_first, F.array(own, copy)).otherwise(F.array(own))).alias("c"))
    return dealt.select("c.range", "c.sentinel", "doc_id", "tie", "text").repartition("range").sortWithinPartitions("range", "sentinel", "doc_id", "tie")


def fingerprint_versions(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each document.

    The fingerprint is the sketch of the text's units in ``cells`` cells. Likenesses come from the difference of the two
    versions' fingerprints; where peeling fails both sketches are made again, larger, so the digests that differ are
    always recovered. Null text is empty; a very long text is worked on alone. Rows with one doc_id follow in the order of their texts' hashes, null ids first. One document
    alone follows itself. An empty table gives no rows; other columns are ignored.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        last = None
        for b in batches:
            for lo, hi in common.slices(b.column("text")):
                part = b.slice(lo, hi - lo)
                rows, chain, new = [], [] if last is None else [last[2]], []  # texts in order, and the edited ones
                at = []  # of each row its place in the chain; the next document follows there
                for place, sentinel, doc, text in zip(*(part.column(c).to_pylist() for c in ("range", "sentinel", "doc_id", "text")), strict=True):
                    if last is not None and last[0] == place:
                        new.append(edited(last[2], text))
                        rows.append((last[1], len(last[2]), hashlib.sha256(new[-1].encode()).hexdigest()))
                        at.append(len(chain) - 1)
                    chain.append(text)
                    last = None if sentinel else (place, doc, text)
                if rows:
                    keys, first = digests(chain + new)
                    sets = [keys[i:j] for i, j in itertools.pairwise(first.tolist())]
                    own, edits = [sets[i] for i in at], sets[len(chain) :]
                    like = likenesses([(own[i], other) for i, j in enumerate(at) for other in (edits[i], sets[j + 1])], cells)
                    columns = [*zip(*rows, strict=True), fingerprints(own, cells), fingerprints(edits, cells), like[::2], like[1::2]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return following_pairs(docs).select("range", "sentinel", "doc_id", "text").mapInArrow(run, schema)
