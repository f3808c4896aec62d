"""Token-id shards: a concatenated id array whose document boundaries are Elias-Fano coded."""

from __future__ import annotations

import itertools
import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

MAGIC = b"WEFTIDS1"
_TRAILER = struct.Struct("<QQQQqQQ8s")  # ids, documents, null doc_ids, id bytes, least doc_id, bytes of both codes, magic
_EF = struct.Struct("<QQQQ")  # values, low bits, bytes of the low part, bytes of the high part
_SAMPLE = 256


class EliasFano:
    """Non-decreasing integers in about 2 + log2(universe/n) bits each.

    Low bits are stored plainly, high bits in unary. Every 256th one of the unary part has its position sampled in 32
    bits, so ``select`` reads a sample and then a few bytes; no 64-bit table of offsets exists.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        shift = np.arange(low_bits, dtype=np.uint64)
        parts = []
        for at in range(0, n, 1 << 17):
            parts.append(((values[at : at + (1 << 17), None] >> shift) & np.uint64(1)).astype(np.uint8).ravel())
        low = np.packbits(np.concatenate(parts), bitorder="little") if parts else np.empty(0, np.uint8)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::_SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return _EF.pack(self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, a, b = _EF.unpack_from(data)
        at = _EF.size
        return cls(n, low_bits, np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a), np.frombuffer(data, "<u4", -(-n // _SAMPLE), at + a + b))

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        pos = int(self.samples[i // _SAMPLE])
        left = i % _SAMPLE
        byte, bits = pos >> 3, int(self.high[pos >> 3]) >> (pos & 7) << (pos & 7)
        while left >= (c := bits.bit_count()):
            left -= c
            byte += 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        one = 8 * byte + (bits & -bits).bit_length() - 1
        at, low = i * self.low_bits, 0
        if self.low_bits:
            raw = int.from_bytes(self.low[at >> 3 : ((at + self.low_bits - 1) >> 3) + 1].tobytes(), "little")
            low = raw >> (at & 7) & ((1 << self.low_bits) - 1)
        return (one - i) << self.low_bits | low

    def between(self, i: int, j: int) -> np.ndarray:
        """Values i..j-1, from the bytes between the samples around them."""
        j = min(j, self.n)
        if i >= j:
            return np.empty(0, np.uint64)
        from_bit, last = int(self.samples[i // _SAMPLE]), -(-j // _SAMPLE)
        to_bit = int(self.samples[last]) + 1 if last < len(self.samples) else 8 * len(self.high)
        byte = from_bit >> 3
        ones = np.flatnonzero(np.unpackbits(self.high[byte : (to_bit + 7) >> 3], bitorder="little")) + 8 * byte
        ones = ones[ones >= from_bit][i % _SAMPLE :][: j - i]
        out = (ones - np.arange(i, j)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            at = i * self.low_bits
            bits = np.unpackbits(self.low[at >> 3 : (j * self.low_bits + 7) >> 3], bitorder="little")[at & 7 :][: (j - i) * self.low_bits]
            weight = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
            out |= (bits.reshape(j - i, self.low_bits) * weight).sum(1, dtype=np.uint64)
        return out


class ShardWriter:
    """Streams ids to a file; only the lengths and doc_ids of one shard are held."""

    def __init__(self, uri: str, id_bytes: int):
        fs, path = common.filesystem(uri)
        self.uri, self.id_bytes, self.out = uri, id_bytes, fs.open_output_stream(path, compression=None)
        self.ids, self.ends, self.docs = 0, array("q"), array("q")

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        """Documents come by ascending doc_id, those without one first."""
        if int(ids.max(initial=0)) >> 8 * self.id_bytes:
            raise ValueError(f"token id {ids.max()} needs more than {self.id_bytes} bytes")
        self.out.write(ids.astype(f"<u{self.id_bytes}").tobytes())
        self.ids += len(ids)
        self.ends.append(self.ids)
        if doc is not None:
            self.docs.append(doc)

    def close(self) -> tuple[str, int, int]:
        known = np.frombuffer(self.docs, np.int64)
        least = int(known[0]) if len(known) else 0
        bounds = EliasFano.encode(np.frombuffer(self.ends, np.uint64)).to_bytes()
        with np.errstate(over="ignore"):
            names = EliasFano.encode(known.view(np.uint64) - np.int64(least).view(np.uint64)).to_bytes()
        self.out.write(bounds + names + _TRAILER.pack(self.ids, len(self.ends), len(self.ends) - len(known), self.id_bytes, least, len(bounds), len(names), MAGIC))
        self.out.close()
        return self.uri, len(self.ends), self.ids


class Shard:
    """Random access to a written shard: boundaries are in memory, ids are read by range."""

    def __init__(self, uri: str):
        fs, path = common.filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - _TRAILER.size)
        self.n_ids, self.n_docs, nulls, self.id_bytes, least, a, b, magic = _TRAILER.unpack(self.file.read(_TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"not a token-id shard: {uri}")
        self.file.seek(size - _TRAILER.size - a - b)
        tail = self.file.read(a + b)
        self.bounds = EliasFano.from_bytes(tail[:a])
        self.nulls, self.least, self.names = nulls, least, EliasFano.from_bytes(tail[a:])

    def doc_ids(self, i: int, j: int) -> list[int | None]:
        with np.errstate(over="ignore"):
            known = (self.names.between(max(0, i - self.nulls), max(0, j - self.nulls)) + np.int64(self.least).view(np.uint64)).view(np.int64)
        return [None] * max(0, min(j, self.nulls) - i) + known.tolist()

    def start(self, i: int) -> int:
        """Ids before document i."""
        return self.bounds.select(i - 1) if i else 0

    def read(self, first: int, last: int) -> np.ndarray:
        """Ids first..last-1 of the whole array."""
        self.file.seek(first * self.id_bytes)
        return np.frombuffer(self.file.read((last - first) * self.id_bytes), f"<u{self.id_bytes}")

    def document(self, i: int) -> np.ndarray:
        return self.read(self.start(i), self.start(i + 1))


def write_shards(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 0, id_bytes: int = 2, shard_ids: int = 64_000_000, shard_docs: int = 4_000_000) -> DataFrame:
    """Encode every text, append ``end_id``, and write the ids in ascending doc_id order to shards in the shared folder.

    Returns the manifest, one row per shard in order: part, shard, uri, n_docs, n_ids, first_id (ids of all shards
    before it). It is written with Spark's committer, so only the files of successful attempts are in it.
    Documents are dealt by ranges of doc_id and sorted; a shard is closed at ``shard_ids`` ids or ``shard_docs``
    documents, so what a task holds of one is bounded. Null text: empty, so only the end id. Null doc_ids come first.
    Rows with the same doc_id follow in the order of their texts' hashes, which also split such an id between tasks;
    equal rows are written each. A very long text is encoded alone. Other columns are ignored, whatever their names. An id
    that does not fit in ``id_bytes`` is an error. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    home = common.fresh(spark, "token-ids")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        enc, part, done, writer = common.encoder(tokenizer, kind), TaskContext.get().partitionId(), [], None
        end = np.array([end_id], "<u4").tobytes()
        fs, path = common.filesystem(home)
        fs.create_dir(path, recursive=True)
        for b in batches:
            for lo, hi in common.slices(b.column("text")):
                piece = b.slice(lo, hi - lo)
                encoded = enc.encode([t or "" for t in piece.column("text").to_pylist()])
                for doc, ids in zip(piece.column("doc_id").to_pylist(), encoded, strict=True):
                    writer = writer or ShardWriter(f"{home}/{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.ids", id_bytes)
                    writer.add(doc, np.frombuffer(ids + end, "<u4"))
                    if writer.ids >= shard_ids or len(writer.ends) >= shard_docs:
                        done.append(writer.close())
                        writer = None
        if writer:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(done), pa.int32()), pa.array(range(len(done)), pa.int32()), *(pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True))], ["part", "shard", "uri", "n_docs", "n_ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    shards = common.settle(ordered.select("doc_id", "text").mapInArrow(run, "part int, shard int, uri string, n_docs long, n_ids long"), "token-id-manifest")
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    return shards.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_shards(manifest: DataFrame) -> DataFrame:
    """Documents of the shards: doc_id, start (over all shards), ids (little-endian unsigned 32-bit).

    One task reads a shard at a time. Of 4096 documents at a time the bounds are selected from the Elias-Fano code, then
    their ids are read in ranges of about a million; no table of a shard's offsets is made.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for uri, base in zip(b.column("uri").to_pylist(), b.column("first_id").to_pylist(), strict=True):
                shard = Shard(uri)
                for at in range(0, shard.n_docs, 4096):
                    to = min(at + 4096, shard.n_docs)
                    names, bounds = shard.doc_ids(at, to), np.append(np.uint64(shard.start(at)), shard.bounds.between(at, to)).astype(np.int64)
                    i = 0
                    while i < to - at:
                        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + 1_000_000, "right")) - 1)
                        ids = shard.read(int(bounds[i]), int(bounds[j])).astype("<u4")
                        data = [ids[s:e].tobytes() for s, e in itertools.pairwise((bounds[i : j + 1] - bounds[i]).tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(names[i:j], pa.int64()), pa.array(base + bounds[i:j], pa.int64()), pa.array(data, pa.binary())], ["doc_id", "start", "ids"])
                        i = j

    files = manifest.select("uri", "first_id").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, F.xxhash64("uri"))
    return files.mapInArrow(run, "doc_id long, start long, ids binary")


def load(spark: SparkSession, uri: str) -> Shard:
    """A shard, for use outside Spark."""
    return Shard(uri)
