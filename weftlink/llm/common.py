"""What the operators share: the cluster's shared folder, tokenizer caches, word shingles."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only in local mode, as in tests, one of our own."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.match(r"local($|\[)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = _OWN.get(sc.applicationId)
        if not where:
            where = _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="weftlink-")
            sc.setCheckpointDir(where)
    return where if "://" in where or where.startswith("file:") else f"file://{os.path.abspath(where)}"


def fresh(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for made in _SCOPES:
        made.append(path)
    return path


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables and files that are named within are deleted at the end, when nothing may read them any more."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.pop()
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in made:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def settle(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = path or fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def columns(df: DataFrame) -> list[Column]:
    """All columns by name, also those whose names hold dots or backticks."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; works on executors for local, HDFS and object stores alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


# ---------------------------------------------------------------- tokenizers

_ENCODERS: dict[tuple[str, str], PieceEncoder] = {}
_RUN = re.compile(r"\s\s")
_BLANKS = re.compile(r"\s \s")
_SEPARATORS = re.compile("[\x1c-\x1f]")


# The pre-tokenizer patterns of the two public vocabularies.
PATTERNS = {
    "byte": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "word": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write bytes that don't print as the code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: b if b in plain else 256 + rest.index(b) for b in range(256)}


class PieceEncoder(dict):
    """A tokenizers vocabulary behind a cache of pieces that white space separates.

    Both vocabularies split at white space before they merge, so the ids of a text are those of its pieces. The mapping
    gives a piece's ids as little-endian 32-bit bytes. It has two generations of ``limit`` entries: pieces that are met
    again move to the new one, the rest go with the old one. Pieces of Latin letters go straight to the library's merge
    model; others pass its whole pipeline.
    kind "byte": byte-level, a blank belongs to the word after it. kind "word": white space is dropped.
    Texts whose white space runs would be grouped across a cut are encoded whole, and so are texts that may hold one of
    the vocabulary's added tokens, which the library finds before it splits.
    """

    def __init__(self, path: str, kind: str, limit: int = 400_000, longest: int = 64):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.heads = tuple({c for m in added for c in (m[0], m[0].lower(), m[0].upper())})
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.I).search
        self.kind, self.limit, self.longest = kind, limit, longest
        self.old: dict[str, bytes] = {}
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.cut, self.latin = regex.compile(PATTERNS[kind]).findall, re.compile("[\n -~\xa1-\u024f]+").fullmatch

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def merged(self, word: str) -> bytes:
        """The ids of one Latin word by the merge model, a blank before it included."""
        return array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            plain = piece.lower() if self.kind == "word" else piece
            body = plain[1:] if plain[:1] == " " else plain
            if len(piece) <= self.longest and body.isascii() and body.isalpha():  # one word to either pattern
                ids = self.merged(plain)
            elif len(piece) > self.longest or not self.latin(plain):
                ids = self.whole(piece)
            elif len(words := self.cut(plain)) == 1:
                ids = self.merged(words[0])
            else:
                ids = b"".join(map(self.__getitem__, words))
        if len(piece) <= self.longest:
            self[piece] = ids
        return ids

    def pieces(self, text: str) -> list[str] | None:
        if any(h in text for h in self.heads) and self.added(text):
            return None
        if self.kind == "word":
            return None if _SEPARATORS.search(text) else text.split()
        if "\0" in text:
            return None
        if not _RUN.search(text):
            return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        return None if _BLANKS.search(text) else text.replace(" ", "\0 ").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        cut = map(self.pieces, texts)
        return [self.whole(t) if p is None else b"".join(map(self.__getitem__, p)) for t, p in zip(texts, cut, strict=True)]


def encoder(path: str, kind: str) -> PieceEncoder:
    """One per worker process."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = PieceEncoder(path, kind)
    return _ENCODERS[path, kind]


_LIBC: list = []


def release() -> None:
    """Give memory that a worker has freed back to the system: workers live on, and an executor's memory holds them all."""
    import pyarrow as pa

    if not _LIBC:
        _LIBC.append(getattr(ctypes.CDLL(None), "malloc_trim", None))
    pa.default_memory_pool().release_unused()
    if _LIBC[0] is not None:
        _LIBC[0](0)


def slices(column, budget: int = 500_000) -> Iterable[tuple[int, int]]:
    """(from, to) over an Arrow string column, so that each slice holds about ``budget`` characters or one long text.

    At the end, freed memory is given back.
    """
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > budget:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
    release()


# ------------------------------------------------------------ word shingles

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MULT = np.uint64(0x9E3779B97F4A7C15)
_POW = np.ones(1 << 12, np.uint64)
for _i in range(1, len(_POW)):
    _POW[_i] = (int(_POW[_i - 1]) * 0xD6E8FEB86659FD93) & (2**64 - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(texts: list[bytes | None], width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all word shingles of UTF-8 texts, in order, with repeats.

    Words are maximal runs of bytes other than blank and \\t..\\r, A-Z lower-cased. A text of fewer than ``width``
    words has one shingle, its whole sequence; without words none.
    Returns (hashes, first index of each text's shingles with the total at the end, words of each text).
    """
    sizes = np.array([0 if t is None else len(t) for t in texts], np.int64)
    data = np.frombuffer(b" ".join(t or b"" for t in texts) + b" ", np.uint8)
    ends = np.cumsum(sizes + 1)
    low = _FOLD[data]
    word = ~_SPACE[data]
    edge = np.diff(word.view(np.int8), prepend=np.int8(0))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n_words = np.diff(np.searchsorted(starts, ends), prepend=0)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64), n_words
    with np.errstate(over="ignore"):
        lens = stops - starts
        at = np.flatnonzero(word)
        inside = np.arange(len(at)) - np.repeat(np.cumsum(lens) - lens, lens)
        if lens.max() >= len(_POW):
            block = inside >> 12
            scale = mix(block.astype(np.uint64) + np.uint64(1)) | np.uint64(1)
            terms = (low[at].astype(np.uint64) + np.uint64(1)) * _POW[inside & 4095] * np.where(block > 0, scale, np.uint64(1))
        else:
            terms = (low[at].astype(np.uint64) + np.uint64(1)) * _POW[inside]
        words = mix(np.add.reduceat(terms, np.cumsum(lens) - lens) ^ (lens.astype(np.uint64) * _MULT))
        n_shingles = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
        first = np.concatenate([[0], np.cumsum(n_shingles)])
        word_first = np.concatenate([[0], np.cumsum(n_words)])
        whole = np.repeat(n_words >= width, n_shingles)
        pos = np.arange(first[-1]) - np.repeat(first[:-1] - word_first[:-1], n_shingles)
        out = np.zeros(first[-1], np.uint64)
        out[:] = words[pos]
        full = pos[whole]
        acc = words[full]
        for k in range(1, width):
            acc = acc * np.uint64(0xFF51AFD7ED558CCD) + words[full + k]
        out[whole] = acc
        for i in np.flatnonzero((n_words > 0) & (n_words < width)):
            h = words[word_first[i]]
            for k in range(1, n_words[i]):
                h = h * np.uint64(0xFF51AFD7ED558CCD) + words[word_first[i] + k]
            out[first[i]] = h ^ np.uint64(0xA0761D6478BD642F + int(n_words[i]))
        return mix(out), first, n_words
