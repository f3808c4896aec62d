"""Language identification with bit-sliced Bloom filters of letter trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

UNKNOWN = "und"
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters; made once per process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ends): a 63-bit key for each letter with its neighbours, lower-cased, other characters as a blank; keys of text i end at ends[i]."""
    low = [f" {(t or '').lower()} " for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le"), "<u4")
    letter = _letters()[codes]
    codes = np.where(letter, codes, 32).astype(np.uint64)
    mid = np.flatnonzero(letter)
    keys = codes[mid - 1] | codes[mid] << np.uint64(21) | codes[mid + 1] << np.uint64(42)
    return keys, np.searchsorted(mid, np.cumsum([len(t) for t in low]))


@dataclass
class LanguageFilters:
    """Tables of ``rows`` masks, one for each 64 languages; a bit of a mask belongs to the Bloom filter of one language.

    Of an n-gram the ``hashes`` masks are read and ANDed: what remains are all languages that contain it. ``fill`` is
    the share of set bits of each language, so an absent n-gram passes with the probability fill ** hashes.
    """

    languages: list[str]
    masks: np.ndarray
    hashes: int
    fill: np.ndarray

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], rows: int, hashes: int) -> LanguageFilters:
        languages = sorted(grams)
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(t).itemsize * 8 >= min(len(languages), 64))
        masks = np.zeros((max(1, -(-len(languages) // 64)), rows), kind)
        for i, lang in enumerate(languages):
            for at in cls._rows(grams[lang], rows, hashes):
                masks[i // 64][at] |= kind(1 << i % 64)
        fill = np.array([np.count_nonzero(masks[i // 64] & kind(1 << i % 64)) / rows for i in range(len(languages))])
        return cls(languages, masks, hashes, fill)

    @staticmethod
    def _rows(keys: np.ndarray, rows: int, hashes: int) -> Iterator[np.ndarray]:
        h = common.mix(keys.astype(np.uint64))
        step = (h >> np.uint64(32)) | np.uint64(1)
        for _ in range(hashes):
            yield (h & np.uint64(rows - 1)).astype(np.int64)
            h = h + step

    def lookup(self, keys: np.ndarray, word: int = 0) -> np.ndarray:
        """The masks of languages 64 * word and on."""
        out, masks = None, self.masks[word]
        for at in self._rows(keys, len(masks), self.hashes):
            out = masks[at] if out is None else out & masks[at]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language whose filter holds most n-grams after the expected false positives are taken off, and that share.

        Ties go to the first language by name. No letter, or no languages learned: und, 0.
        """
        keys, ends = trigrams(texts)
        n = np.diff(ends, prepend=0)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        found = np.zeros((len(self.languages), len(texts)))
        for i in range(len(self.languages)):
            if i % 64 == 0:
                masks = self.lookup(keys, i // 64)
            total = np.concatenate([[0], np.cumsum((masks >> masks.dtype.type(i % 64)) & masks.dtype.type(1), dtype=np.int64)])
            false = self.fill[i] ** self.hashes
            found[i] = ((total[ends] - total[ends - n]) / np.maximum(n, 1) - false) / max(1 - false, 1e-9)
        found = found.clip(0, 1)
        best = found.argmax(0)
        return [self.languages[b] if m else UNKNOWN for b, m in zip(best.tolist(), n.tolist(), strict=True)], np.where(n > 0, found[best, np.arange(len(texts))], 0.0)


def held_out(doc_id: Column) -> Column:
    """True for a fifth of the documents, by the CRC-32 of the id as text; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(labelled: DataFrame, rows: int = 1 << 21, hashes: int = 4, least_rate: float = 1e-6, least_share: float = 0.2) -> LanguageFilters:
    """Learn from columns text and lang; rows with a null in either teach nothing.

    An n-gram enters the filter of a language in which it occurs at a rate of at least ``least_rate`` of all n-grams and
    of at least ``least_share`` of its rate in the language where it is most frequent, which keeps out quotations.
    Counts cover all rows; at most 1/least_rate n-grams of a language can pass, and there are ``rows`` masks for
    each 64 languages, so what the driver gathers and broadcasts grows with the languages only, of which any number goes.
    """

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for lo, hi in common.slices(b.column("text")):
                part = b.slice(lo, hi - lo)
                langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
                for lang in set(langs):
                    keys, n = np.unique(trigrams([t for t, x in zip(texts, langs, strict=True) if x == lang])[0], return_counts=True)
                    if lang in seen:
                        keys, back = np.unique(np.concatenate([seen[lang][0], keys]), return_inverse=True)
                        n = np.bincount(back, np.concatenate([seen[lang][1], n]), len(keys)).astype(np.int64)
                    seen[lang] = keys, n
                    if len(keys) > 2_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])
                        del seen[lang]
        for lang, (keys, n) in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    known = labelled.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("text is not null and lang is not null")
    counts = common.settle(known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    sums = counts.groupBy("lang").agg(F.sum("n").alias("total"))  # a row per language
    langs = [r.lang for r in sums.collect()]
    if not langs:
        return LanguageFilters.build({}, rows, hashes)
    rate = counts.join(F.broadcast(sums), "lang").withColumn("rate", F.col("n") / F.col("total")).where(F.col("rate") >= least_rate)
    most = rate.groupBy("gram").agg(F.max("rate").alias("most"))
    kept = rate.join(most, "gram").where(F.col("rate") >= least_share * F.col("most")).select("lang", "gram").toPandas()
    return LanguageFilters.build({lang: kept.gram[kept.lang == lang].to_numpy(np.int64).astype(np.uint64) for lang in langs}, rows, hashes)


def _numbered(df: DataFrame) -> DataFrame:
    """df with its columns numbered: Python operators of Spark can't take a name with a dot."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def identify(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """All columns of docs with lang_pred and score added; columns of docs with these names are replaced.

    Null texts and texts without a letter: und with score 0. Only text is looked at. Repeated rows stay repeated, ties
    go to the first language by name, a very long text is worked on alone, an empty table gives no rows.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(filters)
    rest = docs.drop("lang_pred", "score")
    at, plain = rest.columns.index("text"), _numbered(rest)
    schema = T.StructType([*plain.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts, langs, scores = b.column(at), [], []
            for lo, hi in common.slices(texts):
                x, y = model.value.predict(texts.slice(lo, hi - lo).to_pylist())
                langs += x
                scores += y.tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return plain.mapInArrow(run, schema).toDF(*rest.columns, "lang_pred", "score")


def in_known_language(docs: DataFrame, filters: LanguageFilters, least_score: float) -> DataFrame:
    """The rows of docs whose text has a language and a score of at least ``least_score``; all columns stay as they are."""
    model = docs.sparkSession.sparkContext.broadcast(filters)
    at, plain = docs.columns.index("text"), _numbered(docs)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts, keep = b.column(at), []
            for lo, hi in common.slices(texts):
                langs, scores = model.value.predict(texts.slice(lo, hi - lo).to_pylist())
                keep += [lang != UNKNOWN and score >= least_score for lang, score in zip(langs, scores.tolist(), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
