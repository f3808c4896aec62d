import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from tokenizers import Tokenizer

from weftlink.llm import common, packing, token_ids

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, start string"
CASES = [(5, "Hello  world,\n\n this is <|endoftext|>  a\t test. \n"), (1, None), (2, ""), (9, "word " * 9000), (7, "é́ x y  z"), (7, "é́ x y  z"), (-3, "   "), (11, "a" * 5000), (12, "x\n \nz  \n"), (None, "null id")]
ALPHABET = st.sampled_from(["a", "b", "The", " ", "  ", "\n", "\t", "'s", "́", "é", "Σ", "İ", "12", ".", "!!", "\x1c", "\x85", " ", "​", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "日本", "😀"])


def library_pieces(rows, tokenizer, end_id=2):
    """The ids of each document by the tokenizers library itself."""
    t = Tokenizer.from_file(tokenizer)
    return {d: [*t.encode(x or "", add_special_tokens=False).ids, end_id] for d, x in rows}


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_pieces_equal_whole_texts(name, kind):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    enc = common.PieceEncoder(path, kind, limit=50)

    @settings(max_examples=400, deadline=None)
    @given(st.lists(ALPHABET, max_size=12).map("".join))
    def check(text):
        assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids

    check()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=700))
def test_elias_fano(values):
    values.sort()
    ef = token_ids.EliasFano.from_bytes(token_ids.EliasFano.encode(np.array(values, np.uint64)).to_bytes())
    assert ef.between(0, len(values)).tolist() == values
    for i, j in ((1, 300), (255, 257), (256, 512), (300, 10**6), (3, 3)):
        assert ef.between(i, j).tolist() == values[i:j]
    assert [ef.select(i) for i in range(len(values))] == values


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 3000, 20_000)).astype(np.uint64)
    assert len(token_ids.EliasFano.encode(ends).to_bytes()) < 20_000 * 14 / 8


def test_shards_round_trip(spark):
    docs = spark.createDataFrame([Row(d, t, "en", "s", 1, "x", "y") for d, t in CASES], DOCS)
    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = token_ids.write_shards(docs, path, shard_ids=3000)
    got = sorted(((r.start, r.doc_id, bytes(r.ids)) for r in token_ids.read_shards(manifest).collect()), key=lambda r: (r[0]))
    plain, at = Tokenizer.from_file(path), 0
    order = sorted(CASES, key=lambda c: (c[0] is not None, c[0] or 0))  # equal ids have equal texts
    assert [g[1] for g in got] == [c[0] for c in order]
    for (start, _, ids), (_, text) in zip(got, order, strict=True):
        want = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert start == at and zlib.crc32(ids) == zlib.crc32(want.tobytes())
        at += len(want)
    shard = token_ids.load(spark, manifest.orderBy("first_id").first().uri)
    assert shard.document(0).tolist() == np.frombuffer(got[0][2], "<u4").tolist()
    small = token_ids.read_shards(token_ids.write_shards(docs, path, shard_docs=3)).select("start", "doc_id", "ids").collect()
    assert sorted((r.start, r.doc_id, bytes(r.ids)) for r in small) == got
    empty = token_ids.write_shards(docs.where("false"), path)
    assert token_ids.read_shards(empty).count() == 0


def test_packing(spark):
    docs = spark.createDataFrame([Row(d, t, "en", "s", 1, "x", "y") for d, t in CASES], DOCS)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(docs.where("doc_id != 7 and doc_id is not null"), path, window=64, block=500).collect()
    want = library_pieces([c for c in CASES if c[0] not in (7, None)], path)
    got: dict = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.start, np.frombuffer(bytes(r.ids), "<u4").tolist(), r.doc_tokens, r.length))
    assert {d: [x for p in sorted(ps) for x in p[1]] for d, ps in got.items()} == want
    windows: dict = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for w in windows.values():
        w.sort()
        assert [o for o, _ in w] == [sum(n for _, n in w[:i]) for i in range(len(w))] and sum(n for _, n in w) <= 64
    assert packing.pack(docs, path).count() >= len(CASES)
    assert packing.pack(docs.where("false"), path).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60))
def test_best_fit_equals_scan(lengths):
    windows, room = packing.best_fit_decreasing(np.array(lengths), 40)
    left: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in left if r >= n]
        if fits:
            left[left.index(min(fits))] -= n
        else:
            left.append(40 - n)
    assert sorted(room) == sorted(left)
    assert sorted(i for w in windows for i in w) == list(range(len(lengths)))


def test_ids_that_do_not_fit(tmp_path):
    writer = token_ids.ShardWriter(f"file://{tmp_path}/x.ids", 2)
    with pytest.raises(ValueError, match="70000"):
        writer.add(1, np.array([5, 70_000], "<u4"))


def test_query_against_the_library(spark, sf):
    """op1 as registered: every row against the tokenizers library."""
    from weftlink.llm.queries import op1_token_ids, table

    want, at = {}, 0
    for d, ids in library_pieces(sorted((r.doc_id, r.text) for r in table(spark, sf, "documents").collect()), public_tokenizers.path("byte_bpe_50k.json"), 0).items():
        want[d] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op1_token_ids(spark, sf).collect()} == want
