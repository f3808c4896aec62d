"""The pipeline's rows against plain Python at every stage."""

import os
import zlib
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers

from weftlink.llm import common
from weftlink.llm.queries import table

from .test_duplicates import brute, item_shingles
from .test_pii import brute as personal
from .test_tokens import library_pieces


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    names = docs.columns
    stage = dict(corpus_pipeline.STAGES)

    kept = stage["language"](spark, docs, sf).select(names).cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id for r in kept.collect()} == {d for d, t in rows if any(c.isalpha() for c in t)}

    single = stage["near_duplicates"](spark, kept, sf).select(names).cache()
    groups = brute([(r.doc_id, r.text) for r in kept.collect()])
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d, (_, c) in groups.items() if c == d)

    clean = stage["decontamination"](spark, single, sf).select(names).cache()
    items = [item_shingles(r.text) for r in table(spark, sf, "benchmark").collect()]
    held = {r.doc_id for r in single.collect() if any(i and 100 * len(i & item_shingles(r.text)) >= 75 * len(i) for i in items)}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - held

    masked = stage["personal_data"](spark, clean, sf).select(names).cache()
    before, after = ({r.doc_id: r for r in x.collect()} for x in (clean, masked))
    assert before.keys() == after.keys()
    for d, r in after.items():
        assert r.n_chars == len(r.text) and not any(personal(r.text).values())
        if not any(personal(before[d].text).values()) and r.text != before[d].text:
            assert "[ID]" in r.text

    packed = stage["packing"](spark, masked, sf).collect()
    got: dict = {}
    for r in packed:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        got.setdefault(r.doc_id, []).append((r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()))
    want = library_pieces([(d, r.text) for d, r in after.items()], public_tokenizers.path("word_bpe_49k.json"))
    assert {d: [x for _, p in sorted(ps) for x in p] for d, ps in got.items()} == want


def test_run(spark, sf):
    home = Path(common.shared_dir(spark).removeprefix("file://"))
    before = set(os.listdir(home)) if home.exists() else set()
    out = corpus_pipeline.run(spark, sf)
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(home)) - before}
    assert left == {f"pipeline-{name}" for name, _ in corpus_pipeline.STAGES}
    fill = out.groupBy("sequence_id").sum("length").selectExpr("max(`sum(length)`)", "avg(`sum(length)`)").first()
    assert fill[0] <= 4096 and fill[1] > 3900


EDGES = [(None, "A text without an id, but with some words."), (None, None), (1, None), (2, ""), (3, "der die und das " * 40_000), (4, "The same words under an id of its own here"), (4, "Other words entirely, which share the id with them"), (4, "Other words entirely, which share the id with them"), (5, "mail me at a@b.co or not")]


def test_stages_on_edge_cases(spark, sf):
    """Null ids and texts, long texts, repeated ids, an empty table, and columns with names that operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, span_key string, `__key` string, `a.b` int, node_id int, kept boolean"
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 777.0, "mine", "k", "k2", 5, 6, None) for d, t in EDGES], schema)
    own = (777.0, "mine", "k", "k2", 5, 6, None)
    kept = {"language": [EDGES[i] for i in (0, 4, 5, 6, 7, 8)], "near_duplicates": [EDGES[i] for i in (0, 1, 2, 3, 4, 5, 6, 8)], "decontamination": EDGES, "personal_data": [*EDGES[:8], (5, "mail me at [EMAIL] or not")]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert sorted(map(str, ((r.doc_id, r.text) for r in rows))) == sorted(map(str, kept[name])), name
        assert {tuple(r)[5:] for r in rows} == {own} and all(r.n_chars == len(r.text or "") for r in rows), name
        assert stage(spark, docs.where("false"), sf).count() == 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == {None, 1, 2, 3, 4, 5} and sum(r.start == 0 for r in packed) == len(EDGES)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), sf).count() == 0
