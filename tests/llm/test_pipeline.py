"""The pipeline, stage by stage, against plain Python."""

from __future__ import annotations

import os
import sys

import numpy as np

import corpus_pipeline
from gleanset.llm import pretokens
sys.path.insert(0, os.path.dirname(__file__))
from test_llm import check_packing, exact_by_hand, hits, linked_by_hand, print_by_hand

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, held = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            held.append({r.doc_id: r.text for r in docs.collect()})
    good, single, far, clean = held
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    start = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(good) <= start
    assert np.mean([(i in good) == bool(q) for i, q in labels.items()]) > 0.9
    wanted = exact_by_hand(good.values(), good.keys())
    assert set(single) == {i for i, (_, _, kept) in wanted.items() if kept}
    ids = sorted(single)
    roots = linked_by_hand([print_by_hand(single[i]) for i in ids])
    assert set(far) == {ids[r] for r in roots}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(clean) == {i for i, t in far.items() if not hits(t, items)[1]} and len(clean) < len(far)
    library = pretokens.load("word_bpe_49k.json")
    want = {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in clean.items()}
    rows = docs.collect()
    assert sum(r.length for r in rows) == sum(map(len, want.values()))
    assert {r.doc_id for r in rows} == set(clean)
    again = corpus_pipeline.packing.pack_documents(spark.read.parquet(str(tmp_path / "3"))).collect()
    check_packing(again, want, 4096)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
