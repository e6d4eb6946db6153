"""Texts, pages and tables that nobody would write: long, odd, empty, with clashing names and repeated rows."""

from __future__ import annotations

import os
import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleanset.llm import (
    decontaminate,
    exact_dedup,
    fim,
    html_main,
    html_pages,
    license_scan,
    merkle,
    packing,
    pii,
    pretokens,
    quality_crf,
    simhash_vptree,
    suffix_dedup,
    token_counts,
    token_files,
)
from gleanset.session import scratch_path

sys.path.insert(0, os.path.dirname(__file__))
from test_llm import ODD, table

SF = "/root/testdata/sf0.001"

#: Names that operators use for columns of their own, with a value that tells the row.
NAMES = "_row _quality _matches _judged _between _id _text _key0 _page _print _digit _bytes _spans found".split()


def clashing(spark, texts, tmp_path, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, *(k * 1000 + n for n in range(len(NAMES)))) for k, (i, t) in enumerate(zip(ids, texts))]
    path = str(tmp_path / "clash")
    schema = "doc_id bigint, text string, " + ", ".join(f"{n} bigint" for n in NAMES)
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path), {r[2]: r for r in rows}


def labels_for(spark, ids):
    return spark.createDataFrame([(i, i % 2, 0) for i in ids], "doc_id bigint, quality int, toxic int")


def test_drops_give_every_column_back_as_it_was(spark, tmp_path):
    texts = [*ODD, *(f"some words in document number {i} that are its own" for i in range(20))]
    docs, rows = clashing(spark, texts, tmp_path)
    benchmark = spark.createDataFrame([(1, texts[-1])], "item_id bigint, text string")
    kept = {
        "exact": exact_dedup.drop_exact_copies(docs),
        "near": simhash_vptree.drop_near_copies(docs),
        "clean": decontaminate.drop_contaminated(docs, benchmark),
        "good": quality_crf.drop_low_quality(docs, labels_for(spark, range(12, 31)), threshold=0.0),
    }
    for name, df in kept.items():
        assert df.columns == docs.columns, name
        got = df.collect()
        assert got and all(tuple(r) == rows[r["_row"]] for r in got), name
    assert kept["good"].count() == len(texts) and kept["clean"].count() == len(texts) - 1


def test_pseudonyms_give_every_other_column_back(spark, tmp_path):
    docs, rows = clashing(spark, ["4111 1111 1111 1111", "x", None], tmp_path)
    for df in (pii.pseudonymise(docs, "k"), pii.pseudonymise(docs, "k", found_col="hits")):
        others = [c for c in docs.columns if c not in ("text", "found")]
        assert [c for c in df.columns if c in others] == others
        for r in df.collect():
            want = dict(zip(docs.columns, rows[r["_row"]]))
            assert all(r[c] == want[c] for c in others)
            assert (r.text == want["text"]) != (want["text"] is not None and "4" in want["text"])


def test_null_and_repeated_ids_and_repeated_rows(spark, tmp_path):
    texts = ["same text here", "same text here", "other words", "other words", None, ""]
    ids = [None, 3, 3, 3, None, 3]  # an id that may be trained on
    docs = table(spark, texts, tmp_path, ids=ids)
    library = pretokens.load("word_bpe_49k.json")
    counts = token_counts.count_tokens(docs).collect()
    want = [(i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in zip(ids, texts)]
    assert sorted(map(repr, ((r.doc_id, r.n_tokens) for r in counts))) == sorted(map(repr, want))
    pieces = packing.pack_documents(docs).collect()
    assert sum(r.length for r in pieces) == sum(n + 1 for _, n in want) and len(pieces) == len(texts)
    benchmark = spark.createDataFrame([(1, "other words"), (1, "other words"), (None, "same text here")], "item_id bigint, text string")
    found = decontaminate.find_contamination(docs, benchmark).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_hit, r["items"]) for r in found))) == sorted(
        map(repr, [(None, 3, []), (3, 3, []), (3, 2, ["1"]), (3, 2, ["1"]), (None, 0, []), (3, 0, [])])
    )
    repeated = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id bigint, quality int, toxic int")
    assert quality_crf.train(docs, repeated) == 1.0  # the largest label of an id
    scored = quality_crf.with_scores(docs, 0.5).collect()
    assert len(scored) == len(texts)
    pages = spark.createDataFrame([(1, "u", "<article><p>One. Two three.</p></article>")] * 2 + [(None, None, None)], "page_id long, url string, html string")
    texts_of = [r.main_text for r in html_main.extract_main_text(pages, html_pages.trained()).collect()]
    assert texts_of[0] == texts_of[1] and texts_of[2] == ""


def test_empty_tables(spark, tmp_path):
    docs = table(spark, ["x"], tmp_path).filter("doc_id > 5")
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    some = table(spark, ["a b c d", "x"], tmp_path, "some")
    for df in (
        token_counts.count_tokens(docs),
        pii.pseudonymise(docs, "k"),
        license_scan.scan_licenses(docs),
        packing.pack_documents(docs),
        decontaminate.find_contamination(docs, benchmark),
        exact_dedup.exact_groups(docs),
        simhash_vptree.near_groups(docs),
        fim.fill_in_middle(docs),
        suffix_dedup.without_repeats(docs),
        exact_dedup.drop_exact_copies(docs),
        simhash_vptree.drop_near_copies(docs),
        decontaminate.drop_contaminated(docs, benchmark),
        quality_crf.drop_low_quality(docs, labels_for(spark, [1, 2])),
    ):
        assert df.collect() == []
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_main.extract_main_text(pages, html_pages.trained()).collect() == []
    none = benchmark.filter("item_id > 5")
    assert decontaminate.drop_contaminated(some, none).count() == 2


def test_stages_on_an_odd_table(spark, tmp_path):
    """Nulls, repeated ids, extra and clashing columns go through every stage; an empty table too."""
    texts = [*ODD, *(f"this is a line of document {i}, with words of its own in it.\n" * 3 for i in range(20))]
    ids = [None, None, 3, 3, *range(4, len(texts))]
    rows = [(i, t, "en", "s", None, k, 1.5) for k, (i, t) in enumerate(zip(ids, texts))]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row bigint, _quality double"
    folder = tmp_path / "sf"
    spark.createDataFrame(rows, schema).write.parquet(str(folder / "documents.parquet"))
    labels_for(spark, range(11, 31)).write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame([(1, "words of its own in it this is a line of document")], "item_id bigint, text string").write.parquet(
        str(folder / "benchmark.parquet")
    )
    for empty in (False, True):
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        docs = docs.filter("_row < 0") if empty else docs
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{empty}-{i}")
            stage(spark, docs, str(folder)).write.parquet(path)
            out = spark.read.parquet(path)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns, name
                assert all(tuple(r) == rows[r["_row"]] for r in out.collect()), name
                docs = out
            assert (out.count() == 0) or not empty


# --- texts that used to end or stall a task -------------------------------------------------------


def within(seconds, started):
    assert time.time() - started < seconds


def test_pseudonyms_of_hostile_texts(spark, tmp_path):
    n = 10**6
    texts = [
        "a@" + "b." * n + "com",
        "a@" + "bb." * n,
        "a" * n + "@",
        "1." * n,
        "+1 " * n,
        "1-" * n,
        "GB29 " + "NWBK " * n,
        "4111 " * n,
        "(017) " * n,
        "2024-01-" * n,
        "x@" * n,
    ]
    started = time.time()
    df = pii.pseudonymise(table(spark, texts, tmp_path), "k")
    got = {r.doc_id: (r.n, r.m) for r in df.select("doc_id", F.length("text").alias("n"), F.size("found").alias("m")).collect()}
    assert set(got) == set(range(len(texts))) and got[4][0] == 3 * n
    within(240, started)


def test_pseudonyms_of_very_many_values_in_one_text(spark, tmp_path):
    text = "mail a.b@example.org or 4111 1111 1111 1111; " * 3000
    (row,) = pii.pseudonymise(table(spark, [text], tmp_path), "k").collect()
    assert len(row.found) == 6000
    out, at = "", 0
    for f in row.found:
        out += text[at : f.start] + f.pseudonym
        at = f.start + f.length
    assert out + text[at:] == row.text


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 350_000,
        "<a " * 350_000 + '<b c=">"',
        "<i><div>" + "<b>" * 150_000 + "</i>" * 150_000,
        "<div>" * 200_000 + "x",
        "<a x='" * 150_000 + ">",
        "<textarea>" * 100_000,
        "</script " * 100_000 + "<script>" + "</script " * 50_000 + ">",
        "<" * 1_000_000,
        "<p>x" * 250_000,
        "<b><p>" * 100_000 + "<h2></h2>" * 50_000,
        "<!--" * 250_000,
        "&" * 1_000_000,
    ],
)
def test_pages_of_a_megabyte_take_seconds(page):
    model, started = html_pages.trained(), time.time()
    nodes = html_main.tree(page)
    html_main.text_of(nodes, model.content([html_main.features(nodes)])[0])
    within(15, started)


SENTENCES = "The committee met on Tuesday to discuss the new plan. Members agreed that more work is needed."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article><h1>Bridge</h1><p title=don't>{SENTENCES}</p><p>It isn't over.</p></article>", ["Bridge", SENTENCES, "It isn't over."]),
        (f"<article><h1>Bridge</h1><p title=\"a > b\" class=x>{SENTENCES}</p></article>", ["Bridge", SENTENCES]),
        (f"<article><h1>Bridge</h1><p>{SENTENCES}</p></article><div class=\"foo", ["Bridge", SENTENCES]),
        (
            f"<nav><ul><li><a href=/>Home</a></li></ul></nav><article><header><h1>Bridge opens again</h1></header><p>{SENTENCES}</p>"
            f"<p>{SENTENCES}</p></article><footer><p>&copy; 2024 Company</p></footer>",
            ["Bridge opens again", SENTENCES, SENTENCES],
        ),
        (
            f"<article><h1>Bridge opens again</h1><p class='tags-intro'>{SENTENCES}</p><p>{SENTENCES}</p></article>"
            "<aside class=sidebar><p>Other stories today.</p></aside>",
            ["Bridge opens again", SENTENCES, SENTENCES],
        ),
        (
            f"<header><h1>Daily Site</h1></header><article><h1>Bridge opens again</h1><p>{SENTENCES}</p><div class='share'>Share this</div>"
            f"<pre>code x = 1;</pre><figure><img><figcaption>The bridge at night.</figcaption></figure></article>"
            f"<section class=comments><p>{SENTENCES}</p></section>",
            ["Bridge opens again", SENTENCES, "code x = 1;", "The bridge at night."],
        ),
        (
            f"<article><h1>Bridge opens again</h1><p>{SENTENCES}</p><p class='ad'>Buy now and save money.</p><p>{SENTENCES}</p></article>",
            ["Bridge opens again", SENTENCES, SENTENCES],
        ),
    ],
)
def test_hand_written_pages(page, want):
    nodes = html_main.tree(f"<!DOCTYPE html><html><head><title>T</title></head><body>{page}")
    found = html_main.text_of(nodes, html_pages.trained().content([html_main.features(nodes)])[0])
    assert found.split("\n") == want


def test_page_depth_is_bounded_and_keeps_the_text():
    nodes = html_main.tree("<div>" * 2000 + "<p>a</p><p>b</p>" + "</div>" * 2000 + "c")
    assert len(nodes) <= html_main.DEEPEST + 1
    assert [t for node in nodes for _, t in sorted(node.texts)] and " ".join(
        t for _, t in sorted(x for node in nodes for x in node.texts)
    ) == "a b c"


@pytest.fixture(scope="module")
def line_model(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return quality_crf.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)


@pytest.mark.parametrize("name", ["a million lines", "one line", "one word", "prose"])
def test_quality_of_very_long_texts(line_model, name):
    text = {
        "a million lines": "a b c\n" * 1_000_000,
        "one line": "word and another " * 3_000_000,
        "one word": "é" * 25_000_000,
        "prose": ("Some words in a line of text that is usual, and more of it. " * 20 + "\n") * 42_000,
    }[name]
    started = time.time()
    (score,) = line_model.scores(quality_crf.features_of([text]))
    assert 0 <= score <= 1
    within(60, started)


def test_pieces_of_a_text_measure_as_the_whole(monkeypatch):
    text = "\n".join("word " * (k % 9) + ("x" if k % 3 else "y z.") for k in range(3000)) + "\n"
    (whole,) = quality_crf.features_of([text])
    monkeypatch.setattr(quality_crf, "PIECE", 700)
    (pieces,) = quality_crf.features_of([text])
    assert np.array_equal(whole[0], pieces[0]) and np.array_equal(whole[1], pieces[1])
    (cut,) = quality_crf.features_of(["some words " * 500])
    monkeypatch.undo()
    (full,) = quality_crf.features_of(["some words " * 500])
    assert cut[1] == full[1] and np.allclose(cut[0][0][1:9], full[0][0][1:9], atol=0.02)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 5000])
def test_long_chains_in_blocks_equal_the_plain_pass(n):
    rng = np.random.default_rng(n)
    model = quality_crf.LineCrf(None, None, None, None, rng.normal(size=(2, 2)))
    unary = rng.normal(size=n) * 3
    plain = model.marginals(unary[None], np.array([n]))[0][0]
    assert np.allclose(plain, model.long_marginals(unary), atol=1e-8)


def test_training_lines_are_bounded(spark, tmp_path, monkeypatch):
    docs = table(spark, ["good words here.\n" * 50 if i % 2 else "x#\n" * 50 for i in range(60)], tmp_path)
    labels = labels_for(spark, range(60))
    seen = []
    monkeypatch.setattr(quality_crf, "fit", lambda features, lengths, y: seen.append([len(f) for f in features]))
    quality_crf.train(docs, labels, train_total=500)
    quality_crf.train(docs, labels)
    assert sum(seen[0]) <= 500 < sum(seen[0]) + 51 and len(seen[1]) > len(seen[0])
    assert quality_crf.train(docs, labels, train_total=10) == 0.5


def test_exact_groups_shuffle_open_rows_only(spark, tmp_path, monkeypatch):
    """With many keys nothing is broadcast; texts that have no like are kept out of the shuffle."""
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", 0)
    texts = [f"{i} " + "text of its own " * 20 for i in range(400)] + ["copy of a long text " * 20] * 7 + ["short"] * 3
    docs = table(spark, texts, tmp_path)
    rows = docs.selectExpr("doc_id AS _id", "length(text) AS _bytes", "encode(substr(text, 1, 64), 'UTF-8') AS _digit")
    keys = rows.groupBy("_bytes", "_digit").count().filter("count > 1")
    keys.write.parquet(str(tmp_path / "keys"))
    passed = exact_dedup._passing(rows, spark.read.parquet(str(tmp_path / "keys")), ["_bytes", "_digit"])
    ids = {r["_id"] for r in passed.collect()}
    assert ids >= set(range(400, 410)) and len(ids) <= 12
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()}
    assert got[0] == (0, 1, True) and got[403] == (406, 7, False) and got[406] == (406, 7, True) and got[409] == (409, 3, True)


def test_stores_of_null_and_repeated_ids(spark, tmp_path):
    path = scratch_path(spark, "odd-store")
    token_files.write_store(table(spark, ["b", "a", "c", None], tmp_path, ids=[None, 4, 4, 4]), path)
    rows = token_files.read_store(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 4, 4, 4] and sorted(r.n_tokens for r in rows[1:]) == [1, 2, 2]


def test_manifest_of_columns_with_clashing_names(spark, tmp_path):
    docs, _ = clashing(spark, ["x", "y", None], tmp_path)
    docs = docs.withColumn("source", F.lit("s"))
    made = merkle.manifest(docs, ("doc_id", "text", "_row"), "source").collect()
    assert len(made) == 3 and all(r.verified for r in made)
