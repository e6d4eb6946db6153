"""Removal of repeated strings against a dictionary of all windows."""

from __future__ import annotations

import os
import sys

import numpy as np
import pytest

from gleanset.llm import queries, suffix_blocks, suffix_dedup

sys.path.insert(0, os.path.dirname(__file__))
from test_llm import ODD, table

SF = "/root/testdata/sf0.001"


def by_hand(texts, length):
    """(bytes, removed, spans, kept) of every text."""
    import hashlib

    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - length + 1):
            h = hashlib.md5(d[i : i + length]).digest()
            seen[h] = seen.get(h, 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, np.int64)
        for i in range(len(d) - length + 1):
            if seen[hashlib.md5(d[i : i + length]).digest()] > 1:
                gone[i] += 1
                gone[min(i + length, len(d))] -= 1
        gone = np.cumsum(gone)[: len(d)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


def got(df):
    rows = df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    return sorted((repr(r.doc_id), (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in rows)


def wanted(ids, texts, length):
    return sorted((repr(i), w) for i, w in zip(ids, by_hand(texts, length)))


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdeé"), rng.integers(2, 9))) for _ in range(n))


def corpus(rng):
    line, passage = prose(rng, 20), prose(rng, 120)
    texts = [prose(rng, 60) for _ in range(30)]
    texts += [prose(rng, 30) + line + prose(rng, 30) for _ in range(40)]
    texts += [prose(rng, k) + passage[k:] + prose(rng, 5) for k in range(0, 60, 3)]
    texts += [texts[0]] * 5 + [texts[1] + "!"] * 3 + [passage, passage + line, "x" + passage[:250]]
    texts += ["-" * 3000, "-" * 199, "-" * 200, "-" * 201, "ab" * 900, ("0123456" * 400)[:2000]]
    return [*texts, *ODD]


def test_cover_takes_any_two_remainders_into_the_sample():
    assert suffix_blocks.SHIFT.min() >= 0
    assert set(suffix_blocks.NUMBER[suffix_blocks.NUMBER >= 0]) == set(range(len(suffix_blocks.COVER)))


@pytest.mark.parametrize("length", [63, 64, 95, 96, 128, 200, 333])
@pytest.mark.parametrize("bucket", [50, 1 << 18])
def test_sorter_against_sets(length, bucket):
    rng = np.random.default_rng(length)
    block = rng.integers(0, 3, 700, dtype=np.uint8)
    text = np.concatenate([block, rng.integers(0, 3, 300, dtype=np.uint8), block[100:], np.zeros(800, np.uint8), block[:400]])
    text[1500] ^= 1
    at = np.arange(0, len(text) - length + 1)
    sorter = suffix_blocks.Sorter(text, length)
    windows = [text[i : i + length].tobytes() for i in at]
    want = [windows.count(w) > 1 for w in windows]
    assert sorter.repeated(at, bucket).tolist() == want
    with pytest.raises(ValueError):
        suffix_blocks.Sorter(text, 62)


def test_segments_hold_every_window_once_and_equal_windows_share_a_bucket(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 97)
    monkeypatch.setattr(suffix_dedup, "PIECE", 60)
    rng = np.random.default_rng(1)
    texts = [t.encode() for t in corpus(rng) if t]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    grams, bucket, counted = suffix_dedup.Grams(64), {}, {}
    seen = set()
    for text, h, first, last, many in zip(*suffix_dedup.segments_of(data, offsets, 200, grams)):
        counted[h] = counted.get(h, 0) + many
        for i in range(first, last + 1):
            assert (text, i) not in seen
            seen.add((text, i))
            bucket.setdefault(texts[text][i : i + 200], []).append(h)
    assert len(seen) == sum(max(0, len(t) - 199) for t in texts)
    for hashes in bucket.values():
        assert len(set(hashes)) == 1
        assert len(hashes) == 1 or counted[hashes[0]] > 1


@pytest.mark.parametrize(("shard", "large"), [(4_000_000, 8_000_000), (3_000, 2_000)])
def test_against_all_windows(spark, tmp_path, shard, large):
    """With small shards and buckets the frequent line is dealt anew, down to single windows."""
    texts = corpus(np.random.default_rng(3))
    ids = [None, None, 5, 5, *range(4, len(texts))]
    docs = table(spark, texts, tmp_path, ids=ids)
    made = suffix_dedup.without_repeats(docs, shard=shard, large=large)
    assert got(made) == wanted(ids, texts, 200)
    made = suffix_dedup.without_repeats(docs, 100, shard=shard, large=large)
    assert got(made) == wanted(ids, texts, 100)


def test_empty_and_unrepeated(spark, tmp_path):
    docs = table(spark, ["", None, "short", prose(np.random.default_rng(2), 90)], tmp_path)
    assert [r.n_removed for r in suffix_dedup.without_repeats(docs).collect()] == [0] * 4
    assert suffix_dedup.without_repeats(docs.filter("doc_id > 9")).collect() == []


def test_very_long_texts(spark, tmp_path):
    rng = np.random.default_rng(4)
    long = prose(rng, 400_000)
    texts = [long, "start " + long[1_000_000:1_500_000], "=" * 5_000_000]
    made = {r.doc_id: r for r in suffix_dedup.without_repeats(table(spark, texts, tmp_path)).collect()}
    shared = len(long[1_000_000:1_500_000].encode())
    assert abs(made[0].n_removed - shared) < 4 and made[0].n_spans == 1
    assert len(made[1].kept) < 10 and len(made[2].kept) == 0


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    import hashlib

    want = {r.doc_id: w for r, w in zip(rows, by_hand([r.text for r in rows], 200))}
    for r in queries.op12_repeated_bytes(spark, SF).collect():
        n, gone, spans, kept = want.pop(r.doc_id)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, spans, hashlib.sha256(kept).hexdigest())
    assert not want
