"""Fill-in-middle against slicing and a regular expression."""

from __future__ import annotations

import hashlib
import os
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanset.llm import fim

sys.path.insert(0, os.path.dirname(__file__))
from test_llm import ODD, table

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [
    *ODD,
    " lead and trail \n",
    "has <M> inside",
    "almost <P <S <M",
    "P>S>M> <",
    "日本 <語 x> ½½ 👩‍👩‍👧 ends é",
    "no-break\xa0space\x85and　wide",
    "x",
    "\t",
]


def by_hand(key, text, unit="token", rate=50, spm_rate=80):
    text = text or ""
    units = TOKEN.findall(text) if unit == "token" else list(text)
    n = len(units)
    hexed = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["token", "char"])
def test_every_form_against_slices(spark, tmp_path, unit):
    texts = TEXTS * 8
    ids = [None, 7, 7, *range(len(texts) - 3)]
    docs = table(spark, texts, tmp_path, ids=ids)
    for rate, spm in ((50, 80), (100, 30)):
        made = fim.fill_in_middle(docs, unit, rate, spm)
        assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        got = sorted(map(repr, (tuple(r) for r in made.collect())))
        assert got == sorted(repr((i, *by_hand(i, t, unit, rate, spm))) for i, t in zip(ids, texts))
        back = made.select(fim.restored(F.col("output"), F.col("form")).alias("t")).collect()
        assert sorted(r.t for r in back) == sorted(t or "" for t in texts)
    assert {by_hand(i, t, unit)[1] for i, t in zip(ids, texts)} == {"plain", "psm", "spm"}


def test_cuts_of_long_and_mixed_texts(monkeypatch):
    rng = np.random.default_rng(5)
    pieces = ["a", " ", "é", "日", "👩", "\t", "word", "½"]
    monkeypatch.setattr(fim, "SLICE", 37)
    for _ in range(30):
        text = "".join(rng.choice(pieces, 300))
        data = np.frombuffer(text.encode(), np.uint8)
        index, tokens, units = fim.Exceptions.of(data), fim.Tokens(data), TOKEN.findall(text)
        assert len(index.at) == sum(ord(c) > 127 for c in text)
        assert (tokens.n, index.total(len(data))) == (len(units), len(text))
        for point in range(0, len(text) + 1, 7):
            byte = len(text[:point].encode())
            assert (index.to_byte(point), index.to_point(byte)) == (byte, point)
        for k in range(0, tokens.n + 1, 5):
            assert tokens.cut(k) == len("".join(units[:k]).encode())


def test_a_very_long_text_and_an_empty_table(spark, tmp_path):
    long = "слово word " * 2_000_000
    made = fim.fill_in_middle(table(spark, [long], tmp_path, ids=[3]), rate=100).collect()
    assert tuple(made[0]) == (3, *by_hand(3, long, rate=100))
    empty = table(spark, ["x"], tmp_path, "none").filter("doc_id > 5")
    assert fim.fill_in_middle(empty).collect() == []


def test_unknown_units_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="unit"):
        fim.fill_in_middle(table(spark, ["x"], tmp_path), "word")
