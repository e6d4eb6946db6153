"""The Merkle manifest against a tree of lists."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanset.llm import merkle, queries

SF = "/root/testdata/sf0.001"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 16])) for i in range(0, len(below), 16)])
    return levels


def path(levels, i):
    for nodes in levels[:-1]:
        run = i // 16 * 16
        yield nodes[run : run + 16], i - run
        i //= 16


def lowered(text):
    return text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def by_hand(rows, tampered):
    """rows: (doc_id, source, lang, n_chars, text), several of one id allowed. -> sorted result rows."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in names}
    trees = {s: tree([leaf(r) for r in ordered[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for i, row in enumerate(ordered[s]):
            steps = [*path(trees[s], i), *path(top, j)]
            node = leaf((*row[:4], lowered(row[4]))) if tampered(row[0]) else leaf(row)
            for run, at in steps:
                node = sha("".join([*run[:at], node, *run[at + 1 :]]))
            proof = sha("".join("".join(run[:at] + run[at + 1 :]) for run, at in steps))
            root = top[-1][0]
            out.append((row[0], leaf(row), trees[s][-1][0], root, proof, node, node == root))
    return sorted(map(repr, out))


def got(df):
    return sorted(
        repr(tuple(r))
        for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    )


def test_layout_holds_every_node_once_and_halves():
    for levels in range(1, 5):
        seen = np.concatenate([merkle.places(levels, d) for d in range(levels)])
        assert sorted(seen.tolist()) == list(range(merkle.tree_size(levels)))
    # Four levels: the upper two first, then trees of two levels, each together.
    assert merkle.places(4, 1).tolist() == list(range(1, 17))
    children = merkle.places(4, 3)[16 * 5 : 16 * 6]
    assert children.tolist() == list(range(merkle.places(4, 2)[5] + 1, merkle.places(4, 2)[5] + 17))


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 300])
def test_blocks_and_paths(n):
    leaves = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(n)]
    levels = tree([x.hex() for x in leaves])
    block = merkle.Block.build(leaves, merkle.levels_for(n))
    assert block.root.hex() == levels[-1][0]
    for i in range(0, n, 13):
        steps = block.runs(i)
        assert [(run.decode(), at) for run, at in steps] == [("".join(run), at) for run, at in path(levels, i)]
        assert merkle.folded(leaves[i], merkle.unpacked(merkle.packed(steps))) == block.root


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, _row bigint, _tree string"


def rows_of(counts):
    rows, k = [], 0
    for source, n in counts.items():
        for _ in range(n):
            rows.append((k * 7 % 1000, source, None if k % 5 else "en", k, [None, "", f"Text {k} É", "ABC"][k % 4]))
            k += 1
    return rows


@pytest.mark.parametrize("height", [1, 2, 3])
def test_manifest_against_lists(spark, tmp_path, height):
    rows = rows_of({"hot": 700, "b": 17, None: 3, "é": 1, "": 2, "Z": 256, **{f"s{i}": 1 for i in range(20)}})
    rows += [(None, "b", "en", None, None), (3, "hot", "en", 4, "same"), (3, "hot", "en", 4, "same")]
    path_ = str(tmp_path / "docs")
    spark.createDataFrame([(*r, 9, "x") for r in rows], SCHEMA).repartition(5).write.parquet(path_)
    docs = spark.read.parquet(path_)
    tampered = F.col("doc_id") % 3 == 0
    seen = F.when(tampered, queries.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    made = merkle.manifest(docs, seen={"text": seen}, height=height)
    assert got(made) == by_hand(rows, lambda i: i is not None and i % 3 == 0)
    assert got(merkle.manifest(docs, height=height)) == by_hand(rows, lambda i: False)


def test_empty_and_single(spark, tmp_path):
    spark.createDataFrame([(1, "s", "en", 2, "x", 0, "")], SCHEMA).write.parquet(str(tmp_path / "one"))
    docs = spark.read.parquet(str(tmp_path / "one"))
    assert got(merkle.manifest(docs)) == by_hand([(1, "s", "en", 2, "x")], lambda i: False)
    assert merkle.manifest(docs.filter("doc_id > 1")).collect() == []


def test_query(spark):
    import zlib

    rows = [
        tuple(r)
        for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    ]
    made = queries.op13_merkle_manifest(spark, SF)
    assert got(made) == by_hand(rows, lambda i: zlib.crc32(str(i).encode()) % 5 == 0)
    assert made.filter("NOT verified").count() > 0
