"""Merkle manifest of a dataset, in blocks that are laid out after van Emde Boas.

A leaf is the digest of a row. The leaves of a source, by id, are the bottom of a tree in which every 16
consecutive nodes have one parent; the roots of all sources are the bottom of one more such tree. Trees
are built in aligned blocks of three levels: a block is one row, its nodes are one array, and its root is
a leaf of a block above, until one block is left. Inside a block the array holds the upper half of the
levels first and then the subtrees below it one after the other, each laid out alike. So the nodes of a
path lie close together at every scale, and a node's place follows from its level and number alone.

Blocks are grouped by Spark: a source with very many rows is very many blocks, and nothing but block
roots goes up, nothing but the siblings of block roots comes down.
"""

from __future__ import annotations

import hashlib
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanset.functions.keys import free_name
from gleanset.llm.rows import numbered, stored

#: Children of a node, bytes of a digest, and levels of a block above its bottom.
FAN, DIGEST, HEIGHT = 16, 32, 3


# --- layout ---------------------------------------------------------------------------------------


def tree_size(levels: int) -> int:
    """Nodes of a full tree with so many levels."""
    return (FAN**levels - 1) // (FAN - 1)


def address(levels: int, depth: int, number: np.ndarray) -> np.ndarray:
    """Places of the ``number``-th nodes at ``depth`` (the root is at 0) in a tree of ``levels``.

    The upper half of the levels is a tree at the front; below it hang ``FAN`` to the power of its levels
    trees of the other half. Each of them is laid out the same way.
    """
    if levels == 1:
        return np.zeros_like(number)
    upper = levels // 2
    if depth < upper:
        return address(upper, depth, number)
    below = FAN ** (depth - upper)
    lower = levels - upper
    return tree_size(upper) + number // below * tree_size(lower) + address(lower, depth - upper, number % below)


@cache
def places(levels: int, depth: int) -> np.ndarray:
    """:func:`address` of all nodes at a depth."""
    return address(levels, depth, np.arange(FAN**depth))


def levels_for(n: int) -> int:
    """Levels of the smallest tree with ``n`` leaves."""
    levels = 1
    while FAN ** (levels - 1) < n:
        levels += 1
    return levels


def digest(parts: bytes) -> bytes:
    return hashlib.sha256(parts).digest()


class Block:
    """A tree of few levels as one array in van Emde Boas order; nodes that do not exist are zeros."""

    def __init__(self, n: int, levels: int, nodes: bytes | bytearray):
        self.n, self.levels, self.nodes = n, levels, nodes
        # Nodes at each depth: every run of FAN has one parent.
        self.counts = [n]
        for _ in range(levels - 1):
            self.counts.insert(0, -(-self.counts[0] // FAN))

    @classmethod
    def build(cls, leaves: list[bytes], levels: int) -> Block:
        block = cls(len(leaves), levels, bytearray(DIGEST * tree_size(levels)))
        bottom = levels - 1
        for place, leaf in zip(places(levels, bottom).tolist(), leaves):
            block.nodes[place * DIGEST : (place + 1) * DIGEST] = leaf
        for depth in range(bottom - 1, -1, -1):
            to = places(levels, depth).tolist()
            for i in range(block.counts[depth]):
                block.nodes[to[i] * DIGEST : (to[i] + 1) * DIGEST] = digest(block.run(depth + 1, i))
        return block

    def run(self, depth: int, parent: int) -> bytes:
        """The children of a node, in hexadecimal."""
        at = places(self.levels, depth)[parent * FAN : min((parent + 1) * FAN, self.counts[depth])]
        return b"".join(self.nodes[a * DIGEST : (a + 1) * DIGEST].hex().encode() for a in at.tolist())

    @property
    def root(self) -> bytes:
        return bytes(self.nodes[:DIGEST])

    def runs(self, leaf: int) -> list[tuple[bytes, int]]:
        """From the bottom up, the run that the node above a leaf stands in, and its place there."""
        steps, number = [], leaf
        for depth in range(self.levels - 1, 0, -1):
            steps.append((self.run(depth, number // FAN), number % FAN))
            number //= FAN
        return steps


HEX = 2 * DIGEST


def siblings(run: bytes, place: int) -> bytes:
    return run[: place * HEX] + run[(place + 1) * HEX :]


def folded(node: bytes, path: list[tuple[bytes, int]]) -> bytes:
    """The root that a node leads to by its path: runs from the bottom up, the node's place in each."""
    for run, place in path:
        node = digest(run[: place * HEX] + node.hex().encode() + run[(place + 1) * HEX :])
    return node


def packed(path: list[tuple[bytes, int]]) -> bytes:
    return b"".join(bytes([place, len(run) // HEX]) + run for run, place in path)


def unpacked(data: bytes) -> list[tuple[bytes, int]]:
    path, at = [], 0
    while at < len(data):
        end = at + 2 + data[at + 1] * HEX
        path.append((data[at + 2 : end], data[at]))
        at = end
    return path


# --- leaves and places ------------------------------------------------------------------------------


def field(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]), 256))


def _placed(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` written with ``_place``, their number in their group by ``order``, from 0.

    One range shuffle sorts all rows, whatever group they are in. A place is then a row's number in its
    file less that of the group's first row there, plus the group's rows in files before.
    """
    parts = F.spark_partition_id().cast("long")
    ordered = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    ordered = stored(ordered.withColumns({"_part": parts, "_at": F.monotonically_increasing_id()}), name)
    counts = ordered.groupBy(group, "_part").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_rows"))
    # One row per group and file: files, plus groups, at most.
    counts = stored(counts, f"{name}-counts")
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.withColumn("_shift", F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_from"))
    shift = stored(shift.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), "_shift"), f"{name}-shift")
    joined = ordered.join(shift, ordered[group].eqNullSafe(shift["_group"]) & (F.col("_part") == F.col("_of")))
    return joined.withColumn("_place", F.col("_at") + F.col("_shift")).drop("_group", "_of", "_shift", "_part", "_at")


# --- trees ----------------------------------------------------------------------------------------

BLOCKS = "_tree bigint, _block bigint, _size bigint, _n int, _levels int, _nodes binary, _root binary"


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    """The blocks over ``_tree``, ``_place``, ``_size`` (nodes of the tree at this level) and ``_node``."""
    width = FAN**height

    def build(table: pa.Table) -> pa.Table:
        place = table["_place"].to_numpy()
        leaves = table["_node"].take(pa.array(np.argsort(place, kind="stable"))).to_pylist()
        tree, size = table["_tree"][0].as_py(), table["_size"][0].as_py()
        levels = height + 1 if size > width else levels_for(size)
        made = Block.build(leaves, levels)
        row = tree, int(place[0]) // width, size, len(leaves), levels, bytes(made.nodes), made.root
        types = pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()
        names = ["_tree", "_block", "_size", "_n", "_levels", "_nodes", "_root"]
        return pa.table({n: pa.array([v], t) for n, v, t in zip(names, row, types)})

    return nodes.withColumn("_block", F.expr(f"_place div {width}")).groupBy("_tree", "_block").applyInArrow(build, BLOCKS)


def _top(blocks: DataFrame, height: int) -> DataFrame:
    """The blocks that are all that is left of their tree."""
    return blocks.filter(f"_size <= {FAN**height}")


def _forest(nodes: DataFrame, name: str, height: int) -> tuple[list[DataFrame], DataFrame]:
    """All levels of blocks over the bottom nodes, each written, and ``_tree``, ``_root`` of every tree."""
    levels, width = [], FAN**height
    while True:
        levels.append(blocks := stored(_blocks(nodes, height), f"{name}-blocks-{len(levels)}"))
        # A tree of one block is done; the others go on with a node for each block.
        more = blocks.filter(f"_size > {width}")
        if more.isEmpty():
            break
        nodes = more.select(
            "_tree",
            F.col("_block").alias("_place"),
            F.expr(f"(_size + {width - 1}) div {width}").alias("_size"),
            F.col("_root").alias("_node"),
        )
    return levels, reduce(DataFrame.unionByName, [_top(blocks, height).select("_tree", "_root") for blocks in levels])


def _paths(levels: list[DataFrame], above: DataFrame, name: str, height: int) -> DataFrame:
    """``_tree``, ``_block``, ``_above`` for the bottom blocks: the packed path from a block's root to the
    root of all. ``above`` has ``_tree`` and ``_above`` for the roots of the trees."""
    paths = None
    for i in reversed(range(len(levels))):
        tops = _top(levels[i], height).select("_tree", "_block").join(above, "_tree")
        paths = stored(tops if paths is None else tops.unionByName(paths), f"{name}-paths-{i}")
        if i:
            paths = _down(levels[i].join(paths, ["_tree", "_block"]), height)
    return paths


def _down(blocks: DataFrame, height: int) -> DataFrame:
    """The paths of the blocks that stand at the bottom of these, whose own ``_above`` is known."""

    def walk(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["_n"], row["_levels"], row["_nodes"])
                first = row["_block"] * FAN**height
                above = [packed(block.runs(i)) + row["_above"] for i in range(row["_n"])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["_tree"]] * row["_n"], pa.int64()),
                        pa.array(range(first, first + row["_n"]), pa.int64()),
                        pa.array(above, pa.binary()),
                    ],
                    ["_tree", "_block", "_above"],
                )

    return blocks.select("_tree", "_block", "_n", "_levels", "_nodes", "_above").mapInArrow(
        walk, "_tree bigint, _block bigint, _above binary"
    )


PROOFS = "_row bigint, subroot string, root string, proof_sha256 string, folded_root string"


PROOF_NAMES = ["_row", "subroot", "root", "proof_sha256", "folded_root"]


def _proved(leaves: DataFrame, blocks: DataFrame, height: int) -> DataFrame:
    """For each leaf the digest of its siblings, and the root folded from its ``_seen`` leaf."""

    def prove(own: pa.Table, of: pa.Table) -> pa.Table:
        (row,) = of.to_pylist()
        block = Block(row["_n"], row["_levels"], row["_nodes"])
        above = unpacked(row["_above"])
        over = b"".join(siblings(run, place) for run, place in above)
        runs = {}  # of the block, each made once
        proofs, roots = [], []
        for place, seen in zip(own["_place"].to_pylist(), own["_seen"].to_pylist()):
            path, number = [], place % FAN**height
            for depth in range(block.levels - 1, 0, -1):
                parent = number // FAN
                if (depth, parent) not in runs:
                    runs[depth, parent] = block.run(depth, parent)
                path.append((runs[depth, parent], number % FAN))
                number = parent
            seal = hashlib.sha256()
            for run, at in path:
                seal.update(siblings(run, at))
            seal.update(over)
            proofs.append(seal.hexdigest())
            roots.append(folded(seen, path + above).hex())
        # The last ``_steps`` runs are those of the tree of trees; what stands below them is the tree's root.
        inner = len(above) - row["_steps"]
        subroot = folded(block.root, above[:inner])
        root = folded(subroot, above[inner:]).hex()
        n = len(proofs)
        columns = [[subroot.hex()] * n, [root] * n, proofs, roots]
        return pa.table([own["_row"], *[pa.array(c, pa.string()) for c in columns]], names=PROOF_NAMES)

    return leaves.groupBy("_tree", "_block").cogroup(blocks.groupBy("_tree", "_block")).applyInArrow(prove, PROOFS)


def manifest(
    docs: DataFrame,
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    group: str = "source",
    id_col: str = "doc_id",
    seen: dict[str, Column] | None = None,
    height: int = HEIGHT,
) -> DataFrame:
    """One row per row of ``docs``: ``_row``, id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``,
    ``folded_root`` and ``verified``. ``proof_sha256`` is the digest of all siblings, from the bottom up.

    A leaf is the digest of ``columns``. ``seen`` replaces columns by what a reader sees of the rows (by
    default what is there): the root is folded from those leaves with the siblings of the manifest, so
    ``verified`` tells whether a row is as it was recorded. Rows of a group ascend by id (null first);
    rows of one id by their leaf, equal leaves as the table is read, which changes no digest. A null
    group is a group, the first one. An empty table gives no rows; columns that are not named are not
    read, and a column called like one of the operator's own does no harm. ``docs`` is a table, see
    :func:`rows.numbered`. Texts are hashed where they are read and do not travel. ``height`` is that of a
    block and changes no digest. A path above a block is kept once a block, some KB, so groups should be
    far fewer than rows.
    """
    now = {c: (seen or {}).get(c, F.col(c)) for c in columns}
    row = free_name(docs, "_row")
    rows = numbered(docs, row).select(
        F.col(row).alias("_row"),
        F.col(group).cast("string").alias("_group_key"),
        F.col(id_col).alias("_id"),
        leaf_of([F.col(c) for c in columns]).alias("_leaf"),
        leaf_of(list(now.values())).alias("_seen"),
    )
    # Written first: the range shuffle looks at its rows twice, and texts are hashed once.
    rows = stored(rows, "leaf-rows")
    leaves = stored(_placed(rows, "_group_key", ["_id", "_leaf", "_row"], "leaves"), "placed-leaves")
    # The trees: one row per group, numbered in the order of the groups.
    groups = leaves.groupBy("_group_key").agg(F.count(F.lit(1)).alias("_size"))
    trees = _placed(groups.withColumn("_all", F.lit(0)), "_all", ["_group_key"], "groups")
    trees = stored(trees.select(F.col("_group_key").alias("_name"), "_size", F.col("_place").alias("_tree")), "trees")
    leaves = leaves.join(trees, leaves["_group_key"].eqNullSafe(trees["_name"]))
    leaves = stored(leaves.select("_row", "_id", "_leaf", "_seen", "_tree", "_place", "_size"), "leaves-of-trees")
    levels, roots = _forest(leaves.select("_tree", "_place", "_size", F.col("_leaf").alias("_node")), "leaf", height)
    roots = stored(roots, "subroots")
    n_trees = roots.count()
    top = roots.select(
        F.lit(0).cast("bigint").alias("_tree"),
        F.col("_tree").alias("_place"),
        F.lit(n_trees).cast("bigint").alias("_size"),
        F.col("_root").alias("_node"),
    )
    top_levels, one = _forest(top, "top", height)
    of_tops = _paths(top_levels, one.select("_tree", F.lit(b"").alias("_above")), "top", height)
    # The bottom nodes of the tree of trees are the trees.
    of_trees = _down(top_levels[0].join(of_tops, ["_tree", "_block"]), height)
    of_trees = stored(of_trees.select(F.col("_block").alias("_tree"), "_above"), "tree-paths")
    paths = _paths(levels, of_trees, "leaf", height)
    steps = F.lit(levels_for(n_trees) - 1)
    bottom = levels[0].join(paths, ["_tree", "_block"]).withColumn("_steps", steps)
    own = leaves.select("_tree", F.expr(f"_place div {FAN**height}").alias("_block"), "_row", "_place", "_seen")
    return (
        leaves.select("_row", F.col("_id").alias(id_col), F.lower(F.hex("_leaf")).alias("leaf"))
        .join(stored(_proved(own, bottom, height), "proofs"), "_row")
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )
