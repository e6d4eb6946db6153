"""Near-duplicate groups by SimHash, with the exact pairs found through vantage-point trees.

A fingerprint has 64 bits, one per bit set in over half of the hashes of a text's word shingles. Copies
share a fingerprint, so links are sought among the different fingerprints only. A vantage-point tree
deals them out: at each node those within a radius of the node's vantage point go inside, the others
outside, and by the triangle bound only fingerprints at most ``distance`` beyond the radius can have a
partner inside; they are sent there as well. So every linked pair meets in a shard, whatever vantage
points were chosen; a bounded sample chooses them only for balance. Inside a shard the same tree goes
on in memory. A shard gives the links of a spanning forest, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanset.llm.components import components
from gleanset.llm.rows import numbered, stored, without_rows

#: Fingerprints wanted in a shard; a shard with more than two of these is dealt over pairs of blocks of this size.
SHARD = 65_536
#: Shards wanted for each core where that takes smaller ones, and the smallest that are worth it.
PER_CORE, SMALL = 2, 16_384
#: Fingerprints that choose vantage points (about), and the levels of the tree at most.
SAMPLE, LEVELS = 100_000, 16
#: The share of a node's fingerprints that each side gets about, those sent to both sides included.
SHRINK = 0.65
#: Below so many fingerprints all pairs are compared.
LEAF = 1024
#: Shingles whose bits are counted at a time.
COUNTED = 200_000


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of a text in UTF-8; A-Z is lower-cased, words are split at ASCII white space."""
    import xxhash

    words = text.lower().split()
    n = len(words) - width + 1
    if not words:
        return 0
    if n < 1:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for done in range(0, n, COUNTED):
        k = min(COUNTED, n - done)
        hashes = np.fromiter((digest(next(shingles), 42) for _ in range(k)), "<u8", k)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(k, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``_row``, ``_id`` and ``_print`` (the fingerprint as a signed long) of every row."""
    rows = numbered(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")))
    rows = rows.select("_row", "_id", F.encode("_text", "UTF-8").alias("_text"))
    schema = T.StructType([rows.schema["_row"], rows.schema["_id"], T.StructField("_print", T.LongType())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_buffer().to_pybytes(), width) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prints, pa.int64())], schema.names
            )

    return rows.mapInArrow(compute, schema)


class VantageTree:
    """Nodes in an array: vantage point, radius (below 0: a shard), and the two children."""

    def __init__(self, sample: np.ndarray, shards: float, distance: int, seed: int = 42):
        self.distance = distance
        self.points, self.radii, self.inside, self.outside = [], [], [], []
        self._grow(sample, min(LEVELS, ceil(log(max(1.0, shards)) / -log(SHRINK))), np.random.default_rng(seed))
        self.points = np.array(self.points, np.uint64)
        self.radii, self.inside, self.outside = (np.array(x) for x in (self.radii, self.inside, self.outside))

    def _grow(self, sample: np.ndarray, levels: int, rng) -> int:
        node = len(self.points)
        for column, value in ((self.points, 0), (self.radii, -1), (self.inside, -1), (self.outside, -1)):
            column.append(value)
        split = vantage(sample, self.distance, rng) if levels else None
        if split is not None:
            point, radius = split
            away = np.bitwise_count(sample ^ point)
            self.points[node], self.radii[node] = point, radius
            self.inside[node] = self._grow(sample[away <= radius], levels - 1, rng)
            self.outside[node] = self._grow(sample[away > radius], levels - 1, rng)
        return node

    def shards(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every (index, shard) a fingerprint goes to."""
        index, node = np.arange(len(prints)), np.zeros(len(prints), np.int64)
        done = []
        while len(index):
            leaf = self.radii[node] < 0
            done.append((index[leaf], node[leaf]))
            index, node = index[~leaf], node[~leaf]
            away = np.bitwise_count(prints[index] ^ self.points[node])
            near, far = away <= self.radii[node] + self.distance, away > self.radii[node]
            index, node = (
                np.concatenate([index[near], index[far]]),
                np.concatenate([self.inside[node[near]], self.outside[node[far]]]),
            )
        return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])


def vantage(prints: np.ndarray, distance: int, rng, tries: int = 12):
    """The vantage point and radius that leave the least to compare; None if no split saves a tenth."""
    if len(prints) < 32:
        return None
    best, split = 0.9 * len(prints) ** 2, None
    for point in rng.choice(prints, tries):
        seen = np.cumsum(np.bincount(np.bitwise_count(prints ^ point), minlength=65))[:65]
        within = np.append(seen, np.full(distance, len(prints)))
        cost = within[distance:].astype(float)[: 65] ** 2 + (len(prints) - seen).astype(float) ** 2
        radius = int(np.argmin(cost))
        if cost[radius] < best:
            best, split = cost[radius], (point, radius)
    return split


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Put linked indexes under one label, the smallest; labels point at their own root."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(labels, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while not np.array_equal(up := labels[labels], labels):
            labels[:] = up


def forest(prints: np.ndarray, distance: int, block: np.ndarray | None = None) -> np.ndarray:
    """For each of the different fingerprints the index of the smallest one it is linked to by steps of
    ``distance`` bits at most. With ``block``, only pairs of different blocks are compared."""
    labels = np.arange(len(prints))
    rng = np.random.default_rng(len(prints))
    todo = [np.arange(len(prints))]
    while todo:
        own = todo.pop()
        if len(own) > LEAF and (split := vantage(prints[own], distance, rng, 4)) is not None:
            away = np.bitwise_count(prints[own] ^ split[0])
            todo += [own[away <= split[1] + distance], own[away > split[1]]]
            continue
        for start in range(0, len(own), LEAF):
            rows = own[start : start + LEAF]
            for at in range(start, len(own), LEAF):
                columns = own[at : at + LEAF]
                if (labels[columns] == labels[rows[0]]).all() and (labels[rows] == labels[rows[0]]).all():
                    continue  # linked already
                near = np.bitwise_count(prints[rows][:, None] ^ prints[columns][None, :]) <= distance
                if block is not None:
                    near &= block[rows][:, None] != block[columns][None, :]
                selves = len(rows) if at == start and block is None else 0
                if near.sum() > selves:
                    i, j = np.nonzero(near)
                    _join(labels, rows[i], columns[j])
    return labels


def links(prints: DataFrame, distance: int = 3, shard: int = SHARD) -> DataFrame:
    """Links ``a``, ``b`` that connect all fingerprints (column ``_print``, all different) at most
    ``distance`` bits apart. ``prints`` is a written table; a shard is never larger than two blocks."""
    spark = prints.sparkSession
    total = prints.count()
    every = max(1, ceil(total / SAMPLE))
    sample = prints.filter(F.pmod(F.xxhash64("_print"), F.lit(every)) == 0).toPandas()["_print"]
    # Fewer fingerprints than fill a shard for every core are dealt to smaller ones, so that all cores search.
    shards = max(total / shard, min(PER_CORE * spark.sparkContext.defaultParallelism, total / SMALL))
    tree = spark.sparkContext.broadcast(
        VantageTree(np.sort(sample.to_numpy(np.int64)).view(np.uint64), shards, distance)
    )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column(0).to_numpy()
            index, node = tree.value.shards(signed.view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed[index]), pa.array(node, pa.int64())], ["_print", "_shard"]
            )

    dealt = prints.select("_print").mapInArrow(deal, "_print long, _shard long")
    # At most 2^LEVELS rows: the shards that have to be cut into blocks.
    large = dealt.groupBy("_shard").count().filter(F.col("count") > 2 * shard)
    blocks = F.broadcast(large.select("_shard", F.ceil(F.col("count") / shard).alias("_blocks")))
    own = F.pmod(F.xxhash64("_print", F.lit(7)), F.coalesce("_blocks", F.lit(1)))
    spread = (
        dealt.join(blocks, "_shard", "left")
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1)))
        .select("_shard", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", "_print")
    )

    def link(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        signed, first = np.unique(table["_print"].to_numpy(), return_index=True)
        block = None if key[1].as_py() == key[2].as_py() else table["_own"].to_numpy()[first]
        labels = forest(signed.view(np.uint64), distance, block)
        linked = labels != np.arange(len(labels))
        return pa.table({"a": signed[linked], "b": signed[labels[linked]]})

    return spread.groupBy("_shard", "_i", "_j").applyInArrow(link, "a long, b long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, distance: int) -> DataFrame:
    """``_row``, ``_id``, ``_print``, ``component_id`` and ``_root``, the key of the component: its smallest
    fingerprint, which no two components share, as they may share an id or have none."""
    rows = stored(with_fingerprints(docs, id_col, text_col), "fingerprints")
    prints = stored(rows.groupBy("_print").agg(F.min("_id").alias("_least")), "different-fingerprints")
    found = stored(components(links(prints, distance)), "components")
    grouped = prints.join(found, prints._print == found.node, "left").select(
        "_print", "_least", F.coalesce("root", "_print").alias("_root")
    )
    # Written, so that nothing stands between the join and its shuffles and AQE can split a large component.
    grouped = stored(grouped, "roots-of-fingerprints")
    least = stored(grouped.groupBy("_root").agg(F.min("_least").alias("component_id")), "least-of-components")
    of_print = stored(grouped.join(least, "_root").select("_print", "component_id", "_root"), "components-of-fingerprints")
    return rows.join(of_print, "_print")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3) -> DataFrame:
    """One row per row of ``docs``: ``_row``, id, ``fingerprint`` (hexadecimal), ``component_id``.

    A component holds all rows reachable by links between fingerprints that differ in ``distance`` bits
    or fewer; its id is its smallest document id (nulls aside; null if it has no other). Texts of fewer
    than three words are one shingle; a null, empty or blank text has fingerprint 0 and is linked like
    any other. Repeated rows and ids come back as often as they came, an empty table gives no rows,
    other columns are not read. ``docs`` is a table, see :func:`rows.numbered`.
    """
    return _grouped(docs, id_col, text_col, distance).select(
        "_row",
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3) -> DataFrame:
    """``docs`` with one row of each component: the one with its smallest id (null last), of equal ids the
    first row as the table is read.

    Components whose ids are equal or null are still different ones. Null, empty and blank texts are one
    component with whatever is near fingerprint 0; repeated rows leave one. An empty table stays empty.
    All columns of ``docs`` come back as they are, whatever they are called. ``docs`` is a table, see
    :func:`rows.numbered`.
    """
    rows = stored(_grouped(docs, id_col, text_col, distance).select("_row", "_id", "_root"), "near-groups")
    first = rows.groupBy("_root").agg(F.min_by("_row", F.struct(F.col("_id").isNull(), "_id", "_row")).alias("_row"))
    return without_rows(docs, rows.join(first, "_row", "left_anti"))
