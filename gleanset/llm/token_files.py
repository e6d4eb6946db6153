"""Token ids in binary shards with a minimal perfect hash index.

A store is a folder. Shard ``n`` is ``ids-n.bin``, the ids of its documents one after the other as raw
little-endian unsigned integers (16 bits if the vocabulary allows), and ``ids-n.idx``, its index. The
shards hold ascending ranges of keys; the table ``shards`` lists them with their first and last key.

The index maps a key to its place in the shard in constant time: a minimal perfect hash gives each
different key a slot of its own in ``0..keys-1``, and the slot stores a fingerprint, by which foreign
keys are told apart, and the number and count of the key's documents.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gleanset.llm.pretokens import IdEncoder, load
from gleanset.llm.rows import parts

#: Bits per key that is left, at each level of the hash.
GAMMA = 2.0
U64 = np.uint64


def key_hash(keys: list, seed: int) -> np.ndarray:
    """64 bits per key; a null key has a hash too."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(repr(k), seed) for k in keys], U64)


def _mixed(hashes: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = hashes + U64(0x9E3779B97F4A7C15) * U64(level + 1)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class PerfectHash:
    """Minimal perfect hash: at each level the keys that meet no other there take a bit, the rest go
    on. A key's slot is the number of bits before its own."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        flat = np.unpackbits(bits, count=int(self.starts[-1]), bitorder="little")
        self.flat = flat.astype(bool)
        self.rank = np.cumsum(flat, dtype=np.int64) - flat

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        """``hashes`` are all different."""
        sizes, levels, left = [], [], hashes
        while len(left):
            size = max(64, int(GAMMA * len(left)))
            at = (_mixed(left, len(sizes)) % U64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        flat = np.concatenate(levels) if levels else np.zeros(0, bool)
        return cls(np.array(sizes, np.int64), np.packbits(flat, bitorder="little"))

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each key it was built from; -1 or any slot for others."""
        slot = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = self.starts[level] + (_mixed(hashes[open_], level) % U64(size)).astype(np.int64)
            hit = self.flat[at]
            slot[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit]
        return slot


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (_mixed(hashes, 1 << 20) >> U64(32)).astype("<u4")


def build_index(keys: list, lengths: list[int], width: int) -> bytes:
    """Index of a shard whose documents have these keys, equal keys next to each other, and lengths."""
    first = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
    different = [keys[i] for i in first]
    seed = 0
    while len(np.unique(hashes := key_hash(different, seed))) < len(different):
        seed += 1  # two keys with one hash
    perfect = PerfectHash.build(hashes)
    slots = perfect.slots(hashes)
    ordinal, count = np.zeros(len(first), "<i8"), np.zeros(len(first), "<i4")
    prints = np.zeros(len(first), "<u4")
    ordinal[slots] = first
    count[slots] = np.diff([*first, len(keys)])
    prints[slots] = fingerprints(hashes)
    stored = pa.BufferOutputStream()
    with pa.ipc.new_stream(stored, (table := pa.table({"key": pa.array(keys)})).schema) as writer:
        writer.write_table(table)
    out = io.BytesIO()
    np.savez(
        out, seed=seed, width=width, sizes=perfect.sizes, bits=perfect.bits, prints=prints, ordinal=ordinal,
        count=count, starts=np.concatenate([[0], np.cumsum(lengths)]).astype("<i8"),
        keys=np.frombuffer(stored.getvalue(), np.uint8),
    )
    return out.getvalue()


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "", 1))


class Shard:
    """One shard, opened by its index. ``get`` reads a key's documents without any search."""

    def __init__(self, path: str, shard: int):
        self.files, root = _files(path)
        self.name = f"{root}/ids-{shard:05d}"
        with self.files.open_input_file(f"{self.name}.idx") as f:
            index = np.load(io.BytesIO(f.read()))
        self.seed, self.dtype = int(index["seed"]), np.dtype(f"<u{int(index['width'])}")
        self.perfect = PerfectHash(index["sizes"], index["bits"])
        self.prints, self.ordinal, self.count = index["prints"], index["ordinal"], index["count"]
        self.starts = index["starts"]
        self.keys = pa.ipc.open_stream(pa.py_buffer(index["keys"].tobytes())).read_all()["key"].to_pylist()
        self.payload = self.files.open_input_file(f"{self.name}.bin")

    def places(self, keys: list) -> list[tuple[int, int]]:
        """For each key the number of its first document in the shard and how many it has (0: none)."""
        if not keys or not len(self.prints):
            return [(0, 0)] * len(keys)
        hashes = key_hash(keys, self.seed)
        slots = self.perfect.slots(hashes)
        known = (slots >= 0) & (self.prints[slots] == fingerprints(hashes))
        return [(int(self.ordinal[s]), int(self.count[s])) if k else (0, 0) for s, k in zip(slots, known)]

    def ids(self, ordinal: int) -> np.ndarray:
        a, b = int(self.starts[ordinal]), int(self.starts[ordinal + 1])
        size = self.dtype.itemsize
        return np.frombuffer(self.payload.read_at((b - a) * size, a * size), self.dtype)

    def get(self, key) -> list[np.ndarray]:
        """The ids of each document with this key; an empty list if there is none."""
        (first, n), = self.places([key])
        return [self.ids(i) for i in range(first, first + n)]


def write_store(
    docs: DataFrame,
    path: str,
    vocabulary: str = "byte_bpe_50k.json",
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode every whole text, append ``end_id``, and write a store to the new folder ``path``.

    Documents are in ascending order of the id (null first), then of the text's hash, then as the table is
    read, so repeated ids and rows have a defined order, and one id, or one row, that is there very many
    times is split over shards. ``docs`` is a table, see :func:`rows.numbered`. A
    null or empty text is ``end_id`` alone; an empty table gives a store without shards; other columns
    are not read. ``path`` is a shared folder. A shard appears by rename when it is complete, so a
    task that is lost or runs twice leaves no half shard.
    """
    spark = docs.sparkSession
    width = 2 if max(load(vocabulary).get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4
    files, root = _files(path)
    files.create_dir(root, recursive=True)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The number of a row parts what nothing else does: one row repeated without limit is split as well.
    rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange("id", "tie", "row").sortWithinPartitions("id", "tie", "row")
    key = rows.schema["id"].dataType
    schema = T.StructType(
        [T.StructField("shard", T.IntegerType()), T.StructField("n_docs", T.LongType())]
        + [T.StructField("n_ids", T.LongType())]
        + [T.StructField("first_key", key), T.StructField("last_key", key)]
    )
    end = end_id.to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, encoder, keys, lengths = context.partitionId(), None, [], []
        name, attempt, out = f"{root}/ids-{shard:05d}", context.taskAttemptId(), None
        store, _ = _files(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            encoder = encoder or IdEncoder(vocabulary)
            out = out or store.open_output_stream(f"{name}.bin.{attempt}.part")
            key_type = batch.schema.field(0).type
            texts = batch.column(1).to_pylist()
            keys += batch.column(0).to_pylist()
            for a, b in parts(texts):
                coded = [ids + end for ids in encoder.encode(texts[a:b])]
                lengths += [len(ids) // 4 for ids in coded]
                out.write(np.frombuffer(b"".join(coded), "<u4").astype(f"<u{width}").tobytes())
        if out is None:
            return
        out.close()
        with store.open_output_stream(f"{name}.idx.{attempt}.part") as f:
            f.write(build_index(keys, lengths, width))
        for kind in ("bin", "idx"):
            store.move(f"{name}.{kind}.{attempt}.part", f"{name}.{kind}")
        columns = [[shard], [len(keys)], [sum(lengths)], [keys[0]], [keys[-1]]]
        types = [pa.int32(), pa.int64(), pa.int64(), key_type, key_type]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], schema.names)

    ordered.select("id", "text").mapInArrow(write, schema).write.parquet(f"{path}/shards")


def shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per shard, with ``start``, the number of ids in the shards before it."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.parquet(f"{path}/shards").withColumn(
        "start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))
    )


def read_store(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Every document of a store: id, ``start`` (ids of all documents before it), ``n_tokens`` and
    ``ids`` (binary, little-endian unsigned 32-bit). Each document is reached by its key through the
    index; one that the index does not lead to fails the read. One task per shard."""
    listed = shards(spark, path)
    n = max(1, listed.count())
    key = listed.schema["first_key"].dataType
    key_type = to_arrow_type(key)
    schema = T.StructType(
        [T.StructField("id", key), T.StructField("start", T.LongType())]
        + [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(path, number)
                for a in range(0, len(shard.keys), 1000):
                    keys = shard.keys[a : a + 1000]
                    at, lengths, payload = [], [], []
                    for i, (k, (first, count)) in enumerate(zip(keys, shard.places(keys)), a):
                        if not first <= i < first + count:
                            raise ValueError(f"shard {number}: the index does not lead to {k!r}")
                        ids = shard.ids(i)
                        at.append(start + int(shard.starts[i]))
                        lengths.append(len(ids))
                        payload.append(ids.astype("<u4").tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, key_type), pa.array(at), pa.array(lengths), pa.array(payload, pa.binary())],
                        schema.names,
                    )

    # The list is small; every shard becomes a task of its own.
    return (
        listed.select("shard", "start").repartition(n).mapInArrow(read, schema).withColumnRenamed("id", id_col)
    )


def crc32(ids: np.ndarray) -> int:
    """Checksum of ids as little-endian unsigned 32-bit integers, as :func:`read_store` gives them."""
    return zlib.crc32(ids.astype("<u4").tobytes())
