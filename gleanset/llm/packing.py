"""Packing documents into fixed-length sequences by best fit decreasing.

A document longer than a window is first cut into full windows. What is left of each document goes,
longest first, into the open window with the least room that still takes it. A segment tree over the
possible remaining capacities finds that window in a logarithm of the window length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanset.llm.pretokens import IdEncoder
from gleanset.llm.rows import parts

#: Sequence ids are the task's number times this plus a count, so tasks need not know each other.
TASK_SEQUENCES = 1 << 40


class OpenWindows:
    """Windows by remaining capacity, under a segment tree that counts them."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.by_room: dict[int, list] = {}
        self.count = 0

    def _change(self, room: int, by: int) -> None:
        self.count += by
        node = room + self.leaves
        while node:
            self.tree[node] += by
            node >>= 1

    def put(self, room: int, window) -> None:
        self.by_room.setdefault(room, []).append(window)
        self._change(room, 1)

    def tightest(self, need: int):
        """Take out the window with the least room of at least ``need``: (room, window), or None."""
        if need >= self.leaves:
            return None
        tree, node = self.tree, need + self.leaves
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not tree[node]:
                    node += 1
        return self._take(node - self.leaves)

    def loosest(self):
        """Take out the window with the most room: (room, window), or None."""
        if not self.count:
            return None
        node = 1
        while node < self.leaves:
            node = 2 * node + (self.tree[2 * node + 1] > 0)
        return self._take(node - self.leaves)

    def _take(self, room: int):
        self._change(room, -1)
        return room, self.by_room[room].pop()


class Packer:
    """Packs pieces block by block; windows that are not full stay open for the next block."""

    def __init__(self, capacity: int, block: int, slack: int, open_windows: int):
        self.capacity, self.block, self.slack, self.most_open = capacity, block, slack, open_windows
        self.windows = OpenWindows(capacity)
        self.waiting: list[tuple] = []
        self.held = 0

    def add(self, doc, ids: bytes) -> Iterator[list[tuple]]:
        """Take a document's ids (4 bytes each); gives finished windows, lists of (doc, start, total, ids)."""
        total = len(ids) // 4
        full = total - total % self.capacity
        for start in range(0, full, self.capacity):
            yield [(doc, start, total, ids[4 * start : 4 * (start + self.capacity)])]
        if total > full:
            self.waiting.append((doc, full, total, ids[4 * full :]))
            self.held += total - full
            if self.held >= self.block:
                yield from self._fit()

    def _fit(self) -> Iterator[list[tuple]]:
        self.waiting.sort(key=lambda p: -len(p[3]))
        for piece in self.waiting:
            need = len(piece[3]) // 4
            yield from self._put(piece, *(self.windows.tightest(need) or (self.capacity, [])))
        self.waiting, self.held = [], 0
        yield from self._close()

    def _put(self, piece: tuple, room: int, window: list[tuple]) -> Iterator[list[tuple]]:
        window.append(piece)
        if room > (need := len(piece[3]) // 4):
            self.windows.put(room - need, window)
        else:
            yield window

    def _close(self) -> Iterator[list[tuple]]:
        """Leave ``most_open`` windows, one at least. Those within ``slack`` are given as they are, the fullest
        first. Then the emptiest are taken apart: a piece that fits nowhere is cut to fill the largest rooms."""
        while self.windows.count > self.most_open:
            room, window = self.windows.tightest(1)
            if room > self.slack:
                self.windows.put(room, window)
                break
            yield window
        while self.windows.count > max(1, self.most_open):
            for doc, start, total, ids in sorted(self.windows.loosest()[1], key=lambda p: -len(p[3])):
                while (found := self.windows.tightest(len(ids) // 4)) is None and self.windows.count:
                    room, window = self.windows.loosest()
                    yield from self._put((doc, start, total, ids[: 4 * room]), room, window)
                    start, ids = start + room, ids[4 * room :]
                yield from self._put((doc, start, total, ids), *(found or (self.capacity, [])))

    def finish(self) -> Iterator[list[tuple]]:
        """The windows still open. One with more room than ``slack`` is cut at powers of two, which
        need no padding."""
        yield from self._fit()
        while (last := self.windows.tightest(1)) is not None:
            room, window = last
            if room <= self.slack:
                yield window
            else:
                yield from _powers(window, self.capacity - room)


def _powers(window: list[tuple], filled: int) -> Iterator[list[tuple]]:
    left = list(reversed(window))
    for bit in reversed(range(filled.bit_length())):
        if not filled >> bit & 1:
            continue
        need, out = 1 << bit, []
        while need:
            doc, start, total, ids = left.pop()
            taken = min(need, len(ids) // 4)
            out.append((doc, start, total, ids[: 4 * taken]))
            if 4 * taken < len(ids):
                left.append((doc, start + taken, total, ids[4 * taken :]))
            need -= taken
        yield out


def pack_documents(
    docs: DataFrame,
    vocabulary: str = "word_bpe_49k.json",
    end_id: int = 2,
    capacity: int = 4096,
    block: int = 4_000_000,
    slack: int = 64,
    open_windows: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of packed documents: id, ``start``, ``length``, ``doc_tokens``, ``sequence_id``,
    ``offset`` and ``ids`` (binary, little-endian unsigned 32-bit).

    A null or empty text is ``end_id`` alone. Every id lies in one piece; the pieces of a sequence
    follow each other from offset 0. Repeated rows and ids are packed as often as they come, a null id
    stays null, an empty table gives no pieces, other columns are not read. There is no shuffle: each
    task packs what it reads in blocks of ``block`` ids with at most ``open_windows`` windows carried
    on, so its memory is bounded whatever it reads, and a lost task repeats alone. A window is closed
    short by at most ``slack`` ids or, at the end of a task, at a power of two; when too many are open,
    the emptiest are cut to fill others.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    end = end_id.to_bytes(4, "little")
    schema = T.StructType(
        [
            rows.schema["id"],
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = None, Packer(capacity, block, slack, open_windows)
        sequence = TaskContext.get().partitionId() * TASK_SEQUENCES
        out: list[list] = [[] for _ in schema]
        id_type = None

        def emit(window: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, total, ids in window:
                n = len(ids) // 4
                for column, value in zip(out, (doc, start, n, total, sequence, offset, ids)):
                    column.append(value)
                offset += n
            sequence += 1

        def flush() -> pa.RecordBatch:
            types = [id_type, *[pa.int64()] * 5, pa.binary()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], schema.names)
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            encoder = encoder or IdEncoder(vocabulary)
            id_type = batch.schema.field(0).type
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in parts(texts):
                for key, ids in zip(keys[a:b], encoder.encode(texts[a:b])):
                    for window in packer.add(key, ids + end):
                        emit(window)
                        if len(out[0]) >= 2000:
                            yield flush()
        if id_type is not None:
            for window in packer.finish():
                emit(window)
                if len(out[0]) >= 2000:
                    yield flush()
            yield flush()

    return rows.mapInArrow(pack, schema).withColumnRenamed("id", id_col)
