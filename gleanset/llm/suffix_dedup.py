"""Removing every byte that lies in a string of a given length which starts anywhere else as well.

All windows of ``length`` bytes have to be sorted, but only where equal ones can be. So windows are dealt
to suffix buckets by their content: a window's bucket is the least hash of the shorter strings (grams)
inside it, which equal windows share wherever they stand. Neighbouring windows mostly have the same one,
so a text falls into segments, each for one bucket. A bucket whose gram occurs once in the corpus holds
no repeated window and is done; nothing but (hash, place) rows is shuffled to know that. The segments of
the others are grouped, equal ones counted before the shuffle, and sorted bucket by bucket in
:mod:`suffix_blocks`. A bucket with very many different segments is dealt anew by grams farther from the
one they share, and in the end window by window, so that no string however frequent fills a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanset.llm.rows import BROADCAST_IDS, numbered, parts, stored
from gleanset.llm.suffix_blocks import Sorter

#: Windows handled at a time, and the bits that number a gram among them.
SLICE, PLACE_BITS = 1 << 19, 20
#: Windows of a segment at most; a multiple of many periods, so that pieces of a periodic text are equal.
PIECE = 5040
#: Bytes of segments for a task, and in a bucket before it is dealt anew.
SHARD, LARGE = 4_000_000, 8_000_000
#: How far from the shared gram the next one is looked for, try by try; then windows stand alone.
RADII = (16, 64)
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
NONE = U64(0xFFFFFFFFFFFFFFFF)


def gram_length(length: int) -> int:
    return max(8, length * 8 // 25)


class Grams:
    """Hashes of the strings of ``size`` bytes at every position of a text."""

    def __init__(self, size: int):
        self.size, self.up, self.down = size, np.ones(1, U64), np.ones(1, U64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            inverse = pow(BASE, -1, 1 << 64)
            for name, base in (("up", BASE), ("down", inverse)):
                factors = np.full(n, base, U64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=U64))

    def of(self, text: np.ndarray) -> np.ndarray:
        n = len(text) - self.size + 1
        if n < 1:
            return np.zeros(0, U64)
        self._powers(len(text))
        sums = np.zeros(len(text) + 1, U64)
        np.cumsum((text.astype(U64) + U64(1)) * self.down[: len(text)], out=sums[1:])
        hashes = (sums[self.size :] - sums[:n]) * self.up[:n]
        hashes ^= hashes >> U64(32)
        hashes *= U64(0xD6E8FEB86659FD93)
        hashes ^= hashes >> U64(32)
        return hashes


def least_in(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every ``width`` consecutive ones, by prefix and suffix minima of blocks."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, NONE, U64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def placed(hashes: np.ndarray) -> np.ndarray:
    """Hashes with their position in the low bits: of equal ones the leftmost is the least."""
    low = U64((1 << PLACE_BITS) - 1)
    return (hashes & ~low) | np.arange(len(hashes), dtype=U64)


def segments_of(data: np.ndarray, offsets: np.ndarray, length: int, grams: Grams):
    """The segments of texts that stand one after the other: arrays of text number, hash, first and last
    window in the text, and how many grams have that hash there."""
    width = length - grams.size + 1
    starts, hashes = [], []
    for a in range(0, len(data) - length + 1, SLICE):
        least = least_in(placed(grams.of(data[a : a + SLICE + length - 1])), width)
        new = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        starts.append(new + a)
        hashes.append((least[new] >> U64(PLACE_BITS)).astype(np.int64))
    if not starts:
        return (np.zeros(0, np.int64),) * 5
    starts, hashes = np.concatenate(starts), np.concatenate(hashes)
    first = np.unique(np.concatenate([starts, offsets[:-1][offsets[:-1] < len(data)]]))
    hashes = hashes[np.searchsorted(starts, first, "right") - 1]
    text = np.searchsorted(offsets, first, "right") - 1
    last = np.minimum(np.append(first[1:], len(data)) - 1, offsets[text + 1] - length)
    inside = last >= first
    first, last, hashes, text = first[inside], last[inside], hashes[inside], text[inside]
    if not len(first):
        return (np.zeros(0, np.int64),) * 5
    # Neighbours with the same hash at different places are one segment.
    new = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])]))
    many = np.diff(np.append(new, len(first)))
    last = last[np.append(new[1:], len(first)) - 1]
    first, hashes, text = first[new], hashes[new], text[new]
    # Long ones are cut.
    cuts = (last - first) // PIECE + 1
    piece = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    first, last, hashes, text, many = (np.repeat(x, cuts) for x in (first, last, hashes, text, many))
    first = first + piece * PIECE
    last = np.minimum(last, first + PIECE - 1)
    return text, hashes, first - offsets[text], last - offsets[text], many


def farther(segment: bytes, length: int, grams: Grams, radius: int | None):
    """A segment's windows dealt anew: (hash, first, last window). Grams within ``radius`` of a window's
    own (the leftmost least) do not count; a window without others, or any without a radius, stands
    alone, with a hash below 0."""
    import xxhash

    def alone(i: int) -> tuple[int, int, int]:
        return -1 - (xxhash.xxh64_intdigest(segment[i : i + length]) >> PLACE_BITS), i, i

    n, width = len(segment) - length + 1, length - grams.size + 1
    if radius is None:
        yield from map(alone, range(n))
        return
    values = placed(grams.of(np.frombuffer(segment, np.uint8)))
    own = least_in(values, width)
    for a, b in _runs(own):
        at = int(own[a] & U64((1 << PLACE_BITS) - 1))
        others = values[a : b + width].copy()
        others[max(0, at - radius - a) : at + radius + 1 - a] = NONE
        least = least_in(others, width)
        for i, j in _runs(least):
            if least[i] == NONE:
                yield from map(alone, range(a + i, a + j + 1))
            else:
                yield int(least[i] >> U64(PLACE_BITS)), a + i, a + j


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    new = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])
    yield from zip(new[:-1].tolist(), (new[1:] - 1).tolist())


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column as one array, and where its values begin."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _find(texts: DataFrame, length: int) -> DataFrame:
    """``_row``, ``h``, ``first``, ``last``, ``grams`` of every segment of ``_row``, ``_text`` (binary)."""
    size = gram_length(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(size)
        for batch in batches:
            if not batch.num_rows:
                continue
            text, hashes, first, last, many = segments_of(*_bytes_of(batch.column(1)), length, grams)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(text)), pa.array(hashes), pa.array(first, pa.int64()),
                    pa.array(last, pa.int64()), pa.array(many, pa.int64()),
                ],
                ["_row", "h", "first", "last", "grams"],
            )

    return texts.mapInArrow(run, "_row long, h long, first long, last long, grams long")


SEGMENT = T.StructType(
    [T.StructField("_row", T.LongType()), T.StructField("at", T.LongType())]
    + [T.StructField("h", T.LongType()), T.StructField("seg", T.BinaryType())]
)


def _segment_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Segments in batches of bounded size."""

    def batch() -> pa.RecordBatch:
        types = pa.int64(), pa.int64(), pa.int64(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, types)], SEGMENT.names)

    held, size = ([], [], [], []), 0
    for row in rows:
        for column, value in zip(held, row):
            column.append(value)
        size += len(row[3]) + 64
        if size > 8_000_000:
            yield batch()
            held, size = ([], [], [], []), 0
    if held[0]:
        yield batch()


def _cut(texts: DataFrame, length: int) -> DataFrame:
    """The bytes of the segments listed in ``_list``, with the place of their first window."""

    def rows(batches):
        for batch in batches:
            for row, text, listed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text = memoryview(text.as_buffer())
                h, first, last = (listed.values.field(name).to_numpy() for name in ("h", "first", "last"))
                for one, a, b in zip(h, first, last):
                    yield row, a, one, bytes(text[a : b + length])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _segment_batches(rows(batches))

    return texts.select("_row", "_text", "_list").mapInArrow(run, SEGMENT)


def _dealt_anew(segments: DataFrame, length: int, radius: int | None) -> DataFrame:
    size = gram_length(length)

    def rows(batches):
        grams = Grams(size)
        for batch in batches:
            for row, at, seg in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for h, a, b in farther(seg, length, grams, radius):
                    yield row, at + a, h, seg[a : b + length]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _segment_batches(rows(batches))

    return segments.select("_row", "at", "seg").mapInArrow(run, SEGMENT)


def _buckets(segments: DataFrame, length: int, large: int) -> tuple[DataFrame, DataFrame]:
    """``_row``, ``at``, ``h``, ``key`` of all segments, and ``h``, ``key``, ``seg``, ``n`` of different ones,
    once no bucket has more than ``large`` bytes of different segments."""
    members, different = [], []
    radii = [*RADII, None]
    while True:
        segments = stored(segments.withColumn("key", F.unhex(F.sha2("seg", 256))), "segments")
        distinct = stored(segments.groupBy("h", "key", "seg").agg(F.count(F.lit(1)).alias("n")), "different-segments")
        if not radii:
            hot = None
            break
        sizes = distinct.filter("h >= 0").groupBy("h").agg(F.sum(F.octet_length("seg")).alias("size"))
        hot = stored(sizes.filter(F.col("size") > large).select("h"), "large-buckets")
        if hot.isEmpty():
            break
        members.append(segments.join(hot, "h", "left_anti").select("_row", "at", "h", "key"))
        different.append(distinct.join(hot, "h", "left_anti"))
        segments = _dealt_anew(segments.join(hot, "h", "left_semi"), length, radii.pop(0))
    members.append(segments.select("_row", "at", "h", "key"))
    different.append(distinct)
    return reduce(DataFrame.unionByName, members), reduce(DataFrame.unionByName, different)


def _marked(different: DataFrame, length: int, shard: int) -> DataFrame:
    """``h``, ``key`` and the runs of repeated windows, ``starts`` to ``ends``, of the different segments."""
    different = stored(different.select("h", "key", "seg", "n"), "dealt-segments")
    total = different.agg(F.sum(F.octet_length("seg"))).first()[0] or 0
    shards = max(1, -(-total // shard))

    def solve(table: pa.Table) -> pa.Table:
        data, offsets = _bytes_of(pa.concat_arrays([c.cast(pa.large_binary()) for c in table["seg"].chunks]))
        windows = np.diff(offsets) - length + 1
        ends = np.cumsum(windows)
        often = table["n"].to_numpy() > 1
        _, bucket, sizes = np.unique(table["h"].to_numpy(), return_inverse=True, return_counts=True)
        marks = np.repeat(often, windows)
        # A segment that is its bucket and has copies is settled; all others are sorted.
        open_ = np.repeat(~(often & (sizes[bucket] == 1)), windows)
        at = np.arange(ends[-1]) + np.repeat(offsets[:-1] - (ends - windows), windows)
        marks[open_] |= Sorter(data, length).repeated(at[open_])
        edge = np.zeros(len(marks) + 1, bool)
        edge[ends - windows] = True
        edge[-1] = True
        start = np.flatnonzero(marks & (edge[:-1] | ~np.concatenate([[False], marks[:-1]])))
        end = np.flatnonzero(marks & (edge[1:] | ~np.concatenate([marks[1:], [False]])))
        of = np.searchsorted(ends, start, "right")
        base = (ends - windows)[of]
        lists = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(windows)))]).astype(np.int32)
        columns = [pa.ListArray.from_arrays(pa.array(lists), pa.array((x - base).astype(np.int64))) for x in (start, end)]
        return pa.table([table["h"], table["key"], *columns], names=["h", "key", "starts", "ends"])

    of_shard = F.pmod(F.xxhash64("h"), F.lit(shards))
    schema = "h long, key binary, starts array<long>, ends array<long>"
    return different.withColumn("_shard", of_shard).groupBy("_shard").applyInArrow(solve, schema)


def repeated_spans(
    docs: DataFrame, length: int = 200, text_col: str = "text", shard: int = SHARD, large: int = LARGE
) -> DataFrame:
    """``_row`` (as :func:`rows.numbered` gives it) and ``spans``: (start, end) of byte ranges that repeated
    strings of ``length`` bytes cover, unordered and overlapping. Rows without any are left out."""
    rows = numbered(docs.select(F.encode(F.col(text_col), "UTF-8").alias("_text")))
    rows = rows.filter(F.octet_length("_text") >= length)
    # Texts with an equal one are covered as a whole; one of each is sorted on for the others' sake.
    keyed = rows.select("_row", F.octet_length("_text").cast("long").alias("_bytes"), F.unhex(F.sha2("_text", 256)).alias("_key"))
    keyed = stored(keyed, "text-keys")
    groups = keyed.groupBy("_key").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    groups = stored(groups.filter("_n > 1").select("_key", "_first"), "repeated-texts")
    same = stored(keyed.join(groups, "_key").select("_row", "_bytes", "_first"), "rows-of-repeated-texts")
    copies = same.filter("_row <> _first").select("_row")
    if copies.count() <= BROADCAST_IDS:
        copies = F.broadcast(copies)
    single = rows.join(copies, "_row", "left_anti")
    found = stored(_find(single.select("_row", "_text"), length), "segments-found")
    repeated = stored(found.groupBy("h").agg(F.sum("grams").alias("n")).filter("n > 1").select("h"), "repeated-grams")
    listed = found.join(repeated, "h", "left_semi").groupBy("_row").agg(
        F.collect_list(F.struct("h", "first", "last")).alias("_list")
    )
    segments = _cut(rows.join(stored(listed, "segments-of-rows"), "_row"), length)
    members, different = _buckets(segments, length, large)
    marked = stored(_marked(different, length, shard).filter(F.size("starts") > 0), "repeated-windows")
    runs = members.join(marked, ["h", "key"]).select("_row", "at", F.inline(F.arrays_zip("starts", "ends")))
    covered = runs.select("_row", (F.col("at") + F.col("starts")).alias("start"), (F.col("at") + F.col("ends") + length).alias("end"))
    whole = same.select("_row", F.lit(0).cast("long").alias("start"), F.col("_bytes").alias("end"))
    return covered.unionByName(whole).groupBy("_row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def without_repeats(
    docs: DataFrame,
    length: int = 200,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard: int = SHARD,
    large: int = LARGE,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` (the maximal byte
    ranges removed) and ``kept`` (the other bytes, in order; they need not be whole characters).

    A byte goes if a string of ``length`` bytes (63 at least) that covers it also starts at another place
    of the corpus, the same text included; matches do not cross texts, and all are judged on the input. A
    null or empty text keeps nothing and loses nothing, a text shorter than ``length`` stays. Repeated
    rows and ids are rows of their own, so copies go altogether. An empty table gives no rows; other
    columns are not read. ``docs`` is a table, see :func:`rows.numbered`.
    """
    spans = stored(repeated_spans(docs, length, text_col, shard, large), "spans")
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = numbered(docs.select(F.col(id_col).alias("id"), text.alias("text")))
    schema = T.StructType(
        [T.StructField("id", rows.schema["id"].dataType)]
        + [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
        + [T.StructField("spans", T.ArrayType(SPAN)), T.StructField("kept", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, listed = batch.column(1), batch.column(2)
            sizes = [t.as_buffer().size for t in texts]
            for a, b in parts(sizes, sizes):
                kept, found = [], []
                for text, spans in zip(texts.slice(a, b - a), listed.slice(a, b - a)):
                    found.append(maximal(spans.values))
                    kept.append(outside(memoryview(text.as_buffer()), *found[-1]))
                n_bytes, count = np.array(sizes[a:b]), np.array([len(s) for s, _ in found])
                start, end = (np.concatenate(c) for c in zip(*found))
                flat = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"])
                ends = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array(n_bytes, pa.int64()),
                        pa.array(n_bytes - np.array([len(k) for k in kept]), pa.int64()), pa.array(count, pa.int64()),
                        pa.ListArray.from_arrays(ends, flat), pa.array(kept, pa.binary()),
                    ],
                    schema.names,
                )

    joined = rows.join(spans, "_row", "left").select("id", "text", "spans")
    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def maximal(spans: pa.StructArray | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal ranges that (start, end) ranges cover."""
    if spans is None or not len(spans):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = (spans.field(name).to_numpy() for name in ("start", "end"))
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return start[new], reach[np.append(new[1:], len(start)) - 1]


def outside(text: memoryview, start: np.ndarray, end: np.ndarray) -> bytes:
    """The bytes of a text that lie in none of the ranges."""
    edges = [0, *np.stack([start, end], axis=1).ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
