"""Benchmark passages in documents, by a prefix-filtered join.

A window is ten consecutive words of a benchmark item (a shorter item is one window). A document that
holds a window holds each of its shingles, so it is enough to join one of them, and the rarest one
costs least: the prefix of a containment of 1 is a single token in the order of rarity. One pass over all
documents notes where they hold shingles of the benchmark. From that these are counted, every window is
filed under its rarest one, and only its places are joined. The window's place follows from the shingle's;
it must lie within the document, and its words are compared one by one, in a second look at those
documents alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanset.llm.rows import BROADCAST_IDS, numbered, stored, without_rows

#: Words of a window and of a shingle.
WINDOW, SHINGLE = 10, 5
#: The filter that goes to all tasks: bits per shingle, and bits at most (16 MB); joins decide exactly.
FILTER_BITS, MOST_BITS, PROBES = 32, 1 << 27, 3
#: Places in a row at most, and different words whose hash is remembered.
ROW_CANDIDATES, KNOWN = 500, 500_000

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
U64 = np.uint64


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text after lower-casing A-Z: runs of 0-9, a-z and anything beyond ASCII."""
    return WORD.findall(text.lower())


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > KNOWN:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, 1)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every ``width`` consecutive words."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        x = np.full(n, width, U64)
        for i in range(width):
            x = (x ^ hashes[i : i + n]) * U64(0x9E3779B97F4A7C15)
            x ^= x >> U64(29)
        x *= U64(0xBF58476D1CE4E5B9)
        return x ^ (x >> U64(32))


class ShingleFilter:
    """A Bloom filter. Its bits are gathered from an aggregate of at most ``MOST_BITS`` / 64 rows."""

    #: Fixed value: the bits of a hash that each probe starts at.
    SHIFTS = (0, 17, 36)

    def __init__(self, table: DataFrame, n: int):
        self.bits = min(MOST_BITS, max(64, 1 << (FILTER_BITS * max(1, n) - 1).bit_length()))
        places = [F.shiftrightunsigned("_shingle", s).bitwiseAND(F.lit(self.bits - 1)) for s in self.SHIFTS]
        words = (
            table.select(F.explode(F.array(*places)).alias("_bit"))
            .groupBy(F.shiftright("_bit", 6).alias("_word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit & 63 AS INT))")).alias("_set"))
            .toPandas()
        )
        self.words = np.zeros(self.bits // 64, U64)
        self.words[words["_word"].to_numpy(np.int64)] = words["_set"].to_numpy(np.int64).view(U64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Indexes of the hashes that may be in the table."""
        left = np.arange(len(hashes))
        for shift in self.SHIFTS:
            at = (hashes[left] >> U64(shift)) & U64(self.bits - 1)
            left = left[(self.words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1]
            if not len(left):
                break
        return left


def _windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every window of every item: ``_item``, ``_words`` (joined by spaces), ``_width``, and the
    shingles in it with their offset."""
    rows = items.select(
        F.col(id_col).cast("string").alias("_item"), F.encode(F.coalesce(text_col, F.lit("")), "UTF-8").alias("_text")
    )
    schema = "_item string, _words string, _width int, _grams array<struct<_offset: int, _shingle: bigint>>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if not words:
                    continue
                width = min(WINDOW, len(words))
                size = min(SHINGLE, width)
                grams = shingles(known.of(words), size).view(np.int64)
                for first in range(0, len(words) - width + 1, 1000):
                    starts = range(first, min(first + 1000, len(words) - width + 1))
                    inside = range(width - size + 1)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "_item": pa.array([item] * len(starts), pa.string()),
                            "_words": [b" ".join(words[s : s + width]).decode() for s in starts],
                            "_width": pa.array([width] * len(starts), pa.int32()),
                            "_grams": pa.array(
                                [[{"_offset": o, "_shingle": int(grams[s + o])} for o in inside] for s in starts],
                                pa.list_(pa.struct([("_offset", pa.int32()), ("_shingle", pa.int64())])),
                            ),
                        }
                    )

    return rows.mapInArrow(cut, schema)


def _places(rows: DataFrame, bits, sizes: list[int]) -> DataFrame:
    """Per document ``_row``, ``_id``, ``_n_words`` and its places that the filter lets through, by shingle;
    further rows of a document carry more places and no word count. The only pass over all texts."""
    place = T.StructType([T.StructField("_shingle", T.LongType()), T.StructField("_at", T.LongType())])
    schema = T.StructType(
        [rows.schema["_row"], rows.schema["_id"], T.StructField("_n_words", T.LongType())]
        + [T.StructField("_found", T.ArrayType(place))]
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            owner, counts, sizes_, shingle, places = [], [], [], [], []
            for i, text in enumerate(batch.column(2)):
                hashes = known.of(words_of(text.as_buffer().to_pybytes()))
                grams, at = [], []
                for size in sizes:
                    own = shingles(hashes, size)
                    held = bits.value.holds(own)
                    grams.append(own[held])
                    at.append(held)
                n = sum(map(len, at))
                shingle += grams
                places += at
                for first in range(0, max(1, n), ROW_CANDIDATES):
                    owner.append(i)
                    counts.append(None if first else len(hashes))
                    sizes_.append(min(n - first, ROW_CANDIDATES))
            if not owner:
                continue
            found = pa.StructArray.from_arrays(
                [
                    pa.array(np.concatenate([np.zeros(0, U64), *shingle]).view(np.int64)),
                    pa.array(np.concatenate([np.zeros(0, np.int64), *places]).astype(np.int64)),
                ],
                ["_shingle", "_at"],
            )
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes_)]).astype(np.int32))
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(take), batch.column(1).take(take), pa.array(counts, pa.int64()),
                    pa.ListArray.from_arrays(ends, found),
                ],
                schema.names,
            )

    return rows.mapInArrow(find, schema)


def _verified(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per row with a window to look for (``_list`` of start, width, words and items): ``spans``, those that
    are there word by word, and ``items``, the items they are of."""
    ids = wanted.select("_row")
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    # The few documents that are meant are found first, so that the others do not travel.
    texts = rows.join(ids, "_row", "left_semi").select("_row", "_text").join(wanted, "_row")
    schema = T.StructType(
        [rows.schema["_row"], T.StructField("spans", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType()))]
    )
    span = pa.struct([("_start", pa.int64()), ("_width", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for row, text, listed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words = words_of(text.as_buffer().to_pybytes())
                spans, items = set(), set()
                for one in listed.as_py():
                    start, width = one["_start"], one["_width"]
                    if start >= 0 and b" ".join(words[start : start + width]) == one["_words"].encode():
                        spans.add((start, width))
                        items.update(one["_items"])
                if spans:
                    ordered = [{"_start": a, "_width": n} for a, n in sorted(spans)]
                    for column, value in zip(out, (row, ordered, sorted(items))):
                        column.append(value)
            types = [pa.int64(), pa.list_(span), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], schema.names)

    return texts.select("_row", "_text", "_list").mapInArrow(check, schema)


SPAN = T.StructType([T.StructField("_start", T.LongType()), T.StructField("_width", T.LongType())])


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Per row of ``docs``: ``_row``, id, ``n_words``, ``n_hit`` (words inside an occurring window),
    ``items`` (ids of the items with one, sorted as strings), ``spans`` (start and width of each window).

    Null, empty and wordless texts have no words and no hit; items without words have no window; items
    of one id are one item, an item without id hits words but is not listed. Repeated rows and ids come
    back as often as they came, an empty ``docs`` gives no rows, an empty benchmark no hits, other
    columns are not read. ``docs`` is a table, see :func:`rows.numbered`.

    Only a filter of bounded size goes to all tasks. The join with the benchmark is left to AQE, which
    broadcasts a small benchmark and splits a shingle that very many documents hold.
    """
    spark = docs.sparkSession
    windows = stored(_windows(benchmark, item_col, item_text), "windows")
    grams = stored(windows.select(F.explode("_grams._shingle").alias("_shingle")).distinct(), "window-shingles")
    sizes = sorted({min(SHINGLE, r[0]) for r in windows.select("_width").distinct().collect()})
    text = F.encode(F.coalesce(text_col, F.lit("")), "UTF-8")
    rows = numbered(docs.select(F.col(id_col).alias("_id"), text.alias("_text"))).select("_row", "_id", "_text")

    bits = spark.sparkContext.broadcast(ShingleFilter(grams, grams.count()))
    found = stored(_places(rows, bits, sizes), "places")
    counts = found.select(F.explode("_found._shingle").alias("_shingle")).groupBy("_shingle").agg(F.count(F.lit(1)).alias("_n"))
    rarity = stored(grams.join(counts, "_shingle", "left"), "rarity")
    distinct = windows.groupBy("_words", "_width", "_grams").agg(F.sort_array(F.collect_set("_item")).alias("_items"))
    # A window is filed under its rarest shingle.
    prefix = stored(
        distinct.select("*", F.explode("_grams").alias("_gram"))
        .select("*", "_gram.*")
        .join(rarity, "_shingle")
        .groupBy("_words", "_width")
        .agg(
            F.min_by(
                F.struct("_shingle", "_offset", "_items"), F.struct(F.coalesce("_n", F.lit(0)), "_shingle", "_offset")
            ).alias("_anchor")
        )
        .select("_words", F.col("_width").cast("long").alias("_width"), "_anchor.*"),
        "prefix",
    )
    wanted = (
        found.select("_row", F.inline("_found"))
        .join(prefix, "_shingle")
        .groupBy("_row")
        .agg(F.collect_list(F.struct((F.col("_at") - F.col("_offset")).alias("_start"), "_width", "_words", "_items")).alias("_list"))
    )
    match = _verified(rows, stored(wanted, "windows-to-verify"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(
            F.greatest(s["end"], x["_start"] + x["_width"]).alias("end"),
            (s["n"] + F.greatest(F.lit(0), x["_start"] + x["_width"] - F.greatest(s["end"], x["_start"]))).alias("n"),
        ),
        lambda s: s["n"],
    )
    return (
        found.filter("_n_words IS NOT NULL")
        .select("_row", F.col("_id").alias(id_col), F.col("_n_words").alias("n_words"))
        .join(match, "_row", "left")
        .withColumn("n_hit", F.coalesce(covered, F.lit(0).cast("long")))
        .withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window, by :func:`find_contamination`.

    Null and wordless texts stay; so does everything if the benchmark is empty; repeated rows stay or go
    alike; an empty table stays empty. All columns of ``docs`` come back as they are, whatever they are
    called. ``docs`` is a table, see :func:`rows.numbered`.
    """
    return without_rows(docs, find_contamination(docs, benchmark, **columns).filter("n_hit > 0"))
