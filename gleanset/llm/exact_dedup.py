"""Exact deduplication by distributed most-significant-digit radix partitioning.

Documents are split by length and their first bytes, then each group by its next bytes, and so on,
until a group is a single document or its texts have ended. What is then still together is equal byte
for byte, so no digest decides. The digits get wider from round to round, so the number of rounds is
the logarithm of the longest text that has a copy. A group is never gathered in a task: its size and
the document it keeps are an aggregate, combined before the shuffle, and rows learn them by a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanset.llm.rows import BROADCAST_BYTES, lower_ascii, numbered, stored, without_rows

#: Bytes of the first digit, and by how much each later digit is wider.
FIRST_DIGIT, WIDER = 64, 16
#: Bits of the filter of open keys: for each key, in a page (fixed by Spark's bitmap functions), and at most.
BITS_A_KEY, PAGE, MOST_BITS = 32, 1 << 15, 1 << 27


def _digit(text: Column, n_bytes: int) -> Column:
    return F.substring(text, 1, n_bytes)


def _split(rows: DataFrame, by: list[str]) -> DataFrame:
    """The groups of two rows or more under ``by``, written: ``_group``, ``_n`` and ``_top``, the row that stays."""
    groups = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.struct("_id", "_row")).alias("_top")
    )
    return stored(groups.filter("_n > 1").withColumn("_group", F.monotonically_increasing_id()), "radix-groups")


def _joinable(groups: DataFrame) -> DataFrame:
    """Marked for broadcast if its measured bytes are few; otherwise AQE joins and splits hot keys."""
    size = groups.agg(F.sum(F.octet_length("_digit") + 64)).first()[0] or 0
    return F.broadcast(groups) if size <= BROADCAST_BYTES else groups


def _passing(rows: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """The rows whose key may be among the (written) keys: all of those whose key is, and few others.

    A bitmap with a bit for each hash, of at most :data:`MOST_BITS` (16 MB), goes to the tasks, so that what
    is shuffled for the exact join that follows, texts included, is near what that join lets through.
    """
    n = keys.count()
    bits = min(MOST_BITS, max(PAGE, 1 << (BITS_A_KEY * n).bit_length()))
    place = F.pmod(F.xxhash64(*by), F.lit(bits))
    page, at = F.shiftright(place, PAGE.bit_length() - 1), place.bitwiseAND(F.lit(PAGE - 1))
    bitmap = keys.groupBy(page.alias("_page")).agg(F.bitmap_construct_agg(at).alias("_bitmap"))
    byte = F.conv(F.hex(F.substring("_bitmap", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.pmod(at, F.lit(8)).cast("int")
    return (
        rows.withColumn("_page", page)
        .join(F.broadcast(bitmap), "_page")
        .filter(F.floor(byte / F.pow(F.lit(2), bit)) % 2 == 1)
        .drop("_page", "_bitmap")
    )


def _decided(rows: DataFrame) -> DataFrame:
    alone = F.col("_n").isNull()
    return rows.select(
        "_row",
        "_id",
        F.when(alone, F.col("_id")).otherwise(F.col("_top._id")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_row") == F.col("_top._row"))).alias("kept"),
        "text_sha256",
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``_row``, id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row
    with the largest id stays (a null id is smaller than any other), of rows with that id the last one
    as the table is read, so exactly one row of a group is ``kept``. An empty table gives no rows; other
    columns are not read. ``docs`` is a table: it is read more than once, see :func:`rows.numbered`.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = numbered(docs.select(F.col(id_col).alias("_id"), text.alias("_text")))
    head = _digit(F.encode(lower_ascii(F.substring("_text", 1, FIRST_DIGIT)), "UTF-8"), FIRST_DIGIT)
    first = source.withColumns({"_bytes": F.octet_length("_text"), "_digit": head})
    by = ["_bytes", "_digit"]
    split = _split(first.select("_id", "_row", *by), by)
    groups = _joinable(split)
    whole = F.encode(lower_ascii(F.col("_text")), "UTF-8")
    narrow = first.select("_id", "_row", *by, F.sha2(whole, 256).alias("text_sha256"))
    ended = F.col("_n").isNull() | (F.col("_bytes") <= FIRST_DIGIT)
    done = [_decided(narrow.join(groups, by, "left").filter(ended))]
    longer = split.filter(F.col("_bytes") > FIRST_DIGIT)
    open_ = (
        _passing(first.filter(F.col("_bytes") > FIRST_DIGIT), longer, by)
        .join(longer, by)
        .withColumn("_whole", whole)
        .select(
            "_id", "_row", "_group", F.sha2("_whole", 256).alias("text_sha256"),
            F.substring("_whole", FIRST_DIGIT + 1, 2147483647).alias("_rest"),
        )
    )
    width = FIRST_DIGIT
    while True:
        open_ = stored(open_, "radix-open")
        if open_.isEmpty():
            break
        width *= WIDER
        rows = open_.withColumnsRenamed({"_group": "_parent"}).withColumn("_digit", _digit(F.col("_rest"), width))
        by = ["_parent", "_digit"]
        groups = _joinable(_split(rows.select("_id", "_row", *by), by))
        ends = F.octet_length("_rest") <= width
        joined = rows.join(groups, by, "left")
        done.append(_decided(joined.filter(F.col("_n").isNull() | ends)))
        open_ = joined.filter(F.col("_n").isNotNull() & ~ends).select(
            "_id", "_row", "_group", "text_sha256", F.substring("_rest", width + 1, 2147483647).alias("_rest")
        )
    return reduce(DataFrame.unionByName, done).withColumnRenamed("_id", id_col)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of :func:`exact_groups`, which says how ties, nulls and repeated
    rows are treated: one row of null and empty texts stays, and an empty table stays empty. All columns
    come back as they are, whatever they are called. ``docs`` is a table, see :func:`rows.numbered`."""
    return without_rows(docs, exact_groups(docs, id_col, text_col).filter("NOT kept"))
