"""What the operators share: row numbers, scratch tables, dropping rows, reading columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanset.functions.keys import free_name
from gleanset.session import materialized, scratch_path

#: A table of dropped row numbers (8 bytes each) is broadcast up to so many rows; counted first.
BROADCAST_IDS = 500_000
#: A table of groups is broadcast up to so many bytes of keys; measured first.
BROADCAST_BYTES = 16_000_000
#: Python code handles so many characters of text at a time, whatever the Arrow batch holds.
PART_CHARS = 1_000_000


def numbered(docs: DataFrame, name: str = "_row") -> DataFrame:
    """Number the rows. The same numbers come out of every read of the same files, so ``docs`` is a
    table (or a narrow selection of one), not the result of a shuffle."""
    return docs.withColumn(name, F.monotonically_increasing_id())


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write under the shared scratch folder and read back: cuts the lineage, survives executors."""
    return materialized(df, scratch_path(df.sparkSession, name))


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose :func:`numbered` number is in ``dropped._row``. The columns of
    ``docs`` come back as they are, whatever they are called."""
    row = free_name(docs, "_row")
    gone = stored(dropped.select(F.col("_row").alias(row)), "dropped")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return numbered(docs, row).join(gone, row, "left_anti").drop(row)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def parts(values: list, sizes: list[int] | None = None):
    """Slices (start, stop) of ``values`` holding about :data:`PART_CHARS` each, one value at least."""
    start, size = 0, 0
    for i, value in enumerate(values):
        size += len(value) if sizes is None else sizes[i]
        if size >= PART_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(values):
        yield start, len(values)
