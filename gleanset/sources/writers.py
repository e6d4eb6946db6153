"""Writers. One job per sink, one file per task, parent folders made by Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gleanset import fixed
from gleanset.operators.ranking import with_draw


def write_jsonl(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "error") -> None:
    """JSON lines in UTF-8; a null field is written as ``null``."""
    writer = df.write.mode(mode).option("ignoreNullFields", False)
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def write_shuffled(
    df: DataFrame,
    path: str,
    files: int,
    partition_by: Sequence[str] = ("split",),
    key: Sequence[str] = ("id",),
    seed: int = fixed.SEED,
    mode: str = "error",
) -> None:
    """JSON lines in random order: read in the order of their names, the files of a folder hold its rows in
    the order of ``md5(seed:key)``, equal draws by the key. ``key`` is unique, its parts joined by colons.

    One shuffle: draws are even, so each of ``files`` tasks takes an equal stretch of them, without a look at
    the data before, sorts it, and writes one file a folder. No task sees a whole folder and nobody sorts
    it. Names keep the order up to 99,999 files; take one for some hundred megabytes.
    """
    drawn = with_draw(df.withColumn("_key", F.concat_ws(":", *key)), "_key", seed).drop("_slot")
    order = ["_draw", "_key"]
    stretch = F.expr(f"cast(cast(conv(substring(_draw, 1, 8), 16, 10) AS bigint) * {files} div {1 << 32} AS int)")
    ranged = drawn.repartitionById(files, stretch)
    # Sorted by folder first, as the writer wants it, so that it does not sort again by folder alone.
    write_jsonl(ranged.sortWithinPartitions(*partition_by, *order).drop(*order), path, partition_by, mode)


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, key: str = "id") -> DataFrame:
    """A table in ``buckets`` files by the hash of ``key``, sorted inside. Tables written alike are joined on
    the key without a shuffle. ``path`` is a shared folder; ``table`` names it in the session's catalog."""
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    writer.option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def write_csv(df: DataFrame, path: str, rows_per_file: int = 1_000_000, mode: str = "error") -> bool:
    """Headed CSV without an index column; nothing is left for an empty table.

    The table is computed once: its rows are counted while they are written.
    """
    seen = Observation()
    (
        df.observe(seen, F.count(F.lit(1)).alias("rows"))
        .write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", rows_per_file)
        .csv(path)
    )
    if seen.get["rows"]:
        return True
    if mode != "append":
        jvm = df.sparkSession._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
    return False


def write_results(df: DataFrame, path: str, partition_by: Sequence[str] = ("language",), mode: str = "error") -> None:
    """Per-example results as parquet, one folder per language."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
