"""Readers. Every one takes an explicit schema; nothing is inferred from the data."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INSTRUCTION_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("instruction", "input", "output")]
)


def read_labelled(
    spark: SparkSession, path: str, split: str | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """A labelled parquet dataset, optionally one value of its ``split`` column or partition."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    return df if split is None else df.filter(F.col("split") == split)


def read_all_splits(spark: SparkSession, paths: dict[str, str], schema: T.StructType | None = None) -> DataFrame:
    """All splits of a dataset in one table, each row tagged with its ``split``."""
    parts = [
        read_labelled(spark, path, schema=schema).withColumn("split", F.lit(name)) for name, path in paths.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def read_instructions(spark: SparkSession, path: str, schema: T.StructType = INSTRUCTION_SCHEMA) -> DataFrame:
    """Instruction records from JSON lines; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


#: What :func:`gleanset.plans.datasets.write_dataset` writes.
DATASET_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), *INSTRUCTION_SCHEMA.fields]
    + [T.StructField(name, T.StringType()) for name in ("split", "language")]
)


def read_dataset(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A written dataset with its ids, splits and languages; a filter on either prunes folders."""
    df = read_instructions(spark, path, DATASET_SCHEMA)
    return df if split is None else df.filter(F.col("split") == split)


#: Where readers that go on put a line they cannot read.
BROKEN = "_broken"


def _csv_reader(spark: SparkSession, mode: str):
    return (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("enforceSchema", False)
        .option("mode", mode)
        .option("columnPruning", False)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
    )


def read_csv(
    spark: SparkSession, path: str, required: Sequence[str] = ("instruction", "input", "output")
) -> DataFrame:
    """A headed CSV with quoted quotes and line breaks; fails when a required column is missing.

    All columns are strings. Reading fails on a file whose header differs from the first one's and on
    a row with more or fewer fields. Quoted line breaks keep one file in one task, so write CSV in
    many files.
    """
    df = _csv_reader(spark, "FAILFAST").csv(path)
    _require(path, df.columns, required)
    return df


def _require(path: str, columns: Sequence[str], required: Sequence[str]) -> None:
    missing = sorted(set(required) - set(columns))
    if missing:
        raise ValueError(f"CSV at {path} lacks {missing}; it has {list(columns)}")


@dataclass(frozen=True)
class Checked:
    """What a reader that goes on makes of its files: the good records, and ``file``, ``record``, ``reason``
    of every other one. Both come from one written table, so the files are read once."""

    good: DataFrame
    rejects: DataFrame


def _checked(parsed: DataFrame, columns: Sequence[str], required: Sequence[str], folder: str) -> Checked:
    """``parsed`` has the columns, :data:`BROKEN` with the text of an unreadable record, and ``_file``."""
    lacking = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    reason = F.when(F.col(BROKEN).isNotNull(), F.lit("malformed")).when(
        F.size(lacking) > 0, F.concat(F.lit("lacks "), F.array_join(lacking, ", "))
    )
    written = parsed.withColumns({"_reason": reason, "_rejected": reason.isNotNull()})
    written.write.partitionBy("_rejected").parquet(folder)
    stored = parsed.sparkSession.read.schema(written.schema).parquet(folder)
    record = F.coalesce(F.col(BROKEN), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    return Checked(
        stored.filter("NOT _rejected").select(*columns),
        stored.filter("_rejected").select(
            F.col("_file").alias("file"), record.alias("record"), F.col("_reason").alias("reason")
        ),
    )


def check_instructions(
    spark: SparkSession,
    path: str,
    folder: str,
    schema: T.StructType = INSTRUCTION_SCHEMA,
    required: Sequence[str] = ("instruction", "input", "output"),
) -> Checked:
    """:func:`read_instructions` that goes on: a malformed line is a reject (``malformed``, with the line), and
    so is a record without a required field (``lacks input, output``, with the record). Blank lines are no
    records. What was read is written once to the new ``folder``."""
    wide = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    reader = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN)
    parsed = reader.json(path).withColumn("_file", F.col("_metadata.file_name"))
    return _checked(parsed, schema.names, required, folder)


def check_csv(
    spark: SparkSession, path: str, folder: str, required: Sequence[str] = ("instruction", "input", "output")
) -> Checked:
    """:func:`read_csv` that goes on: a row with other than the header's number of fields is a reject, and so
    is one without a required field. A header that lacks a required column still fails."""
    columns = _csv_reader(spark, "FAILFAST").csv(path).columns
    _require(path, columns, required)
    wide = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, BROKEN]])
    reader = _csv_reader(spark, "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN)
    parsed = reader.schema(wide).csv(path).withColumn("_file", F.col("_metadata.file_name"))
    return _checked(parsed, columns, required, folder)
