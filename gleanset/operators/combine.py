"""Projection to instruction records, unions and positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanset import fixed
from gleanset.operators import ranking as rk


def to_instructions(df: DataFrame, text: str, label: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Project to the constant instruction, the input and the output."""
    return df.select(
        *keep,
        F.lit(fixed.INSTRUCTION).alias("instruction"),
        F.col(text).alias("input"),
        F.col(label).alias("output"),
    )


def tagged_union(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """All rows of all parts, duplicates kept, each with the name of its part in ``tag``."""
    return reduce(DataFrame.unionByName, [df.withColumn(tag, F.lit(name)) for name, df in parts.items()])


def position_language(df: DataFrame, id_col: str = "id", first: str = "EN", second: str = "VI") -> DataFrame:
    """Add each row's position in id order and the language its half of the table stands for.

    Only ids are ranked, slot by slot, and joined back; the row count and the positions come from one
    table of rows per slot, so no task sees more than the ids of one slot.
    """
    ids = rk.with_id_slot(df.select(id_col), id_col)
    slots = rk.slot_counts(ids)
    total = slots.agg(F.sum("_n").alias("n")).scalar()
    ranked = rk.rank_by_slots(ids, slots, order=(id_col,), out="position").drop("_slot")
    placed = df.join(ranked, id_col)
    return placed.withColumn("position", F.col("position") - 1).withColumn(
        "language", F.when(F.col("position") < total / 2, first).otherwise(second)
    )
