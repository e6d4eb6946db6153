"""Grouping keys that keep long text out of shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_key(text: Column) -> Column:
    """SHA-256 of a text as 32 bytes: equal texts, equal keys; null stays null.

    Grouping on it instead of the text bounds the shuffled key at 32 bytes per row.
    No two different inputs with the same SHA-256 are known, so it stands in for equality.
    """
    return F.unhex(F.sha2(text, 256))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Add one grouping column per key: strings as :func:`text_key`, the rest as they are. Their names are
    ``_key0``, ``_key1``, .. or longer ones where the table has these."""
    names = []
    for i, key in enumerate(keys):
        names.append(free_name(df, f"_key{i}"))
        is_text = isinstance(df.schema[key].dataType, T.StringType)
        df = df.withColumn(names[-1], text_key(F.col(key)) if is_text else F.col(key))
    return df, names


def with_value_keys(
    df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()
) -> tuple[DataFrame, list[str], Column]:
    """One 32-byte key per column and one for the whole row; a null is a value of its own. Columns to
    ``keep`` stay as they are.

    Returns the table of column keys, their names, and the row key as an expression on them.
    """
    names = [f"_value{i}" for i in range(len(columns))]
    keys = [
        F.coalesce(text_key(F.col(c).cast("string")), F.lit(b"")).alias(n) for c, n in zip(columns, names)
    ]
    # A null has no bytes and every other key has 32, so the lengths keep the parts apart.
    parts = [F.concat(F.length(n).cast("string"), F.hex(n)) for n in names]
    return df.select(*keep, *keys), names, F.unhex(F.sha2(F.concat_ws("|", *parts), 256))
