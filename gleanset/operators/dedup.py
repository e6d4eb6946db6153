"""Duplicate handling.

A text held by a large part of the table must not end up in one task. So the groups are first
reduced by an aggregate (combined map-side) over 32-byte keys, and rows are then kept or dropped
by a join on their unique id, which spreads evenly. Where a join on the repeated key itself
cannot be avoided, the unwanted keys are either few enough to broadcast (checked on the written
key table) or the join is salted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanset.functions.keys import free_name, text_key, with_keys, with_value_keys
from gleanset.operators.observed import Dropped
from gleanset.operators.ranking import BROADCAST_ROWS
from gleanset.session import materialized

#: Parts that one repeated key is split into where it has to be joined.
SALTS = 64


def _present(id_col: str) -> Column:
    """The id, which says which row is meant; a row without one fails the run."""
    absent = F.raise_error(F.lit(f"a row has no {id_col}, which tells rows apart and puts them in order"))
    return F.when(F.col(id_col).isNull(), absent).otherwise(F.col(id_col))


def first_of_each(
    df: DataFrame,
    keys: Sequence[str],
    order_col: str = "id",
    carry: Mapping[str, Column] | None = None,
    keep_keys: bool = False,
) -> DataFrame:
    """Narrow keep-first: one row per key with the smallest ``order_col``.

    ``carry`` names fixed-width expressions to take from that first row; ``copies`` counts the
    rows of the key. One shuffle of narrow rows, no join back to the table. ``keep_keys`` leaves the
    grouping columns (``_key0``, ..) in. A null ``order_col`` fails the run.
    """
    carry = dict(carry or {})
    keyed, names = with_keys(df, keys)
    # Digests and carried values are computed before the aggregate, so the text stops here.
    narrow = keyed.select(*names, _present(order_col).alias(order_col), *[e.alias(n) for n, e in carry.items()])
    firsts = narrow.groupBy(*names).agg(
        F.min(order_col).alias("_first"),
        F.count(F.lit(1)).alias("copies"),
        *[F.min_by(n, order_col).alias(n) for n in carry],
    )
    return (firsts if keep_keys else firsts.drop(*names)).withColumnRenamed("_first", order_col)


def _groups(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    keyed, names = with_keys(df, keys)
    return keyed.groupBy(*names).agg(F.min(_present(id_col)).alias(id_col), F.count(F.lit(1)).alias("_n"))


def _split_off(df: DataFrame, kept: DataFrame, id_col: str, folder: str | None, inside: bool) -> DataFrame:
    """The rows of ``df`` whose id is in ``kept`` (or, not ``inside``, is not in it).

    With a ``folder`` the ids that are not kept are worked out on ids alone, written there and counted.
    Few of them are broadcast, and ``df`` is not shuffled; with many, or without a folder, the join is
    a shuffle of ``df`` on the unique id. The rows are the same: an id is never null here, as a null one
    fails the run when ``kept`` is worked out, which both ways do.
    """
    if folder is not None:
        surplus = materialized(df.select(id_col).join(kept, id_col, "left_anti"), folder)
        if surplus.count() <= BROADCAST_ROWS:
            return df.join(F.broadcast(surplus), id_col, "left_anti" if inside else "left_semi")
    return df.join(kept, id_col, "left_semi" if inside else "left_anti")


def dedup_keep_first(
    df: DataFrame, keys: Sequence[str], order_col: str = "id", folder: str | None = None
) -> DataFrame:
    """Keep the first row of every key, by ``order_col``, which must be unique.

    For ``folder`` see :func:`_split_off`.
    """
    return _split_off(df, _groups(df, keys, order_col).select(order_col), order_col, folder, True)


def dedup_drop_all(df: DataFrame, keys: Sequence[str], id_col: str = "id", folder: str | None = None) -> DataFrame:
    """Drop every row whose key occurs more than once. For ``folder`` see :func:`_split_off`."""
    singles = _groups(df, keys, id_col).filter("_n = 1").select(id_col)
    return _split_off(df, singles, id_col, folder, True)


def duplicate_rows(df: DataFrame, keys: Sequence[str], id_col: str = "id", folder: str | None = None) -> DataFrame:
    """Every row whose key occurs more than once. For ``folder`` see :func:`_split_off`.

    These are the rows that are not the only one of their key, so the join is on the id and a
    key with any number of copies stays spread. Sort the result where it is shown or written.
    """
    singles = _groups(df, keys, id_col).filter("_n = 1").select(id_col)
    return _split_off(df, singles, id_col, folder, False)


def drop_listed(
    df: DataFrame,
    text_col: str,
    texts: Sequence[str] | DataFrame,
    folder: str | None = None,
    dropped: Dropped | None = None,
) -> DataFrame:
    """Drop rows whose text is in a list (or in the first column of a DataFrame).

    ``dropped`` counts what is removed and kept in the run that uses the result, without another scan.
    For ``folder`` see :func:`_drop_keys`; it only matters for a DataFrame.
    """
    if isinstance(texts, DataFrame):
        keyed, names = with_keys(df, [text_col])
        listed = texts.select(text_key(F.col(texts.columns[0])).alias(names[0])).dropna().distinct()
        # Equal rows get different parts too, unlike with a hash of the row.
        spread = F.monotonically_increasing_id()
        return _drop_keys(keyed, listed, names, spread, folder, dropped).select(*df.columns)
    unlisted = F.coalesce(~F.col(text_col).isin(list(texts)), F.lit(True))
    return df.filter(unlisted) if dropped is None else dropped.keep(df, unlisted)


def count_listed(df: DataFrame, text_col: str, texts: Sequence[str]) -> DataFrame:
    """How many rows :func:`drop_listed` removes and leaves, as one row."""
    listed = F.coalesce(F.col(text_col).isin(list(texts)), F.lit(False))
    return df.agg(F.count_if(listed).alias("removed"), F.count_if(~listed).alias("kept"))


def _same_key(names: Sequence[str]) -> Column:
    same = F.lit(True)
    for name in names:
        same = same & F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}"))
    return same


def _drop_keys(
    rows: DataFrame,
    unwanted: DataFrame,
    names: Sequence[str],
    spread_by: Column,
    folder: str | None,
    dropped: Dropped | None = None,
) -> DataFrame:
    """``left_anti`` on keys that may repeat without limit in ``rows``; a null key matches a null key.

    With a ``folder`` the unwanted keys are written there and counted: a small set is broadcast and
    ``rows`` is not shuffled at all. Otherwise each key of ``rows`` is split into :data:`SALTS`
    parts and the (narrow, distinct) unwanted keys are repeated for every part. With ``dropped`` the join
    marks the rows instead, so that they can be counted before the marked ones go.
    """
    few = False
    if folder is not None:
        unwanted = materialized(unwanted, folder)
        few = unwanted.count() <= BROADCAST_ROWS
    same, salt, mark = _same_key(names), free_name(rows, "_salt"), free_name(rows, "_listed")
    right = unwanted.withColumn(mark, F.lit(True))
    if few:
        right = F.broadcast(right)
    else:
        rows = rows.withColumn(salt, F.pmod(spread_by, F.lit(SALTS)).cast("int"))
        right = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same = same & (F.col(f"l.{salt}") == F.col(f"r.{salt}"))
    if dropped is None:
        return rows.alias("l").join(right.alias("r"), same, "left_anti").select("l.*")
    marked = rows.alias("l").join(right.alias("r"), same, "left").select("l.*", F.col(f"r.{mark}").alias(mark))
    return dropped.keep(marked, F.col(mark).isNull())


def drop_conflicting(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    within: Sequence[str] = (),
    id_col: str = "id",
    folder: str | None = None,
) -> DataFrame:
    """Drop all rows of a text that carries different labels inside the same ``within`` group.

    A null label is no label and contradicts nothing. A text under different groups stays.
    Integer labels aggregate by hash; map strings to class indexes first where that matters.
    For ``folder`` see :func:`_drop_keys`.
    """
    columns = df.columns
    keyed, names = with_keys(df, [*keys, *within])
    conflicts = (
        keyed.groupBy(*names)
        .agg(F.min(label).alias("_low"), F.max(label).alias("_high"))
        .filter("_low <> _high")
        .select(*names)
    )
    return _drop_keys(keyed, conflicts, names, F.xxhash64(F.col(id_col)), folder).select(*columns)


def duplicate_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Surplus rows per column and for whole rows (``*``), in each group of ``by``: rows minus distinct
    values.

    A null counts as one value. Each row is turned into one key per column, and the keys are
    counted together in a single aggregate.
    """
    keyed, names, whole = with_value_keys(df, columns, by)
    entries = [F.struct(F.lit(c).alias("column"), F.col(n).alias("key")) for c, n in zip(columns, names)]
    entries.append(F.struct(F.lit("*").alias("column"), whole.alias("key")))
    return (
        keyed.select(*by, F.inline(F.array(*entries)))
        .groupBy(*by, "column", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*by, "column")
        .agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"))
        .withColumn("duplicates", F.col("rows") - F.col("distinct_rows"))
    )


def distinct_sorted(df: DataFrame, col: str, id_col: str = "id", folder: str | None = None) -> DataFrame:
    """Distinct values in order. Copies are dropped by id, so a text travels for the sort only; for
    ``folder`` see :func:`_split_off`."""
    return dedup_keep_first(df.select(id_col, col), [col], id_col, folder).select(col).orderBy(col)
