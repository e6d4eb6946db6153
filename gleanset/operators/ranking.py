"""Exact ranks in a seeded draw order, without sending a group to one task.

Random draws are made reproducible by ordering rows on ``md5(seed:id)``. The first three hex
digits of that hash (the *slot*) split every group into up to 4,096 evenly filled parts, few enough
that a task combines its rows per slot before the shuffle. A rank is then ``rows in earlier slots +
row number inside the slot``: a class that holds most of the table is still ranked by many tasks, and
slots that start beyond the wanted rank are dropped before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanset import fixed

#: Hex digits of a draw that name its slot, and the slots they make.
SLOT_DIGITS = 3
SLOTS = 16**SLOT_DIGITS
#: A window group of at most this many narrow rows may be ranked by one task.
ONE_TASK_ROWS = 100_000
#: A side of at most this many (id, label)-sized rows may be broadcast.
BROADCAST_ROWS = 500_000
#: Slots of :func:`with_id_slot`, each with about as many rows.
ID_SLOTS = 256


def with_draw(df: DataFrame, id_col: str = "id", seed: int = fixed.SEED) -> DataFrame:
    """Add the draw order ``_draw`` and its slot ``_slot``."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))
    return df.withColumn("_draw", draw).withColumn("_slot", F.substring(F.col("_draw"), 1, SLOT_DIGITS))


def slot_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per (group, slot)."""
    # The joins below imply these conditions; spelled out, all uses of the counts share one shuffle.
    for key in (*by, "_slot"):
        df = df.filter(F.col(key).isNotNull())
    return df.groupBy(*by, "_slot").agg(F.count(F.lit(1)).alias("_n"))


def rank_by_slots(
    df: DataFrame,
    slots: DataFrame,
    by: Sequence[str] = (),
    upto: int | None = None,
    order: Sequence[str] = ("_draw", "id"),
    out: str = "rank",
    groups: int | None = None,
) -> DataFrame:
    """Rank rows inside each group; keep ranks up to ``upto``.

    ``slots`` holds the rows per (group, slot) of ``df``. When the number of groups is known, the
    table of slot starts has a size bound (no more slots than ranks below ``upto``) and is broadcast
    if that is small; otherwise Spark picks the join, and a shuffle on (group, slot) serves the join
    and the window alike.
    """
    earlier = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slots.select(*by, "_slot", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    if upto is not None:
        starts = starts.filter(F.col("_start") < upto)
    if groups is not None and groups * min(SLOTS, upto or SLOTS) <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    inside = Window.partitionBy(*by, "_slot").orderBy(*order)
    ranked = df.join(starts, [*by, "_slot"]).withColumn(out, F.col("_start") + F.row_number().over(inside))
    if upto is not None:
        ranked = ranked.filter(F.col(out) <= upto)
    return ranked.drop("_start")


def rank_drawn(df: DataFrame, by: Sequence[str], bound: int, out: str, groups: int = 2) -> DataFrame:
    """Rank rows of a table that holds at most ``bound`` rows in all, by draw order."""
    if bound <= ONE_TASK_ROWS:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy("_draw", "id")))
    return rank_by_slots(df, slot_counts(df, by), by, out=out, groups=groups)


def with_id_slot(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Add ``_slot``, which keeps integer ids in order and cuts them at quantiles, so that slots are
    even however far the ids are spread. ``df`` is narrow: it is read once more for the quantiles."""
    cuts = [k / ID_SLOTS for k in range(1, ID_SLOTS)]
    bounds = df.agg(F.percentile_approx(F.col(id_col), cuts, 100_000).alias("bounds")).scalar()
    below = F.size(F.filter("_bounds", lambda bound: bound <= F.col(id_col)))
    return df.withColumn("_bounds", bounds).withColumn("_slot", below).drop("_bounds")


def fetch(df: DataFrame, picked: DataFrame, id_col: str, bound: int | None) -> DataFrame:
    """Rows of ``df`` whose id is in ``picked``, with the columns of ``picked``.

    ``bound`` is the most rows ``picked`` can have. Up to :data:`BROADCAST_ROWS` they are broadcast
    and ``df`` is not shuffled; beyond that, or unbounded, the join is a shuffle on the unique id.
    """
    if bound is not None and bound <= BROADCAST_ROWS:
        picked = F.broadcast(picked)
    return df.join(picked, id_col)
