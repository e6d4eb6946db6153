"""Profiles of a table: counts, shares, lengths, words and findings.

Each profile is one scan into a small frequency table, combined map-side; everything else is
computed from that table. ``by`` lets one run cover all datasets and splits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanset import fixed
from gleanset.functions import text as tx
from gleanset.operators.ranking import BROADCAST_ROWS
from gleanset.session import materialized


def _attach(table: DataFrame, figures: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Add per-group figures to a frequency table; a null group is a group."""
    same = F.lit(True)
    for name in groups:
        same = same & F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}"))
    added = [F.col(f"r.{c}") for c in figures.columns if c not in groups]
    return table.alias("l").join(figures.alias("r"), same).select("l.*", *added)


def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(column, value, n) for every listed column; null is not counted."""
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    return (
        df.select(*by, F.inline(F.array(*entries)))
        .filter(F.col("value").isNotNull())
        .groupBy(*by, "column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def value_shares(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), folder: str | None = None
) -> DataFrame:
    """:func:`value_counts` with the share and percentage inside each column.

    With groups their totals have to be joined, and one group may have most of the values. With a
    ``folder`` counts and totals are written there: few totals are broadcast, so that the counts stay
    where they are, and many are joined as a written table, which lets AQE split a large group.
    """
    counts = value_counts(df, columns, by)
    groups = [*by, "column"]
    # Without groups there is one total per listed column, so the values are not shuffled for them.
    few = not by
    if by and folder is not None:
        counts = materialized(counts, f"{folder}/counts")
    totals = counts.groupBy(*groups).agg(F.sum("n").alias("_total"))
    if by and folder is not None:
        totals = materialized(totals, f"{folder}/totals")
        few = totals.count() <= BROADCAST_ROWS
    joined = _attach(counts, F.broadcast(totals) if few else totals, groups)
    share = F.col("n") / F.col("_total")
    return joined.select(*counts.columns, share.alias("share"), (share * 100).alias("percent"))


def ordered_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Largest count first, equal counts by value."""
    return counts.orderBy(*by, "column", F.col("n").desc(), "value")


def distinct_values(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(column, value) pairs that occur; a null is listed too."""
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(*by, F.inline(F.array(*entries))).distinct()


def table_profile(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Type, rows, non-null and null count of every column, in one pass."""
    fields = [f for f in df.schema.fields if f.name not in by]
    counted = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(f.name).alias(f"_c{i}") for i, f in enumerate(fields)]
    )
    entries = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.col("_rows").alias("rows"),
            F.col(f"_c{i}").alias("non_null"),
            (F.col("_rows") - F.col(f"_c{i}")).alias("nulls"),
        )
        for i, f in enumerate(fields)
    ]
    return counted.select(*by, F.inline(F.array(*entries)))


def null_profile(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return table_profile(df, by).select(*by, "column", "nulls")


def first_rows(df: DataFrame, n: int = 5, order_col: str = "id", by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows, or those of each group of ``by`` (every task sends on ``n`` rows a group)."""
    if not by:
        return df.orderBy(order_col).limit(n)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order_col))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def length_frequencies(df: DataFrame, text_col: str, by: Sequence[str] = ()) -> DataFrame:
    """(measure, length, n): how many texts have each character and word length."""
    text = F.col(text_col)
    entries = F.array(
        F.struct(F.lit("char").alias("measure"), tx.char_length(text).alias("length")),
        F.struct(F.lit("word").alias("measure"), tx.word_count(text).alias("length")),
    )
    return (
        df.filter(text.isNotNull())
        .select(*by, F.inline(entries))
        .groupBy(*by, "measure", "length")
        .agg(F.count(F.lit(1)).alias("n"))
    )


#: Leading bits that a sketch keeps of a length.
SKETCH_BITS = 8


def sketch_error(bits: int = SKETCH_BITS) -> float:
    """By how much, as a part of it, a length of a sketch differs from the true one at most."""
    return 2.0**-bits


def length_sketch(
    df: DataFrame, text_col: str, by: Sequence[str] = (), bits: int = SKETCH_BITS
) -> DataFrame:
    """:func:`length_frequencies` of rounded lengths: a sketch of bounded size that can be merged.

    A length keeps its ``bits`` leading bits and stands in the middle of all lengths that share them, so a
    group has at most ``2 ** (bits - 1)`` entries for each doubling of the lengths, however many texts and
    different lengths it has. Lengths below ``2 ** bits`` are exact; all others, and so every quantile, mean,
    minimum and maximum taken from the sketch by :func:`describe_lengths` or :func:`box_figures`, differ by
    at most :func:`sketch_error` of the true figure. Counts are exact. Whiskers and outliers are those of the
    sketch: a length that near a whisker's end may fall on its other side.
    """
    text = F.col(text_col)
    entries = F.array(
        F.struct(F.lit("char").alias("measure"), tx.char_length(text).alias("length")),
        F.struct(F.lit("word").alias("measure"), tx.word_count(text).alias("length")),
    )
    width = F.expr(f"shiftleft(1L, greatest(length(bin(length)) - {bits}, 0))")
    return (
        df.filter(text.isNotNull())
        .select(*by, F.inline(entries))
        .withColumn("_width", width)
        .groupBy(*by, "measure", F.expr("length - length % _width + (_width - 1) div 2").alias("length"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merge_sketches(sketches: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """The sketch of all texts of several sketches with the same ``bits``, or that of fewer groups: ``by``
    names the groups to keep."""
    columns = [*by, "measure", "length"]
    together = reduce(DataFrame.unionByName, [s.select(*columns, "n") for s in sketches])
    return together.groupBy(*columns).agg(F.sum("n").alias("n"))


def _quartiles() -> Column:
    # Weighted by frequency: the aggregate holds distinct lengths, not rows.
    return F.percentile("length", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))


def describe_lengths(freq: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample standard deviation, minimum, quartiles and maximum."""
    wide = "decimal(38,0)"
    weight, length = F.col("n").cast(wide), F.col("length").cast(wide)
    sums = freq.groupBy(*by, "measure").agg(
        F.sum("n").alias("count"),
        F.sum((weight * length).cast(wide)).alias("_s1"),
        F.sum((weight * length * length).cast(wide)).alias("_s2"),
        F.min("length").alias("min"),
        _quartiles().alias("_q"),
        F.max("length").alias("max"),
    )
    count = F.col("count").cast("double")
    s1 = F.col("_s1").cast("double")
    spread = (
        F.col("count").cast(wide) * F.col("_s2") - F.col("_s1") * F.col("_s1")
    ).cast("double")
    return sums.select(
        *by,
        "measure",
        "count",
        (s1 / count).alias("mean"),
        F.sqrt(F.try_divide(spread, count * (count - 1))).alias("std"),
        "min",
        F.col("_q")[0].alias("q25"),
        F.col("_q")[1].alias("q50"),
        F.col("_q")[2].alias("q75"),
        "max",
    )


def length_histogram(freq: DataFrame, by: Sequence[str] = (), bins: int = fixed.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins from the smallest to the largest length, empty bins included.

    The last bin holds its upper edge. A single length gets a bin range half a unit to each side.
    """
    groups = [*by, "measure"]
    # Naming n keeps this branch on the same aggregate, so the texts are measured once for both.
    edges = freq.filter("n > 0").groupBy(*groups).agg(F.min("length").alias("lo"), F.max("length").alias("hi"))
    position = F.expr(
        f"CASE WHEN lo = hi THEN {bins // 2} ELSE least((length - lo) * {bins} div nullif(hi - lo, 0), {bins - 1}) END"
    )
    counted = (
        _attach(freq, edges, groups)
        .groupBy(*groups, "lo", "hi", position.alias("bin"))
        .agg(F.sum("n").alias("n"))
    )
    # At most one entry per bin, so the map of a group has a fixed size.
    filled = counted.groupBy(*groups, "lo", "hi").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_filled")
    )
    flat = F.col("lo") == F.col("hi")
    start = F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo").cast("double"))
    width = F.when(flat, F.lit(1.0)).otherwise((F.col("hi") - F.col("lo")).cast("double")) / bins
    every_bin = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint")))
    return filled.withColumn("bin", every_bin).select(
        *groups,
        "bin",
        (start + F.col("bin") * width).alias("lower"),
        (start + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce(F.try_element_at("_filled", F.col("bin")), F.lit(0)).alias("n"),
    )


def box_figures(freq: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whisker ends at 1.5 times the quartile range, and outliers beyond them."""
    stats = freq.groupBy(*by, "measure").agg(_quartiles().alias("_q"))
    reach = 1.5 * (F.col("_q")[2] - F.col("_q")[0])
    inside = F.col("length").between(F.col("_q")[0] - reach, F.col("_q")[2] + reach)
    return (
        _attach(freq, stats, [*by, "measure"])
        .groupBy(*by, "measure")
        .agg(
            F.max(F.col("_q")[0]).alias("q25"),
            F.max(F.col("_q")[1]).alias("q50"),
            F.max(F.col("_q")[2]).alias("q75"),
            F.min(F.when(inside, F.col("length"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("length"))).alias("whisker_high"),
            F.sum(F.when(inside, F.lit(0)).otherwise(F.col("n"))).alias("outliers"),
        )
    )


def with_word_length(df: DataFrame, text_col: str, lengths: Sequence[int]) -> DataFrame:
    """Rows whose text has one of the given word counts."""
    return df.withColumn("word_length", tx.word_count(F.col(text_col))).filter(F.col("word_length").isin(list(lengths)))


def word_length_counts(df: DataFrame, text_col: str, lengths: Sequence[int]) -> DataFrame:
    """How many texts have each of the given word counts, zero included."""
    count = tx.word_count(F.col(text_col))
    hits = df.select(count.alias("_w")).agg(*[F.count_if(F.col("_w") == n).alias(f"_{n}") for n in lengths])
    entries = [F.struct(F.lit(n).cast("bigint").alias("word_length"), F.col(f"_{n}").alias("n")) for n in lengths]
    return hits.select(F.inline(F.array(*entries)))


def word_counts(df: DataFrame, text_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Occurrences of every lower-cased alphabetic token."""
    return (
        df.select(*by, F.explode(tx.alphabetic_tokens(F.col(text_col))).alias("word"))
        .groupBy(*by, "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_words(df: DataFrame, text_col: str, n: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """The ``n`` most common tokens (of each group of ``by``); equal counts by word."""
    counts, order = word_counts(df, text_col, by), [F.col("n").desc(), F.col("word")]
    if not by:
        return counts.orderBy(*order).limit(n)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return counts.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def findings(
    rows: DataFrame, labels: str | Sequence[str], words: str, key: str, by: Sequence[str] = ()
) -> DataFrame:
    """Warnings about a dataset (about each group of ``by``) as (finding, value, flagged).

    ``rows`` is narrow: labels, a word count and a text key per row. Class share below the floor
    (``class_share``, or ``class_share_<label>`` for each of a list), texts over and under the length
    thresholds, and surplus copies of a text.
    """
    named = {"class_share": labels} if isinstance(labels, str) else {f"class_share_{c}": c for c in labels}
    # A row counts once for each of its classes and once for its text, in one aggregate.
    unmeasured = F.lit(None).cast("bigint").alias("words")
    entries = [
        F.struct(F.lit(name).alias("kind"), F.col(c).cast("string").cast("binary").alias("value"), unmeasured)
        for name, c in named.items()
    ]
    entries.append(
        F.struct(F.lit("text").alias("kind"), F.col(key).alias("value"), F.col(words).cast("bigint").alias("words"))
    )
    counted = rows.select(*by, F.inline(F.array(*entries))).groupBy(*by, "kind", "value").agg(
        F.count(F.lit(1)).alias("n"), F.max("words").alias("longest"), F.min("words").alias("shortest")
    )
    shares = {}
    for i, name in enumerate(named):
        size = F.when((F.col("kind") == name) & F.col("value").isNotNull(), F.col("n"))
        shares[f"share{i}"] = F.min(size) / F.sum(size)
    facts = counted.groupBy(*by).agg(
        *[share.alias(column) for column, share in shares.items()],
        F.max("longest").cast("double").alias("longest"),
        F.min("shortest").cast("double").alias("shortest"),
        F.coalesce(F.sum(F.when(F.col("kind") == "text", F.col("n") - 1)), F.lit(0)).cast("double").alias("surplus"),
    )
    checks = [
        *[(name, c, F.col(c) < fixed.SHARE_FLOOR) for name, c in zip(named, shares)],
        ("longest_words", "longest", F.col("longest") > fixed.LONG_TEXT_WORDS),
        ("shortest_words", "shortest", F.col("shortest") < fixed.SHORT_TEXT_WORDS),
        ("duplicate_texts", "surplus", F.col("surplus") > 0),
    ]
    rows = [
        F.struct(F.lit(name).alias("finding"), F.col(col).alias("value"), test.alias("flagged"))
        for name, col, test in checks
    ]
    return facts.select(*by, F.inline(F.array(*rows)))


def stage_tallies(stages: Mapping[str, Column], weights: Mapping[str, Column] | None = None) -> list[Column]:
    """Aggregates of the rows left: all of them (``loaded``), then after each stage; see :func:`stage_funnel`."""
    weights = weights or {}
    passed, tallies = F.lit(True), []
    for name, condition in [("loaded", F.lit(True)), *stages.items()]:
        passed = passed & F.coalesce(condition, F.lit(False))
        left = F.sum(F.when(passed, weights.get(name, F.lit(1))))
        tallies.append(F.coalesce(left, F.lit(0)).cast("bigint"))
    return tallies


def stage_funnel(
    rows: DataFrame,
    stages: Mapping[str, Column],
    weights: Mapping[str, Column] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows left after each stage, from one aggregate.

    ``stages`` maps a stage to the condition a row must meet there; later stages see only rows
    that met the earlier ones. ``weights`` says, per stage (the first one is ``loaded``), how many
    raw rows a row stands for where that is not one.
    """
    tallies = stage_tallies(stages, weights)
    counted = rows.groupBy(*by).agg(*[t.alias(f"_s{i}") for i, t in enumerate(tallies)])
    entries = [
        F.struct(F.lit(i).cast("bigint").alias("step"), F.lit(name).alias("stage"), F.col(f"_s{i}").alias("rows_left"))
        for i, name in enumerate(["loaded", *stages])
    ]
    return counted.select(*by, F.inline(F.array(*entries)))
