"""Exploring a labelled dataset: every profile table of one dataset, all splits in one run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanset.functions import text as tx
from gleanset.functions.keys import text_key
from gleanset.operators import dedup, profile
from gleanset.session import materialized


def explore(
    df: DataFrame,
    text: str,
    labels: Sequence[str],
    by: Sequence[str] = (),
    id_col: str = "id",
    top: int = 20,
    folder: str | None = None,
    sketch_bits: int | None = None,
) -> dict[str, DataFrame]:
    """Lazy result tables by name, per group of ``by``; each one is a single scan and its own small
    aggregate.

    The three length tables come from one frequency table. With a ``folder`` that table, the narrow
    table for the findings and the ids of duplicates are written there, so that texts are measured
    once and do not travel. With ``sketch_bits`` the table is a sketch of bounded size, and its figures are
    within :func:`gleanset.operators.profile.sketch_error`.
    """
    if sketch_bits is None:
        frequencies = profile.length_frequencies(df, text, by)
    else:
        frequencies = profile.length_sketch(df, text, by, sketch_bits)
    if folder is not None:
        frequencies = materialized(frequencies, f"{folder}/lengths")
    narrow = df.select(
        id_col, *by, *labels, text_key(F.col(text)).alias("key"), tx.word_count(F.col(text)).alias("words")
    )
    if folder is not None:
        narrow = materialized(narrow, f"{folder}/narrow")
    firsts = dedup.dedup_keep_first(narrow, [*by, "key"], id_col)
    return {
        "columns": profile.table_profile(df, by),
        "head": profile.first_rows(df, order_col=id_col, by=by),
        "values": profile.distinct_values(df, labels, by),
        "shares": profile.value_shares(df, labels, by, None if folder is None else f"{folder}/shares"),
        "surplus": dedup.duplicate_counts(df, [c for c in df.columns if c not in (id_col, *by)], by),
        "duplicates": dedup.duplicate_rows(
            df, [*by, text], id_col, None if folder is None else f"{folder}/duplicates"
        ),
        "lengths": profile.describe_lengths(frequencies, by),
        "histogram": profile.length_histogram(frequencies, by),
        "box": profile.box_figures(frequencies, by),
        "words": profile.top_words(df, text, top, by),
        "findings": profile.findings(firsts, labels, "words", "key", by),
    }
