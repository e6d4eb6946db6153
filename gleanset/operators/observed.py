"""Counts that a run makes of its own rows while it writes them.

A count of each stage by a job of its own reads the data again. Here the rows carry what is needed, an
observation sums it up on the way, and the figures are there when the run has ended.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gleanset.operators.profile import stage_tallies


class StageCounts:
    """Rows left after each stage, as :func:`gleanset.operators.profile.stage_funnel` has them, from the
    run that needs the rows anyway.

    :meth:`watch` goes into the plan; :meth:`table` waits for the first action over that plan. Where the
    plan uses the watched rows several times, a shuffle that is reused is counted where it runs, and any
    other use counts the same rows. Tasks of a stage that is run again after a loss are counted again, as
    Spark does with all observed figures.
    """

    def __init__(self) -> None:
        self._seen, self._names = Observation(), []

    def watch(
        self, rows: DataFrame, stages: Mapping[str, Column], weights: Mapping[str, Column] | None = None
    ) -> DataFrame:
        if self._names:
            raise ValueError("these counts watch other rows already")
        self._names = ["loaded", *stages]
        tallies = stage_tallies(stages, weights)
        return rows.observe(self._seen, *[t.alias(f"_s{i}") for i, t in enumerate(tallies)])

    def counts(self) -> dict[str, int]:
        if not self._names:
            raise ValueError("nothing is watched")
        figures = self._seen.get
        return {name: figures[f"_s{i}"] for i, name in enumerate(self._names)}

    def table(self, spark: SparkSession) -> DataFrame:
        """(step, stage, rows_left)."""
        rows = [(i, name, n) for i, (name, n) in enumerate(self.counts().items())]
        return spark.createDataFrame(rows, "step bigint, stage string, rows_left bigint")


class Dropped:
    """How many rows a filter removed and kept, from the run that applied it."""

    def __init__(self) -> None:
        self._seen = Observation()

    def keep(self, rows: DataFrame, kept: Column) -> DataFrame:
        """``rows`` where ``kept`` holds; the others are counted and dropped."""
        counted = rows.observe(self._seen, F.count_if(~kept).alias("removed"), F.count_if(kept).alias("kept"))
        return counted.filter(kept)

    @property
    def removed(self) -> int:
        return self._seen.get["removed"]

    @property
    def kept(self) -> int:
        return self._seen.get["kept"]

    def table(self, spark: SparkSession) -> DataFrame:
        """(removed, kept), one row."""
        return spark.createDataFrame([(self.removed, self.kept)], "removed bigint, kept bigint")


def all_stages(counts: Mapping[str, StageCounts], spark: SparkSession, tag: str) -> DataFrame:
    """The tables of several counts, each with its name in ``tag``."""
    rows: Sequence[tuple] = [
        (name, i, stage, n) for name, one in counts.items() for i, (stage, n) in enumerate(one.counts().items())
    ]
    return spark.createDataFrame(rows, f"{tag} string, step bigint, stage string, rows_left bigint")
