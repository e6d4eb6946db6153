"""Synthetic rows: fan prompts out, generate, label, check, and sample down.

A model may be slow and need not repeat itself, so each model's answers are written to a table
once and every later step reads that table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanset import fixed
from gleanset.functions import chat
from gleanset.functions import labels as lb
from gleanset.functions.keys import with_keys
from gleanset.operators import dedup, generation, sampling
from gleanset.operators.profile import stage_funnel
from gleanset.session import materialized

Model = Callable[[], Callable[[Sequence[str]], Sequence[str]]]


def generate_snippets(
    prompts: DataFrame,
    load_model: Model,
    folder: str,
    target: int = fixed.SYNTHETIC_ATTEMPT_TARGET,
    per_prompt: int = fixed.ATTEMPTS_PER_PROMPT,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """The first ``target`` distinct texts generated from the prompts, with their attempt number.

    Attempts are made in waves, which end when there are enough texts; see
    :func:`gleanset.operators.generation.collect_in_waves`.
    """
    return generation.collect_in_waves(prompts, load_model, f"{folder}/attempts", target, per_prompt, profile)


def label_snippets(snippets: DataFrame, load_model: Model, profile: ResourceProfile | None = None) -> DataFrame:
    """(id, instruction, input, output_raw_llm, output) and the check flags, one row per answer."""
    asked = snippets.select(
        F.col("attempt").alias("id"), "text", chat.label_prompt(F.col("text")).alias("prompt")
    )
    answers = generation.answered(generation.batch_infer(asked, "prompt", load_model, profile)).drop("prompt")
    return generation.validated(generation.labelled_rows(answers))


def finish(rows: DataFrame, n: int = fixed.SYNTHETIC_ROWS, seed: int = fixed.SEED) -> DataFrame:
    """First copy of each input, rows that pass the checks, sampled down by class share.

    The draw works on narrow first copies that carry the flags and the class; texts are fetched once.
    """
    passed = F.col("label_is_valid") & F.col("input_length_ok")
    firsts = dedup.first_of_each(
        rows, ["input"], carry={"_passed": passed, "_class": F.coalesce(lb.class_index(F.col("output")), F.lit(-1))}
    )
    narrow = firsts.filter(F.col("_passed") & (F.col("_class") >= 0)).select(
        "id", lb.class_name(F.col("_class")).alias("label")
    )
    sampled = sampling.proportional_sample(rows, "output", n, seed=seed, classes=fixed.LABELS, narrow=narrow)
    return sampled.select("id", "instruction", "input", "output")


def build_synthetic(
    prompts: DataFrame,
    load_writer: Model,
    load_labeller: Model,
    folder: str,
    n: int = fixed.SYNTHETIC_ROWS,
    target: int = fixed.SYNTHETIC_ATTEMPT_TARGET,
    per_prompt: int = fixed.ATTEMPTS_PER_PROMPT,
    seed: int = fixed.SEED,
    profiles: tuple[ResourceProfile | None, ResourceProfile | None] = (None, None),
) -> DataFrame:
    """(id, instruction, input, output) rows from prompts; both models' answers go to ``folder``.

    ``profiles`` are the resources of the writer's and the labeller's stages.
    """
    texts = generate_snippets(prompts, load_writer, folder, target, per_prompt, profiles[0])
    labelled = materialized(label_snippets(texts, load_labeller, profiles[1]), f"{folder}/labelled")
    return finish(labelled, n, seed)


def synthetic_checks(labelled: DataFrame) -> DataFrame:
    """What the checks report over all rows, before any is dropped: rows, invalid labels, inputs of
    invalid length, and rows that dedup removes; one row."""
    keyed, names = with_keys(labelled, ["input"])
    return (
        keyed.groupBy(*names)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(~F.col("label_is_valid")).alias("label"),
            F.count_if(~F.col("input_length_ok")).alias("length"),
        )
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum("label"), F.lit(0)).alias("invalid_labels"),
            F.coalesce(F.sum("length"), F.lit(0)).alias("invalid_lengths"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed_by_dedup"),
        )
    )


def synthetic_funnel(labelled: DataFrame) -> DataFrame:
    """Rows left after dedup, then after the label check, then after the length check; what the checks
    find before dedup is in :func:`synthetic_checks`."""
    firsts = dedup.first_of_each(
        labelled,
        ["input"],
        carry={"label_ok": F.col("label_is_valid"), "length_ok": F.col("input_length_ok")},
    )
    stages = {"deduplicated": F.lit(True), "label_valid": F.col("label_ok"), "length_ok": F.col("length_ok")}
    return stage_funnel(firsts, stages, {"loaded": F.col("copies")})
