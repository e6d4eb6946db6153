"""Scoring two models on the eval set."""

from __future__ import annotations

import uuid

from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanset import fixed
from gleanset.functions import chat
from gleanset.operators import generation, metrics
from gleanset.plans.synthetic import Model
from gleanset.session import materialized
from gleanset.sources.readers import read_dataset
from gleanset.sources.writers import write_bucketed

PREDICTIONS = {"baseline": "baseline_prediction", "finetuned": "finetuned_prediction"}


def with_prompt(rows: DataFrame, template: chat.ChatTemplate = chat.ChatTemplate()) -> DataFrame:
    """Add the inference prompt: system and user turn, then an open assistant turn."""
    messages = chat.to_messages(F.col("instruction"), F.col("input"), system=fixed.SYSTEM_PROMPT)
    return rows.withColumn("prompt", chat.render_chat(messages, template, add_generation_prompt=True))


def answer_all(
    eval_rows: DataFrame, baseline: Model, finetuned: Model, profile: ResourceProfile | None = None
) -> DataFrame:
    """Both models' raw answers next to (id, language, instruction, input, output) rows.

    The models run one after the other over the same partitions, so there is no join. A failing
    prompt stops the run here, as it would leave an example unscored. ``profile`` has the resources of
    the stage that runs them.
    """
    asked = with_prompt(eval_rows)
    for name, load in (("baseline", baseline), ("finetuned", finetuned)):
        asked = generation.batch_infer(asked, "prompt", load, profile)
        broken = F.concat(F.lit(f"{name} failed: "), F.col("error"))
        raw = F.when(F.col("error").isNotNull(), F.raise_error(broken)).otherwise(F.col("raw"))
        asked = asked.withColumn(f"{name}_raw_output", raw).drop("raw", "error")
    return asked.select(
        "id",
        "language",
        "instruction",
        F.col("input").alias("input_text"),
        F.col("output").alias("ground_truth"),
        "baseline_raw_output",
        "finetuned_raw_output",
    )


def stored_by_id(df: DataFrame, folder: str, name: str, buckets: int) -> DataFrame:
    """Examples or answers as a table in ``buckets`` files by id, under ``folder``.

    Examples are stored so once, when the eval set is made; the answers of each model as they come. Tables
    with as many buckets are joined by :func:`joined_answers` where they lie. The catalog name is new.
    """
    return write_bucketed(df, f"{name}_{uuid.uuid4().hex}", f"{folder}/{name}", buckets)


def joined_answers(
    examples: DataFrame, baseline: DataFrame, finetuned: DataFrame, missing: str = "fail"
) -> DataFrame:
    """Tables of :func:`stored_by_id` with equal buckets, joined for :func:`counts_of` or the details.

    No text and no answer is shuffled: a task reads the same bucket of all three. ``examples`` has (id,
    language, instruction, input_text, ground_truth), the answers (id, raw).
    """
    return metrics.with_answers(examples, baseline, finetuned, missing)


def counts_of(answers: DataFrame) -> DataFrame:
    """The confusion counts of both models, overall and per language."""
    return metrics.confusion_counts(metrics.melt_predictions(metrics.detailed_results(answers), PREDICTIONS))


def evaluate(answers: DataFrame, folder: str | None = None) -> dict[str, DataFrame]:
    """Every result table of an evaluation.

    All but the details come from the confusion counts; with a ``folder`` those are written there,
    so that the answers are parsed once for all of them.
    """
    counts = counts_of(answers)
    if folder is not None:
        counts = materialized(counts, f"{folder}/counts")
    return {
        "details": metrics.detailed_results(answers),
        "unparseable": metrics.unparseable_rate(counts),
        "accuracy": metrics.accuracies(counts),
        "classes": metrics.class_report(counts),
        "averages": metrics.average_report(counts),
        "confusion": metrics.confusion_dense(counts),
        "comparison": metrics.model_comparison(counts),
        "metrics": metrics.metric_table(counts),
    }


def run_models(
    eval_rows: DataFrame, baseline: Model, finetuned: Model, folder: str, profile: ResourceProfile | None = None
) -> dict[str, DataFrame]:
    """Ask both models, keep their answers in ``folder``, and score them."""
    answers = materialized(answer_all(eval_rows, baseline, finetuned, profile), f"{folder}/answers")
    return evaluate(answers, folder)


def evaluate_files(
    spark: SparkSession,
    dataset_path: str,
    baseline: Model,
    finetuned: Model,
    folder: str,
    profile: ResourceProfile | None = None,
) -> dict[str, DataFrame]:
    """Score two models on the eval split of a written dataset, with its ids and languages."""
    return run_models(read_dataset(spark, dataset_path, "eval"), baseline, finetuned, folder, profile)
