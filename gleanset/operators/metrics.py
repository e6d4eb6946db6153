"""Classification metrics of one or more models, overall and per group.

One scan reduces the predictions to a table of (model, group, truth, prediction) counts, whose
size depends on the numbers of models, groups and classes only. Every metric is a query on it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanset import fixed
from gleanset.functions import labels as lb

#: Marks among languages and truths; data that uses them as names of its own is refused.
OVERALL, OTHER = "overall", "other"
KEYS = ("model", "language")


def detailed_results(df: DataFrame) -> DataFrame:
    """Eleven columns per example: both models' raw answers, parsed labels and correctness.

    ``df`` has id, language, instruction, input_text, ground_truth and both raw answers.
    """
    parsed = df.withColumns(
        {f"{m}_prediction": lb.parse_sentiment(F.col(f"{m}_raw_output")) for m in ("baseline", "finetuned")}
    )
    columns = ["id", "language", "instruction", "input_text", "ground_truth"]
    for m in ("baseline", "finetuned"):
        correct = lb.is_correct(F.col(f"{m}_prediction"), F.col("ground_truth"))
        columns += [f"{m}_prediction", f"{m}_raw_output", correct.alias(f"{m}_correct")]
    return parsed.select(*columns)


def with_answers(
    rows: DataFrame, baseline: DataFrame, finetuned: DataFrame, missing: str = "fail"
) -> DataFrame:
    """Every example joined with two tables of (id, raw) answers kept elsewhere; ids are unique.

    An example without an answer of a model fails the run, or with ``missing="unparseable"`` keeps a
    null answer, which counts as unparseable; it never leaves the metrics.
    """
    return _joined(rows, baseline, finetuned, missing, "raw_output", F.col("raw"))


def _joined(
    rows: DataFrame, baseline: DataFrame, finetuned: DataFrame, missing: str, name: str, value: Column
) -> DataFrame:
    if missing not in ("fail", "unparseable"):
        raise ValueError(f"missing is fail or unparseable, not {missing!r}")
    for model, answers in (("baseline", baseline), ("finetuned", finetuned)):
        column = f"{model}_{name}"
        rows = rows.join(answers.select("id", value.alias(column), F.lit(True).alias("_told")), "id", "left")
        if missing == "fail":
            untold = F.concat(F.lit(f"no {model} answer for example "), F.col("id").cast("string"))
            told = F.when(F.col("_told").isNull(), F.raise_error(untold)).otherwise(F.col(column))
            rows = rows.withColumn(column, told)
        rows = rows.drop("_told")
    return rows


def with_predictions(
    rows: DataFrame, baseline: DataFrame, finetuned: DataFrame, missing: str = "fail"
) -> DataFrame:
    """:func:`with_answers` for figures alone: answers are parsed where they lie, so that a label of a few
    bytes is joined and no raw answer. ``rows`` need id, language and ground_truth."""
    narrow = rows.select("id", "language", "ground_truth")
    joined = _joined(narrow, baseline, finetuned, missing, "prediction", lb.parse_sentiment(F.col("raw")))
    names = ("baseline_prediction", "finetuned_prediction")
    return joined.withColumns({n: F.coalesce(n, F.lit(fixed.UNPARSEABLE)) for n in names})


def melt_predictions(
    df: DataFrame, predictions: Mapping[str, str], truth: str = "ground_truth", group: str = "language"
) -> DataFrame:
    """One (id, language, model, pred, truth) row per example and model."""
    entries = [F.struct(F.lit(m).alias("model"), F.col(c).alias("pred")) for m, c in predictions.items()]
    return df.select(
        "id", F.col(group).alias("language"), F.col(truth).alias("truth"), F.inline(F.array(*entries))
    )


def confusion_counts(melted: DataFrame, classes: Sequence[str] = fixed.LABELS) -> DataFrame:
    """Rows per (model, language, truth, pred), with ``language`` = ``overall`` added.

    Predictions outside the class list count as unparseable, truths outside it as ``other``.
    The metrics below select with conditions inside aggregates, not with filters that would move
    below this aggregate, so that all of them can share it.
    """
    known = list(classes)
    if {OTHER, fixed.UNPARSEABLE} & set(known):
        raise ValueError(f"classes may not be called {OTHER} or {fixed.UNPARSEABLE}")
    taken = F.raise_error(F.lit(f"a language may not be called {OVERALL}"))
    cells = melted.groupBy(
        "model",
        F.when(F.col("language") == OVERALL, taken).otherwise(F.col("language")).alias("language"),
        F.when(F.col("truth").isin(known), F.col("truth")).otherwise(F.lit(OTHER)).alias("truth"),
        F.when(F.col("pred").isin(known), F.col("pred")).otherwise(F.lit(fixed.UNPARSEABLE)).alias("pred"),
    ).agg(F.count(F.lit(1)).alias("n"))
    both = F.explode(F.array(F.col("language"), F.lit(OVERALL)))
    return (
        cells.withColumn("language", both)
        .groupBy("model", "language", "truth", "pred")
        .agg(F.sum("n").alias("n"))
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def _sum_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def _per_group(counts: DataFrame, entries: Sequence[Column]) -> DataFrame:
    """One row per entry for every group that has a parseable row."""
    return (
        counts.groupBy(*KEYS)
        .agg(F.array(*entries).alias("_cells"), _sum_if(F.col("pred") != fixed.UNPARSEABLE).alias("_parseable"))
        .filter("_parseable > 0")
        .select(*KEYS, F.inline("_cells"))
    )


def unparseable_rate(counts: DataFrame) -> DataFrame:
    """Number and rate of answers without a label."""
    missed = _sum_if(F.col("pred") == fixed.UNPARSEABLE)
    return counts.groupBy(*KEYS).agg(
        F.sum("n").alias("rows"), missed.alias("unparseable"), _ratio(missed, F.sum("n")).alias("rate")
    )


def accuracies(counts: DataFrame) -> DataFrame:
    """Accuracy over all rows, over parseable rows, and under the report's accuracy key.

    The report carries the accuracy over parseable rows while every truth is in the class list;
    with other truths it has a micro average instead, and the accuracy over all rows stands.
    Without parseable rows the reported value is 0.
    """
    parseable = F.col("pred") != fixed.UNPARSEABLE
    parsed, hits = _sum_if(parseable), _sum_if(F.col("pred") == F.col("truth"))
    other = _sum_if(parseable & (F.col("truth") == OTHER))
    overall = _ratio(hits, F.sum("n"))
    return counts.groupBy(*KEYS).agg(
        F.sum("n").alias("rows"),
        parsed.alias("parseable"),
        overall.alias("accuracy_all"),
        _ratio(hits, parsed).alias("accuracy_parseable"),
        F.when(parsed == 0, F.lit(0.0))
        .when(other > 0, overall)
        .otherwise(_ratio(hits, parsed))
        .alias("accuracy_reported"),
    )


def class_report(counts: DataFrame, classes: Sequence[str] = fixed.LABELS) -> DataFrame:
    """Precision, recall, F1 and support per class over parseable rows.

    Every class is listed for every group that has parseable rows; 0/0 counts as 0.
    """
    entries = [
        F.struct(
            F.lit(c).alias("class"),
            _sum_if((F.col("truth") == c) & (F.col("pred") == c)).alias("tp"),
            _sum_if(F.col("pred") == c).alias("predicted"),
            _sum_if((F.col("truth") == c) & (F.col("pred") != fixed.UNPARSEABLE)).alias("support"),
        )
        for c in classes
    ]
    tallies = _per_group(counts, entries)
    return (
        tallies.withColumn("precision", _ratio(F.col("tp"), F.col("predicted")))
        .withColumn("recall", _ratio(F.col("tp"), F.col("support")))
        .withColumn("f1", _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")))
    )


def average_report(counts: DataFrame, classes: Sequence[str] = fixed.LABELS) -> DataFrame:
    """Macro, support-weighted and micro averages of the class report.

    The micro average is only reported when some truth lies outside the class list.
    """
    report = class_report(counts, classes)
    metrics = ("precision", "recall", "f1")
    support = F.sum("support")
    tp, predicted = F.sum("tp"), F.sum("predicted")
    micro = {
        "precision": _ratio(tp, predicted),
        "recall": _ratio(tp, support),
        "f1": _ratio(2 * tp, predicted + support),
    }
    rows = [
        F.struct(F.lit("macro avg").alias("average"), *[F.avg(m).alias(m) for m in metrics]),
        F.struct(
            F.lit("weighted avg").alias("average"),
            *[_ratio(F.sum(F.col(m) * F.col("support")), support).alias(m) for m in metrics],
        ),
        F.struct(F.lit("micro avg").alias("average"), *[micro[m].alias(m) for m in metrics]),
    ]
    # Predicted rows beyond the supported ones have a truth outside the class list.
    return (
        report.groupBy(*KEYS)
        .agg(F.array(*rows).alias("_rows"), support.alias("support"), (predicted > support).alias("_other"))
        .select(*KEYS, "support", "_other", F.inline("_rows"))
        .filter((F.col("average") != "micro avg") | F.col("_other"))
        .select(*KEYS, "average", *metrics, "support")
    )


def confusion_dense(counts: DataFrame, classes: Sequence[str] = fixed.LABELS) -> DataFrame:
    """Confusion matrix over parseable rows with its zero cells, as one row per cell."""
    cells = [
        F.struct(
            F.lit(t).alias("truth"),
            F.lit(p).alias("pred"),
            _sum_if((F.col("truth") == t) & (F.col("pred") == p)).alias("n"),
        )
        for t in classes
        for p in classes
    ]
    return _per_group(counts, cells)


def metric_table(counts: DataFrame, classes: Sequence[str] = fixed.LABELS) -> DataFrame:
    """All metrics as (key, value), keys spelled ``{group}_{model}_{class}_{metric}``."""

    def long(df: DataFrame, named: Mapping[str, Column]) -> DataFrame:
        entries = [
            F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in named.items()
        ]
        return df.select(*KEYS, F.inline(F.array(*entries)))

    def labelled(df: DataFrame, name: str, named: Mapping[str, str]) -> DataFrame:
        entries = [
            F.struct(
                F.concat_ws("_", F.replace(F.col(name), F.lit(" "), F.lit("_")), F.lit(k)).alias("metric"),
                F.col(c).cast("double").alias("value"),
            )
            for k, c in named.items()
        ]
        return df.select(*KEYS, F.inline(F.array(*entries)))

    # fixed values: metric names
    names = {"precision": "precision", "recall": "recall", "f1-score": "f1", "support": "support"}
    table = (
        long(
            unparseable_rate(counts),
            {"unparseable_predictions_count": F.col("unparseable"), "unparseable_predictions_rate": F.col("rate")},
        )
        .unionByName(
            long(
                accuracies(counts),
                {"accuracy": F.col("accuracy_reported"), "accuracy_all": F.col("accuracy_all")},
            )
        )
        .unionByName(labelled(class_report(counts, classes), "class", names))
        .unionByName(labelled(average_report(counts, classes), "average", names))
    )
    return table.select(F.concat_ws("_", "language", "model", "metric").alias("key"), *KEYS, "metric", "value")


def model_comparison(counts: DataFrame, models: Sequence[str] = ("baseline", "finetuned")) -> DataFrame:
    """Reported accuracy and macro F1 of two models side by side, with the difference."""
    before, after = models
    macro = average_report(counts).filter("average = 'macro avg'").select(*KEYS, F.col("f1").alias("macro_f1"))
    scores = accuracies(counts).join(macro, list(KEYS), "left")
    wide = (
        scores.groupBy("language")
        .pivot("model", list(models))
        .agg(F.max("accuracy_reported").alias("accuracy"), F.max(F.coalesce("macro_f1", F.lit(0.0))).alias("macro_f1"))
    )
    return wide.withColumn(
        "accuracy_gain", F.col(f"{after}_accuracy") - F.col(f"{before}_accuracy")
    ).withColumn("macro_f1_gain", F.col(f"{after}_macro_f1") - F.col(f"{before}_macro_f1"))
