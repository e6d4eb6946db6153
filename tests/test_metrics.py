import random

import pytest

from gleanset.operators import metrics
from gleanset.plans import evaluation

CLASSES = ["negative", "neutral", "positive"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    made = []
    for i in range(300):
        truth = rng.choice(["negative", "positive"])
        pred = rng.choice([truth, truth, *CLASSES, "unparseable"])
        made.append((i, rng.choice(["EN", "VI"]), "m", pred, truth))
    made += [(i, "XX", "m", "unparseable", "negative") for i in range(1000, 1004)]
    return made


def melted(spark, rows):
    return spark.createDataFrame(rows, "id long, language string, model string, pred string, truth string")


@pytest.fixture(scope="module")
def counts(spark, rows):
    return metrics.confusion_counts(melted(spark, rows))


def part(rows, language):
    return [(p, t) for _, lang, _, p, t in rows if language in ("overall", lang)]


def scores(pairs):
    sure = [(p, t) for p, t in pairs if p in CLASSES]
    out = {}
    for c in CLASSES:
        tp = sum(p == t == c for p, t in sure)
        predicted, support = sum(p == c for p, _ in sure), sum(t == c for _, t in sure)
        precision = tp / predicted if predicted else 0.0
        recall = tp / support if support else 0.0
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        out[c] = (precision, recall, f1, support)
    return out


def test_accuracies(counts, rows):
    got = {r.language: r for r in metrics.accuracies(counts).collect()}
    for language in ("overall", "EN", "VI"):
        pairs = part(rows, language)
        sure = [(p, t) for p, t in pairs if p in CLASSES]
        hits = sum(p == t for p, t in pairs)
        row = got[language]
        assert (row.rows, row.parseable) == (len(pairs), len(sure))
        assert row.accuracy_all == pytest.approx(hits / len(pairs))
        assert row.accuracy_parseable == row.accuracy_reported == pytest.approx(hits / len(sure))
    assert (got["XX"].parseable, got["XX"].accuracy_reported) == (0, 0.0)


def test_published_accuracy_leaves_unparseable_rows_out(spark):
    rows = [(i, "EN", "baseline", "positive" if i < 134 else "neutral", "positive") for i in range(249)]
    rows += [(i + 249, "VI", "baseline", "positive" if i < 135 else "neutral", "positive") for i in range(243)]
    rows += [(900, "EN", "baseline", "unparseable", "positive")]
    rows += [(901 + i, "VI", "baseline", "unparseable", "positive") for i in range(7)]
    table = metrics.accuracies(metrics.confusion_counts(melted(spark, rows)))
    got = {r.language: (round(r.accuracy_reported, 3), round(r.accuracy_all, 3)) for r in table.collect()}
    assert got == {"overall": (0.547, 0.538), "EN": (0.538, 0.536), "VI": (0.556, 0.540)}


def test_class_report_lists_absent_classes(counts, rows):
    got = {(r.language, r["class"]): r for r in metrics.class_report(counts).collect()}
    assert not any(language == "XX" for language, _ in got)
    for language in ("overall", "EN", "VI"):
        for c, want in scores(part(rows, language)).items():
            row = got[(language, c)]
            assert (row.precision, row.recall, row.f1, row.support) == pytest.approx(want)
    assert got[("EN", "neutral")].support == 0


def test_averages(counts, rows):
    got = {(r.language, r.average): r for r in metrics.average_report(counts).collect()}
    for language in ("overall", "EN"):
        table = scores(part(rows, language))
        total = sum(v[3] for v in table.values())
        macro, weighted = got[(language, "macro avg")], got[(language, "weighted avg")]
        assert macro.f1 == pytest.approx(sum(v[2] for v in table.values()) / 3)
        assert weighted.precision == pytest.approx(sum(v[0] * v[3] for v in table.values()) / total)
        assert macro.support == weighted.support == total
        assert 0 <= macro.f1 <= 1
    assert (("overall", "micro avg")) not in got


def test_truth_outside_the_class_list(spark):
    rows = [(1, "EN", "m", "positive", "mixed"), (2, "EN", "m", "positive", "positive"), (3, "EN", "m", "x", "positive")]
    counts = metrics.confusion_counts(melted(spark, rows))
    row = metrics.accuracies(counts).filter("language = 'EN'").first()
    assert row.accuracy_reported == row.accuracy_all == pytest.approx(1 / 3)
    assert row.accuracy_parseable == pytest.approx(1 / 2)
    micro = metrics.average_report(counts).filter("language = 'EN' AND average = 'micro avg'").first()
    assert (micro.precision, micro.recall, micro.f1) == pytest.approx((1 / 2, 1.0, 2 / 3))


def test_confusion_sums_to_parseable(counts, rows):
    cells = metrics.confusion_dense(counts).collect()
    for language in ("overall", "EN", "VI"):
        mine = [r for r in cells if r.language == language]
        assert len(mine) == 9
        sure = [(p, t) for p, t in part(rows, language) if p in CLASSES]
        assert sum(r.n for r in mine) == len(sure)
        for r in mine:
            assert r.n == sum((p, t) == (r.pred, r.truth) for p, t in sure)


def test_metric_keys(counts):
    keys = {r.key for r in metrics.metric_table(counts).collect()}
    assert {
        "overall_m_accuracy",
        "EN_m_unparseable_predictions_rate",
        "VI_m_negative_f1-score",
        "overall_m_macro_avg_precision",
        "overall_m_weighted_avg_support",
        "XX_m_accuracy",
    } <= keys


def test_empty_input(spark):
    counts = metrics.confusion_counts(melted(spark, []))
    for table in (metrics.accuracies, metrics.class_report, metrics.average_report, metrics.confusion_dense):
        assert table(counts).count() == 0


def answers_by(word):
    def load():
        return lambda prompts: [word if "good" in p else "unsure" for p in prompts]

    return load


def test_models_are_run_once_and_scored(spark, tmp_path):
    rows = [(1, "EN", "Do", "good one", "positive"), (2, "EN", "Do", "bad one", "negative")]
    df = spark.createDataFrame(rows, "id long, language string, instruction string, input string, output string")
    tables = evaluation.run_models(df, answers_by("Positive!"), answers_by("negative"), str(tmp_path / "run"))
    details = {r["id"]: r for r in tables["details"].collect()}
    assert tables["details"].columns == [
        "id", "language", "instruction", "input_text", "ground_truth", "baseline_prediction", "baseline_raw_output",
        "baseline_correct", "finetuned_prediction", "finetuned_raw_output", "finetuned_correct",
    ]
    assert (details[1].baseline_correct, details[1].finetuned_correct) == (True, False)
    assert (details[2].baseline_prediction, details[2].baseline_correct) == ("unparseable", False)
    comparison = tables["comparison"].filter("language = 'EN'").first()
    assert (comparison.baseline_accuracy, comparison.finetuned_accuracy, comparison.accuracy_gain) == (1.0, 0.0, -1.0)


def test_a_failing_model_stops_the_evaluation(spark):
    def broken():
        def fail(prompts):
            raise RuntimeError("no device")

        return fail

    df = spark.createDataFrame(
        [(1, "EN", "Do", "x", "positive")], "id long, language string, instruction string, input string, output string"
    )
    with pytest.raises(Exception, match="no device"):
        evaluation.answer_all(df, broken, broken).collect()


def test_missing_answers_stay_in_the_metrics(spark):
    rows = spark.createDataFrame([(i, "EN", "ins", "t", "positive") for i in range(10)], "id long, language string, instruction string, input_text string, ground_truth string")
    full = spark.createDataFrame([(i, "positive") for i in range(10)], "id long, raw string")
    joined = metrics.with_answers(rows, full.filter("id < 7"), full, missing="unparseable")
    details = metrics.detailed_results(joined).collect()
    assert len(details) == 10 and sum(r.baseline_prediction == "unparseable" for r in details) == 3
    with pytest.raises(Exception, match="no baseline answer for example"):
        metrics.with_answers(rows, full.filter("id < 7"), full).collect()
    assert metrics.with_answers(rows, full, full).count() == 10


def test_marks_cannot_be_taken_for_names(spark):
    with pytest.raises(Exception, match="may not be called overall"):
        metrics.confusion_counts(melted(spark, [(1, "overall", "m", "positive", "positive")])).collect()
    with pytest.raises(ValueError):
        metrics.confusion_counts(melted(spark, []), ["other", "positive"])
