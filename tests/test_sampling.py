import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gleanset import fixed
from gleanset.operators import ranking as rk
from gleanset.operators import sampling

CLASSES = ["negative", "neutral", "positive"]


def drawn(ids):
    return sorted(ids, key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))


def make(sizes, seed=0):
    rng = random.Random(seed)
    ids = rng.sample(range(10_000), sum(sizes.values()))
    rows = []
    for label, n in sizes.items():
        rows += [(ids.pop(), label) for _ in range(n)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, label string").repartition(4)


def result(df):
    return {(r["id"], r.split) for r in df.collect()}


def scarce_by_steps(rows, e_rows, t_rows):
    """The split in the order a person would do it, one draw after the other."""
    left = {c: drawn([i for i, label in rows if label == c]) for c in CLASSES}
    evals, trains = [], []

    def take(c, n):
        taken, left[c] = left[c][:n], left[c][n:]
        return taken

    e, t = e_rows // 3, t_rows // 3
    first_e = take("neutral", e)
    first_t = take("neutral", t)
    evals += first_e
    trains += first_t
    for c in ("positive", "negative"):
        evals += take(c, e + (e - len(first_e)) // 2)
        trains += take(c, t + (t - len(first_t)) // 2)
    pool = drawn([i for c in CLASSES for i in left[c]])
    need = e_rows - len(evals)
    if 0 < need <= len(pool):
        evals += pool[:need]
        pool = pool[need:]
    need = t_rows - len(trains)
    if 0 < need <= len(pool):
        trains += pool[:need]
    return {(i, "eval") for i in evals} | {(i, "train") for i in trains}


def balanced_by_steps(rows, e_rows, t_rows):
    left = {c: drawn([i for i, label in rows if label == c]) for c in CLASSES}
    evals, trains = [], []
    for c in CLASSES:
        evals += left[c][: e_rows // 3]
    pool = drawn([i for c in CLASSES for i in left[c] if i not in evals])
    need = e_rows - len(evals)
    if 0 < need <= len(pool):
        evals += pool[:need]
    for c in CLASSES:
        trains += [i for i in left[c] if i not in evals][: t_rows // 3]
    pool = drawn([i for c in CLASSES for i in left[c] if i not in evals and i not in trains])
    need = t_rows - len(trains)
    if 0 < need <= len(pool):
        trains += pool[:need]
    return {(i, "eval") for i in evals} | {(i, "train") for i in trains}


CASES = [
    ({"negative": 15, "neutral": 15, "positive": 102}, 12, 60),
    ({"negative": 15, "neutral": 15, "positive": 102}, 12, 200),
    ({"negative": 40, "neutral": 2, "positive": 60}, 13, 50),
    ({"negative": 1, "neutral": 90, "positive": 3}, 20, 30),
    ({"negative": 100, "neutral": 100, "positive": 100}, 25, 100),
    ({"negative": 3, "neutral": 0, "positive": 4}, 10, 3),
]


@pytest.mark.parametrize("sizes,e_rows,t_rows", CASES)
def test_splits_equal_the_step_by_step_version(spark, sizes, e_rows, t_rows):
    rows = make(sizes)
    df = frame(spark, rows)
    assert result(sampling.scarce_first_split(df, e_rows, t_rows)) == scarce_by_steps(rows, e_rows, t_rows)
    assert result(sampling.balanced_split(df, e_rows, t_rows)) == balanced_by_steps(rows, e_rows, t_rows)


def test_shuffled_joins_and_slot_ranks_give_the_same_split(spark, monkeypatch):
    """The paths for quotas beyond one task's and one broadcast's size."""
    rows = make({"negative": 60, "neutral": 9, "positive": 200}, seed=3)
    df = frame(spark, rows)
    monkeypatch.setattr(rk, "ONE_TASK_ROWS", 0)
    monkeypatch.setattr(rk, "BROADCAST_ROWS", 0)
    assert result(sampling.scarce_first_split(df, 31, 90)) == scarce_by_steps(rows, 31, 90)
    assert result(sampling.balanced_split(df, 31, 90)) == balanced_by_steps(rows, 31, 90)
    got = {r["id"] for r in sampling.random_n(df, 50).collect()}
    assert got == set(drawn([i for i, _ in rows])[:50])


def test_split_is_disjoint_and_fills_its_quota(spark):
    df = frame(spark, make({"negative": 300, "neutral": 80, "positive": 900}, seed=9))
    split = sampling.scarce_first_split(df, 25, 301)
    rows = split.collect()
    assert len({r["id"] for r in rows}) == len(rows) == 326
    again = sampling.scarce_first_split(df.orderBy(F.rand(1)).repartition(7), 25, 301)
    assert result(again) == result(split)


def test_sample_per_class(spark):
    rows = make({"negative": 20, "neutral": 3, "positive": 50})
    got = sampling.sample_per_class(frame(spark, rows), "label", 10).collect()
    for c, n in (("negative", 10), ("neutral", 3), ("positive", 10)):
        assert {r["id"] for r in got if r.label == c} == set(drawn([i for i, label in rows if label == c])[:n])


def test_unknown_labels_stay(spark):
    df = frame(spark, make({"mildly positive": 20, "neutral": 4}))
    for sample in (sampling.sample_per_class(df, "label", 50), sampling.proportional_sample(df, "label", 50)):
        assert sample.groupBy("label").count().count() == 2 and sample.count() == 24
    assert {r.label: r.n for r in sampling.outside_classes(df, "label").collect()} == {"mildly positive": 20}
    few = sampling.proportional_sample(df, "label", 12).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in few} == {"mildly positive": 10, "neutral": 2}


def test_top_up_is_all_or_nothing(spark):
    rows = make({"negative": 5, "neutral": 0, "positive": 10})
    df = frame(spark, rows)
    sample, pool = df.filter("label = 'negative'"), df.filter("label = 'positive'")
    filled = {r["id"] for r in sampling.top_up(sample, pool, 12).collect()}
    assert filled == {i for i, label in rows if label == "negative"} | set(
        drawn([i for i, label in rows if label == "positive"])[:7]
    )
    assert sampling.top_up(sample, pool, 16).count() == 5
    assert sampling.top_up(sample, pool, 4).count() == 5


def test_random_n_and_remaining(spark):
    rows = make({"negative": 30, "neutral": 30, "positive": 30})
    df = frame(spark, rows)
    picked = sampling.random_n(df, 20)
    assert {r["id"] for r in picked.collect()} == set(drawn([i for i, _ in rows])[:20])
    assert sampling.remaining(df, picked).count() == 70
    assert sampling.random_n(df, 500).count() == 90
    shuffled = [r["id"] for r in sampling.shuffled(df).collect()]
    assert shuffled == drawn([i for i, _ in rows])


def half_even(x):
    return round(x)


def quotas_by_steps(counts, n):
    total = sum(counts.values())
    if total <= n:
        return dict(counts)
    order = sorted(counts, key=lambda c: (-counts[c], c))
    q = {c: half_even(counts[c] / total * n) for c in order}
    diff = n - sum(q.values())
    for _ in range(abs(diff)):
        if diff > 0:
            q[max(order, key=lambda c: q[c])] += 1
        else:
            low = min(order, key=lambda c: q[c])
            q[low] = max(q[low] - 1, 0)
    return {c: min(q[c], counts[c]) for c in order}


QUOTA_CASES = [
    ({"a": 5, "b": 3, "c": 2}, 5, {"a": 2, "b": 2, "c": 1}),
    ({"a": 167, "b": 167, "c": 168}, 500, None),
    ({"a": 200, "b": 200, "c": 200}, 500, {"a": 166, "b": 167, "c": 167}),
    ({"a": 3, "b": 3}, 5, None),
    ({"a": 900, "b": 5, "c": 1}, 100, None),
    ({"a": 1, "b": 1, "c": 1, "d": 1, "e": 1}, 3, None),
    ({"a": 4, "b": 2}, 6, {"a": 4, "b": 2}),
    ({"a": 4, "b": 2}, 60, {"a": 4, "b": 2}),
]


@pytest.mark.parametrize("counts,n,want", QUOTA_CASES)
def test_proportional_quotas(spark, counts, n, want):
    df = spark.createDataFrame(list(counts.items()), "label string, c long")
    got = {r.label: r.take for r in sampling.proportional_quotas(df, n).collect()}
    assert got == quotas_by_steps(counts, n)
    if want:
        assert got == want


def test_proportional_sample_reaches_its_size(spark):
    rows = make({"negative": 31, "neutral": 7, "positive": 90})
    df = frame(spark, rows)
    for n in (1, 10, 37, 128, 400):
        got = sampling.proportional_sample(df, "label", n).collect()
        assert len({r["id"] for r in got}) == len(got) == min(n, 128)
    one = frame(spark, make({"negative": 0, "neutral": 0, "positive": 30}))
    assert sampling.proportional_sample(one, "label", 7).count() == 7


def test_shortfall(spark):
    rows = make({"negative": 3, "neutral": 0, "positive": 4})
    splits = sampling.scarce_first_split(frame(spark, rows), 3, 30)
    report = sampling.shortfall(splits, {"eval": 3, "train": 30})
    got = {(r.split, r.label): (r.wanted, r.got, r.missing) for r in report.collect()}
    # One eval row each from two classes; train then takes all that is left, so nothing tops eval up.
    steps = scarce_by_steps(rows, 3, 30)
    assert sorted(s for _, s in steps) == ["eval"] * 2 + ["train"] * 5
    assert got[("train", "neutral")] == (10, 0, 10)
    assert got[("eval", "*")] == (3, 2, 1)
    assert got[("train", "*")] == (30, 5, 25)


def test_ranking_does_not_collect_a_class_in_one_task(spark):
    df = frame(spark, make({"negative": 30, "neutral": 1, "positive": 300}))
    rows = rk.with_draw(df)
    ranked = rk.rank_by_slots(rows, rk.slot_counts(rows, ["label"]), ["label"], groups=3)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(label#" in plan and "_slot#" in plan
    got = {(r["id"], r.label): r["rank"] for r in ranked.collect()}
    for c in CLASSES:
        want = drawn([i for i, label in got if label == c])
        assert [got[(i, c)] for i in want] == list(range(1, len(want) + 1))


def test_strict_eval_fails_where_it_cannot_be_filled(spark):
    rows = [(i, fixed.LABELS[i % 3]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, label string")
    assert sampling.balanced_split(df, 20, 10, strict=True).count() == 30
    # Train may be short of what it wants, eval may not.
    assert sampling.balanced_split(df, 20, 90, strict=True).count() == 20 + 10
    assert sampling.balanced_split(df, 40, 10).filter("split = 'eval'").count() == 30
    with pytest.raises(Exception, match="eval lacks 10 rows and the pool has 0"):
        sampling.balanced_split(df, 40, 10, strict=True).collect()
