import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanset.functions import text as tx
from gleanset.functions.keys import text_key
from gleanset.operators import profile
from gleanset.plans import datasets, explore


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    return [(i, rng.choice("xy"), " ".join("ab" for _ in range(rng.randrange(1, 40)))) for i in range(300)] + [
        (900, "x", None),
        (901, "z", "one two three"),
    ]


@pytest.fixture(scope="module")
def freq(spark, texts):
    df = spark.createDataFrame(texts, "id long, g string, text string")
    return profile.length_frequencies(df, "text", ["g"])


def words(texts, g):
    return sorted(len(t.split()) for _, group, t in texts if group == g and t is not None)


def test_describe(freq, texts):
    got = {r.g: r for r in profile.describe_lengths(freq, ["g"]).filter("measure = 'word'").collect()}
    for g in "xy":
        values = words(texts, g)
        row = got[g]
        assert (row["count"], row["min"], row["max"]) == (len(values), values[0], values[-1])
        assert row["mean"] == pytest.approx(statistics.mean(values))
        assert row["std"] == pytest.approx(statistics.stdev(values))
        assert [row.q25, row.q50, row.q75] == pytest.approx(list(np.percentile(values, [25, 50, 75])))
    assert got["z"]["std"] is None and got["z"]["count"] == 1


def test_histogram(freq, texts):
    rows = profile.length_histogram(freq, ["g"]).filter("measure = 'word'").orderBy("bin").collect()
    for g in "xyz":
        values = words(texts, g)
        counts, edges = np.histogram(values, bins=50)
        got = [r for r in rows if r.g == g]
        assert [r.n for r in got] == list(counts)
        assert [r.lower for r in got] == pytest.approx(list(edges[:-1]))
        assert got[-1].upper == pytest.approx(edges[-1])


def test_a_null_group_is_a_group(spark):
    df = spark.createDataFrame([(1, None, "a b"), (2, None, "a"), (3, "g", "a")], "id long, g string, t string")
    freq = profile.length_frequencies(df, "t", ["g"]).filter("measure = 'word'")
    for table in (profile.describe_lengths, profile.length_histogram, profile.box_figures):
        assert {r.g for r in table(freq, ["g"]).collect()} == {None, "g"}
    shares = {(r.g, r.value): r.share for r in profile.value_shares(df, ["t"], ["g"]).collect()}
    assert shares == {(None, "a b"): 0.5, (None, "a"): 0.5, ("g", "a"): 1.0}


def test_box_figures(spark):
    values = [1, 2, 2, 3, 3, 3, 4, 4, 30, 40]
    df = spark.createDataFrame([(i, "w " * v) for i, v in enumerate(values)], "id long, text string")
    row = profile.box_figures(profile.length_frequencies(df, "text")).filter("measure = 'word'").first()
    q1, q2, q3 = np.percentile(values, [25, 50, 75])
    assert [row.q25, row.q50, row.q75] == pytest.approx([q1, q2, q3])
    inside = [v for v in values if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
    assert (row.whisker_low, row.whisker_high, row.outliers) == (min(inside), max(inside), len(values) - len(inside))


def test_counts_and_shares(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "x string, y int")
    got = {(r.column, r.value): (r.n, r.share) for r in profile.value_shares(df, ["x", "y"]).collect()}
    assert got[("x", "a")] == (2, pytest.approx(2 / 3)) and ("x", None) not in got
    assert got[("y", "1")] == (3, 0.75)
    ordered = profile.ordered_counts(profile.value_counts(df, ["x"])).collect()
    assert [r.value for r in ordered] == ["a", "b"]
    assert {(r.column, r.value) for r in profile.distinct_values(df, ["x"]).collect()} == {
        ("x", "a"),
        ("x", "b"),
        ("x", None),
    }


@pytest.mark.parametrize("few", [True, False])
def test_shares_with_a_hot_group_from_written_totals(spark, tmp_path, monkeypatch, few):
    if not few:
        monkeypatch.setattr(profile, "BROADCAST_ROWS", 0)
    rows = [("hot" if i % 3 else f"g{i % 30}", None if i % 50 == 7 else i % 11) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int")
    plain, written = profile.value_shares(df, ["v"], ["g"]), profile.value_shares(df, ["v"], ["g"], str(tmp_path / "s"))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, written.collect()))
    for r in written.filter("g = 'hot'").collect():
        own = [v for g, v in rows if g == "hot" and v is not None]
        assert (r.n, r.share) == (own.count(int(r.value)), pytest.approx(own.count(int(r.value)) / len(own)))


def test_first_rows_of_each_group(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2] if i < 20 else None) for i in range(25)], "id long, g string")
    got = sorted((r.g or "-", r["id"]) for r in profile.first_rows(df, 3, by=["g"]).collect())
    assert got == [("-", 20), ("-", 21), ("-", 22), ("a", 0), ("a", 2), ("a", 4), ("b", 1), ("b", 3), ("b", 5)]
    # Every task sends on the first rows of a group only.
    plan = profile.first_rows(df, 3, by=["g"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Exchange")[1]


@pytest.mark.parametrize("bits", [4, 8])
def test_sketch_stays_within_its_error(spark, bits):
    rng = random.Random(9)
    lengths = [int(rng.lognormvariate(6, 2)) + 1 for _ in range(1500)] + [1, 2, 15, 16, 17, 255, 256, 257, 100_000]
    rows = [(i, "ab"[i % 2], i % 4, "x" * n) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "id long, g string, split int, text string").repartition(3)
    exact = profile.length_frequencies(df, "text", ["g"])
    by_split = profile.length_sketch(df, "text", ["g", "split"], bits)
    merged = profile.merge_sketches([by_split.filter("split < 2"), by_split.filter("split >= 2")], ["g"])
    whole = profile.length_sketch(df, "text", ["g"], bits)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.select(*merged.columns).collect()))
    error = profile.sketch_error(bits)
    for measure in ("describe_lengths", "box_figures"):
        figures = getattr(profile, measure)
        want = {(r.g, r.measure): r for r in figures(exact, ["g"]).collect()}
        for r in figures(merged, ["g"]).collect():
            true = want[r.g, r.measure]
            for name in ("q25", "q50", "q75", "min", "max", "mean"):
                if name in r.asDict():
                    assert abs(r[name] - true[name]) <= error * true[name] + 1e-9, (measure, name)
            if "count" in r.asDict():
                assert r["count"] == true["count"]
    small = profile.length_sketch(df.filter(f"length(text) < {2**bits}"), "text", ["g"], bits)
    exact_small = profile.length_frequencies(df.filter(f"length(text) < {2**bits}"), "text", ["g"])
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, exact_small.collect()))


def test_sketch_size_depends_on_the_range_alone(spark):
    df = spark.range(1, 200_001).select(F.repeat(F.lit("x"), F.col("id").cast("int") % 20_000 + 1).alias("text"))
    entries = profile.length_sketch(df, "text", bits=4).filter("measure = 'char'").count()
    assert entries <= 2**4 + 2**3 * 11


def test_table_profile(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string")
    got = {r.column: (r.type, r.rows, r.non_null, r.nulls) for r in profile.table_profile(df).collect()}
    assert got == {"id": ("bigint", 2, 2, 0), "t": ("string", 2, 1, 1)}
    assert [r["id"] for r in profile.first_rows(df, 1).collect()] == [1]


def test_words(spark):
    df = spark.createDataFrame([(1, "B a, b! 12"), (2, "a c")], "id long, t string")
    assert [tuple(r) for r in profile.top_words(df, "t", 2).collect()] == [("a", 2), ("b", 2)]
    assert [r["id"] for r in profile.with_word_length(df, "t", [2]).collect()] == [2]
    assert {tuple(r) for r in profile.word_length_counts(df, "t", [2, 9]).collect()} == {(2, 1), (9, 0)}


def test_findings(spark):
    rows = [(0, "a", "w " * 501), *((i, "b", "one two three four five") for i in range(1, 20))]
    df = spark.createDataFrame(rows, "id long, l string, t string").select(
        "l", tx.word_count(F.col("t")).alias("words"), text_key(F.col("t")).alias("key")
    )
    got = {r.finding: (r.value, r.flagged) for r in profile.findings(df, "l", "words", "key").collect()}
    assert got == {
        "class_share": (0.05, True),
        "longest_words": (501.0, True),
        "shortest_words": (5.0, False),
        "duplicate_texts": (18.0, True),
    }


def test_findings_per_group_and_label(spark):
    rows = [("x", "a", 1, f"t{i}", 9) for i in range(19)] + [("x", "b", 1, "t0", 9), ("y", "b", 2, "t0", 600)]
    df = spark.createDataFrame(rows, "s string, l string, m int, key string, words long")
    got = {(r.s, r.finding): (r.value, r.flagged) for r in profile.findings(df, ["l", "m"], "words", "key", ["s"]).collect()}
    assert got[("x", "class_share_l")] == (0.05, True) and got[("x", "class_share_m")] == (1.0, False)
    assert got[("x", "duplicate_texts")] == (1.0, True) and got[("y", "duplicate_texts")] == (0.0, False)
    assert got[("y", "longest_words")] == (600.0, True) and len(got) == 10


def test_english_funnel(spark):
    rows = [
        (1, "a good day", "positive"),
        (2, "a good day", "negative"),
        (3, "@a @b c", "positive"),
        (4, "1 2 3 4", "neutral"),
        (5, "not so good", "Positive"),
        (6, None, "neutral"),
        (7, "see http://x.y now then", "neutral"),
    ]
    raw = spark.createDataFrame(rows, "id long, input string, output string")
    got = {r.stage: r.rows_left for r in datasets.english_funnel(raw).collect()}
    assert got == {"loaded": 7, "deduplicated": 6, "cleaned": 3, "mapped": 2}
    assert {r["id"]: r["input"] for r in datasets.english_clean(raw).collect()} == {
        1: "a good day",
        7: "see  now then",
    }
    assert {r["id"] for r in datasets.english_rows(raw).collect()} == {1, 7}


def test_second_funnel(spark):
    listed = "thầy dạy hay , tuy nhiên còn nhiều chỗ chưa thu hút ."
    rows = [(1, listed, 0), (2, listed, 2), (3, "rất hay", 2), (4, "rất hay", 0), (5, "hay", 1), (6, "quá dở", 7)]
    raw = spark.createDataFrame(rows, "id long, sentence string, sentiment int")
    got = {r.stage: r.rows_left for r in datasets.second_funnel(raw).collect()}
    assert got == {"loaded": 6, "unlisted": 4, "deduplicated": 3, "long_enough": 2, "mapped": 1}
    assert [tuple(r) for r in datasets.second_rows(raw).collect()] == [(3, "positive")]


def test_dedup_comes_before_cleaning(spark):
    """Texts that only cleaning makes equal both stay."""
    raw = spark.createDataFrame(
        [(1, "up we go @a", "neutral"), (2, "up we go @b", "neutral")], "id long, input string, output string"
    )
    assert datasets.english_rows(raw).count() == 2


def test_explore(spark, tmp_path):
    rows = [(i, f"text number {i % 7}", "a" if i % 3 else "b", "train") for i in range(20)]
    rows += [(100, "text number 0", "a", "eval")]
    df = spark.createDataFrame(rows, "id long, t string, l string, split string")
    tables = explore.explore(df, "t", ["l"], ["split"], folder=str(tmp_path))
    assert (tmp_path / "lengths").exists()
    sketched = explore.explore(df, "t", ["l"], ["split"], sketch_bits=4)
    assert sorted(map(tuple, sketched["lengths"].collect())) == sorted(map(tuple, tables["lengths"].collect()))
    assert {name: table.count() for name, table in tables.items()} == {
        "columns": 6,
        "head": 6,
        "values": 3,
        "shares": 3,
        "surplus": 6,
        "duplicates": 20,
        "lengths": 4,
        "histogram": 200,
        "box": 4,
        "words": 4,
        "findings": 8,
    }
