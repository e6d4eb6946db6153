import random

import pytest
from pyspark.sql import functions as F

from gleanset.operators import dedup
from gleanset.operators.observed import Dropped


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    made = []
    for i in range(400):
        text = "hot" if rng.random() < 0.35 else rng.choice([None, "", "a", "b", *(f"t{k}" for k in range(200))])
        made.append((i, text, rng.randrange(3) if rng.random() < 0.9 else None, rng.randrange(2)))
    rng.shuffle(made)
    return made


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, label int, topic int").repartition(5)


def ids(frame):
    return sorted(r["id"] for r in frame.select("id").collect())


def groups(rows, key):
    out = {}
    for row in sorted(rows, key=lambda r: r[0]):
        out.setdefault(key(row), []).append(row)
    return out


def test_keep_first(df, rows):
    want = sorted(g[0][0] for g in groups(rows, lambda r: r[1]).values())
    assert ids(dedup.dedup_keep_first(df, ["text"])) == want
    pairs = sorted(g[0][0] for g in groups(rows, lambda r: (r[1], r[3])).values())
    assert ids(dedup.dedup_keep_first(df, ["text", "topic"])) == pairs


def test_first_of_each_carries_the_first_row(df, rows):
    got = dedup.first_of_each(df, ["text"], carry={"l": F.coalesce("label", F.lit(-1))}).collect()
    want = {g[0][0]: (len(g), -1 if g[0][2] is None else g[0][2]) for g in groups(rows, lambda r: r[1]).values()}
    assert {r["id"]: (r.copies, r.l) for r in got} == want


def test_drop_all_and_listing_split_the_table(df, rows):
    by_text = groups(rows, lambda r: r[1])
    single = sorted(g[0][0] for g in by_text.values() if len(g) == 1)
    assert ids(dedup.dedup_drop_all(df, ["text"])) == single
    assert ids(dedup.duplicate_rows(df, ["text"])) == sorted(r[0] for g in by_text.values() if len(g) > 1 for r in g)


@pytest.fixture(params=["salted", "broadcast", "too many to broadcast"])
def folder(request, tmp_path, monkeypatch):
    """Every way the rows of unwanted keys can be dropped."""
    if request.param == "too many to broadcast":
        monkeypatch.setattr(dedup, "BROADCAST_ROWS", 0)
    return None if request.param == "salted" else lambda name: str(tmp_path / name)


def test_drop_conflicting(df, rows, folder):
    def clean(key):
        kept = []
        for g in groups(rows, key).values():
            if len({r[2] for r in g if r[2] is not None}) <= 1:
                kept += [r[0] for r in g]
        return sorted(kept)

    assert ids(dedup.drop_conflicting(df, ["text"], "label", folder=folder and folder("a"))) == clean(lambda r: r[1])
    by_topic = dedup.drop_conflicting(df, ["text"], "label", within=["topic"], folder=folder and folder("b"))
    assert ids(by_topic) == clean(lambda r: (r[1], r[3]))


def test_drop_listed(spark, df, rows, folder):
    listed = ["hot", "t1", "t2"]
    want = sorted(r[0] for r in rows if r[1] not in listed)
    assert ids(dedup.drop_listed(df, "text", listed)) == want
    table = spark.createDataFrame([(t,) for t in [*listed, "hot"]], "x string")
    assert ids(dedup.drop_listed(df, "text", table, folder and folder("c"))) == want
    counted = dedup.count_listed(df, "text", listed).first()
    assert (counted.removed, counted.kept) == (len(rows) - len(want), len(want))


def test_duplicate_counts(df, rows):
    got = {r["column"]: r.duplicates for r in dedup.duplicate_counts(df, ["text", "label", "topic"]).collect()}
    n = len(rows)
    assert got == {
        "text": n - len({r[1] for r in rows}),
        "label": n - len({r[2] for r in rows}),
        "topic": n - len({r[3] for r in rows}),
        "*": n - len({r[1:] for r in rows}),
    }


def test_row_order_and_partitioning_do_not_matter(df):
    once = ids(dedup.dedup_keep_first(df, ["text"]))
    again = ids(dedup.dedup_keep_first(df.orderBy(F.rand(3)).repartition(11), ["text"]))
    assert once == again


def test_keep_first_plans_as_hash_aggregate(df):
    plan = dedup.dedup_keep_first(df, ["text"])._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "Window" not in plan


def test_a_table_bucketed_by_id_is_not_shuffled_again(spark, df):
    df.write.bucketBy(4, "id").mode("overwrite").saveAsTable("bucketed_rows")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = dedup.dedup_keep_first(spark.table("bucketed_rows"), ["text"])
        plan = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Both shuffles are of narrow rows: the text keys, and their first ids.
    assert plan.count("Exchange") == 2
    assert all("text#" not in line for line in plan.splitlines() if "Exchange" in line)
    assert "Bucketed: true" in plan


@pytest.mark.parametrize("few", [True, False])
def test_written_surplus_gives_the_same_rows(df, tmp_path, monkeypatch, few):
    if not few:
        monkeypatch.setattr(dedup, "BROADCAST_ROWS", 0)
    for name in ("dedup_keep_first", "dedup_drop_all", "duplicate_rows"):
        function = getattr(dedup, name)
        assert ids(function(df, ["text"], folder=str(tmp_path / name))) == ids(function(df, ["text"])) != []


def test_distinct_sorted_keeps_null(df, tmp_path):
    want = [r.text for r in df.select("text").distinct().orderBy("text").collect()]
    assert [r.text for r in dedup.distinct_sorted(df, "text", folder=str(tmp_path / "d")).collect()] == want


def test_duplicate_counts_by_group(df, rows):
    got = {(r.topic, r["column"]): r.duplicates for r in dedup.duplicate_counts(df, ["text"], ["topic"]).collect()}
    for topic in (0, 1):
        own = [r[1] for r in rows if r[3] == topic]
        assert got[(topic, "text")] == len(own) - len(set(own))


@pytest.mark.parametrize("folder", [None, "surplus"])
@pytest.mark.parametrize("few", [True, False])
def test_a_row_without_an_id_fails_every_way(spark, tmp_path, monkeypatch, folder, few):
    """Whether the surplus is written, few or many: an id says which row is meant, so it has to be there."""
    if not few:
        monkeypatch.setattr(dedup, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (None, "a"), (None, "c")], "id long, text string")
    for name in ("dedup_keep_first", "dedup_drop_all", "duplicate_rows"):
        with pytest.raises(Exception, match="a row has no id"):
            getattr(dedup, name)(df, ["text"], folder=folder and str(tmp_path / name)).collect()
    with pytest.raises(Exception, match="a row has no id"):
        dedup.distinct_sorted(df, "text", folder=folder and str(tmp_path / "sorted")).collect()
    with pytest.raises(Exception, match="a row has no id"):
        dedup.first_of_each(df, ["text"]).collect()


def test_listed_rows_are_counted_by_the_run_that_drops_them(spark, df, rows, folder, tmp_path):
    """A third of the rows have the listed text; nothing is read again for the counts."""
    listed = ["hot", "t1", "t2"]
    want = sorted(r[0] for r in rows if r[1] not in listed)
    path = str(tmp_path / "rows")
    df.write.parquet(path)
    table = spark.createDataFrame([(t,) for t in [*listed, "hot", None]], "x string")
    for texts in (listed, table):
        dropped = Dropped()
        kept = dedup.drop_listed(spark.read.parquet(path), "text", texts, folder and folder("k"), dropped)
        assert kept.columns == df.columns
        assert ids(kept) == want
        assert (dropped.removed, dropped.kept) == (len(rows) - len(want), len(want))
        assert tuple(dropped.table(spark).first()) == (len(rows) - len(want), len(want))
        plan = kept._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert sum("FileScan" in line and "rows]" in line for line in plan.splitlines()) == 1


def test_columns_called_like_working_ones_keep_their_values(spark, folder):
    rows = [(i, f"t{i % 7}", i % 2, i * 10, i * 100, i * 1000) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, label int, _key0 long, _salt long, _LISTED long")
    listed = spark.createDataFrame([("t1",), ("t2",)], "x string")
    for kept in (
        dedup.drop_listed(df, "text", listed, folder and folder("a")),
        dedup.drop_listed(df, "text", listed, folder and folder("b"), Dropped()),
        dedup.drop_conflicting(df.filter("text in ('t3', 't4') OR label = 0"), ["text"], "label", folder=folder and folder("c")),
        dedup.dedup_keep_first(df, ["text"]),
    ):
        assert kept.columns == df.columns
        got = kept.collect()
        assert got and all(tuple(r) == rows[r["id"]] for r in got)
