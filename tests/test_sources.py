import glob
import json

import pytest
from pyspark.sql import functions as F

from gleanset import session
from gleanset.operators import combine
from gleanset.operators import ranking as rk
from gleanset.plans import datasets
from gleanset.sources import readers, writers

ROWS = [
    ("do", 'he said "hi", twice', "positive"),
    ("do", "line one\nline two\\n", "neutral"),
    ("do", "tiếng Việt 🙂 é", None),
    ("do", " lead, trail ", "negative"),
    ("do", "carriage\r\nreturn \ttab", "negative"),
    ("do", "# not a comment", "negative"),
]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, readers.INSTRUCTION_SCHEMA)


def test_jsonl_round_trip(spark, df, tmp_path):
    path = str(tmp_path / "new" / "folder")
    writers.write_jsonl(df, path)
    assert {tuple(r) for r in readers.read_instructions(spark, path).collect()} == set(ROWS)
    lines = [line for f in glob.glob(f"{path}/*.json") for line in open(f, encoding="utf-8")]
    assert any("tiếng Việt 🙂" in line for line in lines)
    assert all(set(json.loads(line)) == {"instruction", "input", "output"} for line in lines)


def test_bad_json_line_fails(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"input": "a"}\n{"input": \n')
    with pytest.raises(Exception):
        readers.read_instructions(spark, str(tmp_path)).collect()


def test_csv_round_trip(spark, df, tmp_path):
    path = str(tmp_path / "csv")
    assert writers.write_csv(df, path)
    assert {tuple(r) for r in readers.read_csv(spark, path).collect()} == set(ROWS)


def test_csv_checks_columns_and_skips_empty(spark, df, tmp_path):
    path = str(tmp_path / "part")
    writers.write_csv(df.drop("output"), path)
    with pytest.raises(ValueError, match="output"):
        readers.read_csv(spark, path)
    assert not writers.write_csv(df.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_csv_with_another_header_or_a_broken_row_fails(spark, tmp_path):
    turned = tmp_path / "turned"
    turned.mkdir()
    (turned / "a.csv").write_text("instruction,input,output\ni,x,y\n")
    (turned / "b.csv").write_text("input,instruction,output\nx,i,y\n")
    with pytest.raises(Exception):
        readers.read_csv(spark, str(turned)).collect()
    for name, row in (("long", "i,x,y,z"), ("short", "i,x")):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "a.csv").write_text(f"instruction,input,output\n{row}\n")
        with pytest.raises(Exception):
            readers.read_csv(spark, str(folder)).select("input").collect()


def test_dataset_keeps_ids_and_languages(spark, tmp_path):
    rows = [("EN", "train", 1, "i", "x", "positive"), ("VI", "eval", 2, "i", "y", "neutral")]
    df = spark.createDataFrame(rows, "language string, split string, id long, instruction string, input string, output string")
    datasets.write_dataset(df, str(tmp_path / "d"))
    got = readers.read_dataset(spark, str(tmp_path / "d"), "eval")
    assert [(r["id"], r.language, r.input) for r in got.collect()] == [(2, "VI", "y")]
    assert "PartitionFilters: [isnotnull(split" in got._jdf.queryExecution().executedPlan().toString()


def test_position_language_with_spread_ids(spark):
    df = spark.range(3000).select(F.xxhash64("id").alias("id"))
    got = {r["id"]: (r.position, r.language) for r in combine.position_language(df).collect()}
    want = sorted(got)
    assert [got[i] for i in want] == [(p, "EN" if p < 1500 else "VI") for p in range(3000)]
    slots = rk.with_id_slot(df, "id").groupBy("_slot").count().collect()
    assert len(slots) > 200 and max(r["count"] for r in slots) < 40


def test_labelled_and_splits(spark, df, tmp_path):
    for name in ("train", "test"):
        df.withColumn("n", F.lit(name)).write.parquet(str(tmp_path / name))
    both = readers.read_all_splits(spark, {n: str(tmp_path / n) for n in ("train", "test")})
    assert both.count() == 2 * len(ROWS) and both.filter("split <> n").count() == 0
    both.write.partitionBy("split").parquet(str(tmp_path / "all"))
    one = readers.read_labelled(spark, str(tmp_path / "all"), split="test")
    assert one.count() == len(ROWS)
    assert "PartitionFilters: [isnotnull(split" in one._jdf.queryExecution().executedPlan().toString()


def test_results_are_partitioned(spark, tmp_path):
    df = spark.createDataFrame([(1, "EN"), (2, "VI")], "id long, language string")
    writers.write_results(df, str(tmp_path / "r"))
    assert (tmp_path / "r" / "language=EN").exists()


def test_scratch_uses_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    first, second = session.scratch_path(spark, "a"), session.scratch_path(spark, "a")
    assert first.startswith(shared) and first != second


def test_union_keeps_duplicates_and_tags(df):
    both = datasets.add_synthetic(df, df)
    assert both.count() == 2 * len(ROWS)
    assert {r.source for r in both.collect()} == {"original", "synthetic"}


@pytest.mark.parametrize("n", [1, 4, 5, 9])
def test_position_language(spark, n):
    ids = [7 * i + 3 + (2_000_000 if i % 2 else 0) for i in range(n)]
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(3)
    got = {r["id"]: (r.position, r.language) for r in combine.position_language(df).collect()}
    want = {i: (p, "EN" if p < n / 2 else "VI") for p, i in enumerate(sorted(ids))}
    assert got == want


def test_write_dataset_in_one_folder(spark, tmp_path):
    rows = [("EN", "train", 1, "d", "a", "x"), ("VI", "eval", 2, "d", "b", "y")]
    df = spark.createDataFrame(rows, "language string, split string, id long, instruction string, input string, output string")
    datasets.write_dataset(df, str(tmp_path / "out"))
    back = readers.read_instructions(spark, str(tmp_path / "out" / "split=eval"))
    assert [tuple(r) for r in back.select("instruction", "input", "output").collect()] == [("d", "b", "y")]


LINES = [
    '{"instruction": "do", "input": "a", "output": "x"}',
    '{"instruction": "do", "input": "b", "output": null}',
    '{"instruction": "do", "input": "c"',
    "",
    "no json",
    '{"input": "d"}',
    "[1, 2]",
    '{"instruction": "do", "input": "", "output": "y", "more": 3}',
]


def test_bad_lines_become_rejects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(LINES))
    (tmp_path / "in" / "b.json").write_text(LINES[0] + "\n" + LINES[4])
    read = readers.check_instructions(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert sorted(map(tuple, read.good.collect())) == [("do", "", "y"), ("do", "a", "x"), ("do", "a", "x")]
    got = sorted((r.file, r.reason, r.record) for r in read.rejects.collect())
    assert [(f, reason) for f, reason, _ in got if reason == "malformed"] == [("a.json", "malformed")] * 3 + [("b.json", "malformed")]
    assert {r for _, reason, r in got if reason == "malformed"} == {LINES[2], LINES[4], LINES[6]}
    assert {(reason, record) for _, reason, record in got if reason != "malformed"} == {
        ("lacks output", '{"instruction":"do","input":"b","output":null}'),
        ("lacks instruction, output", '{"instruction":null,"input":"d","output":null}'),
    }
    # What is good and what is not comes from the written table: the files are not read again.
    for f in (tmp_path / "in").iterdir():
        f.write_text("")
    assert read.good.count() == 3 and read.rejects.count() == 6


def test_rejects_of_clean_and_empty_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(LINES[0])
    (tmp_path / "in" / "b.json").write_text("")
    read = readers.check_instructions(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert (read.good.count(), read.rejects.count()) == (1, 0)


def test_bad_csv_rows_become_rejects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = ["instruction,input,output", 'do,"a, b",x', "do,c", "do,d,x,more", "do,,x", 'do,"line\nbreak",y']
    (tmp_path / "in" / "a.csv").write_text("\n".join(rows) + "\n")
    read = readers.check_csv(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert sorted(map(tuple, read.good.collect())) == [("do", "a, b", "x"), ("do", "line\nbreak", "y")]
    got = sorted((r.reason, r.record) for r in read.rejects.collect())
    assert got[0] == ("lacks input", '{"instruction":"do","input":null,"output":"x"}')
    assert [(reason, record.strip()) for reason, record in got[1:]] == [("malformed", "do,c"), ("malformed", "do,d,x,more")]
    (tmp_path / "in" / "a.csv").write_text("instruction,input\n1,2\n")
    with pytest.raises(ValueError, match="lacks"):
        readers.check_csv(spark, str(tmp_path / "in"), str(tmp_path / "again"))


@pytest.mark.parametrize("files", [1, 7, 16])
def test_files_in_name_order_hold_the_draw_order(spark, tmp_path, files):
    import hashlib

    rows = [(i, lang, "train" if i % 5 else "eval") for i in range(600) for lang in ("EN", "VI")]
    df = spark.createDataFrame(rows, "id long, language string, split string").repartition(5)
    path = str(tmp_path / "out")
    writers.write_shuffled(df, path, files, ("split",), ("language", "id"))
    for split in ("train", "eval"):
        names = sorted(glob.glob(f"{path}/split={split}/*.json"))
        got = [(r["language"], r["id"]) for f in names for r in map(json.loads, open(f, encoding="utf-8"))]
        want = sorted(
            ((lang, i) for i, lang, s in rows if s == split),
            key=lambda x: hashlib.md5(f"42:{x[0]}:{x[1]}".encode()).hexdigest(),
        )
        assert got == want
        assert len(names) == files
        # Both languages are spread over the files.
        head = got[: len(got) // 4]
        assert 0.3 < sum(lang == "EN" for lang, _ in head) / len(head) < 0.7
    back = spark.read.json(path)
    assert back.count() == len(rows)


def test_answers_bucketed_alike_join_without_a_shuffle(spark, tmp_path):
    from gleanset.operators import metrics
    from gleanset.plans import evaluation

    rows = [(i, "EN", "label it", f"text {i}", "neutral") for i in range(50)]
    examples = spark.createDataFrame(rows, "id long, language string, instruction string, input_text string, ground_truth string")
    raw = spark.createDataFrame([(i, "neutral" if i % 2 else "positive") for i in range(50) if i != 7], "id long, raw string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = [
            evaluation.stored_by_id(df, str(tmp_path), name, 4)
            for name, df in (("examples", examples), ("baseline", raw), ("finetuned", raw))
        ]
        joined = evaluation.joined_answers(*tables, missing="unparseable")
        details = metrics.detailed_results(joined)
        got = {r["id"]: (r.input_text, r.baseline_prediction, r.finetuned_correct) for r in details.collect()}
        plan = details._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and plan.count("Bucketed: true") >= 3
    assert len(got) == 50 and got[7] == ("text 7", "unparseable", False) and got[9] == ("text 9", "neutral", True)
    with pytest.raises(Exception, match="no baseline answer for example 7"):
        evaluation.joined_answers(*tables).collect()


def test_training_files_with_broken_records(spark, tmp_path):
    rows = [("EN", "train", 1, "do", "a", "x"), ("VI", "eval", 2, "do", "b", "y"), ("EN", "train", 3, "do", None, "x")]
    df = spark.createDataFrame(rows, "language string, split string, id long, instruction string, input string, output string")
    dataset, made = str(tmp_path / "d"), tmp_path / "csv"
    datasets.write_dataset(df, dataset)
    (tmp_path / "d" / "split=train" / "part-99999.json").write_text('{"id": 4, "instruction"\n')
    made.mkdir()
    (made / "a.csv").write_text("instruction,input,output\ndo,c,z\ndo,d\n")
    read = datasets.check_training(spark, dataset, str(tmp_path / "checked"), str(made))
    good = {(r.split, r.source): r.text for r in read.good.collect()}
    assert set(good) == {("train", "original"), ("eval", "original"), ("train", "synthetic")}
    assert "Text: c" in good["train", "synthetic"] and "Text: b" in good["eval", "original"]
    got = sorted((r.source, r.reason) for r in read.rejects.collect())
    assert got == [("original", "lacks input"), ("original", "malformed"), ("synthetic", "malformed")]
    with pytest.raises(Exception):
        datasets.prepare_training(spark, dataset).collect()
