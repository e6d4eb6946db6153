"""What the plans of all registered queries must look like, whatever the data."""

import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


OWN = [name for name in entry.queries() if name not in entry.LLM_QUERIES]
#: Queries whose result needs whole rows in order, or a join of the fixture's own texts.
WIDE = {
    "distinct_sorted": "sorted by text",
    "duplicates_listing": "sorted by text",
    "first_rows": "the first rows by id",
    "first_rows_by_language": "the first rows by id, five of a language from each task",
    "null_profile": "joins labels to documents with their texts before it profiles them",
}
TEXTS = {"text", "input", "sentence", "cleaned", "input_text", "baseline_raw_output", "finetuned_raw_output"}


def plan_node(df):
    plan = df._jdf.queryExecution().executedPlan()
    return plan.initialPlan() if hasattr(plan, "initialPlan") and "Adaptive" in plan.nodeName() else plan


def shuffled(node):
    """The column names of every shuffle."""
    if "ShuffleExchange" in node.getClass().getSimpleName():
        out = node.output()
        yield {out.apply(i).name() for i in range(out.size())}
    children = node.children()
    for i in range(children.size()):
        yield from shuffled(children.apply(i))


@pytest.fixture
def no_broadcast(spark):
    """Only sides that the operators mark as bounded are broadcast, as with large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", OWN)
def test_no_cross_join_no_python_and_no_text_in_a_shuffle(spark, no_broadcast, name):
    """With broadcasting off: only narrow rows travel, that is keys, ids, classes and slots. What a
    query writes and reads again on the way is looked at where it is written, in the next test."""
    df = entry.queries()[name](spark, SF_DIR)
    plan = plan_of(df)
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "FlatMapGroupsInPandas"):
        assert unwanted not in plan
    if name != "batch_infer":
        assert "InArrow" not in plan and "InPandas" not in plan
    # Rows of the second language are documents joined with labels, texts included: given so.
    if name not in WIDE and "vi_raw" not in entry.oracle_sql()[name]:
        assert not [columns for columns in shuffled(plan_node(df)) if TEXTS & columns]


def test_what_is_written_on_the_way_has_no_wide_shuffle(spark, no_broadcast):
    from gleanset.catalog import fixtures as fx
    from gleanset.catalog import registry
    from gleanset.plans import evaluation, synthetic

    written = spark.range(3).selectExpr("id AS attempt", "'a b c d' AS text")
    rows = spark.range(3).selectExpr("id", "'EN' AS language", "'i' AS instruction", "'x' AS input", "'neutral' AS output")
    for df in (
        synthetic.label_snippets(written, registry.labeller_model()),
        evaluation.answer_all(rows, registry.answer_model(0), registry.answer_model(1)),
        registry.generation.prompt_schedule(fx.prompts(spark, SF_DIR)),
    ):
        plan = plan_of(df)
        assert "BroadcastNestedLoopJoin" not in plan and "BatchEvalPython" not in plan
        assert not [columns for columns in shuffled(plan_node(df)) if TEXTS & columns]


def test_scans_read_only_what_is_used(spark):
    plan = plan_of(entry.queries()["length_describe"](spark, SF_DIR))
    assert "ReadSchema: struct<text:string,lang:string>" in plan
    plan = plan_of(entry.queries()["sample_per_source"](spark, SF_DIR))
    assert "text" not in plan


def test_the_dedup_shuffle_serves_every_branch_of_a_split(spark):
    df = entry.queries()["scarce_first_split"](spark, SF_DIR)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning(_key0#") - final.count("ReusedExchange [_key0#") == 1
    assert final.count("ReusedExchange") >= 2


@pytest.mark.parametrize(
    "name,scans",
    [
        ("length_histogram", 1),
        ("boxplot_stats", 1),
        ("stage_funnel", 1),
        ("stage_funnel_second", 1),
        ("balanced_split", 1),
        ("proportional_sample", 1),
        ("split_overlap", 1),
        ("dedup_keep_first", 1),
        ("eda_findings", 2),
        ("synthetic_finish", 2),
        ("top_up", 0),
        ("dataset_build", 4),
    ],
)
def test_texts_are_scanned_no_more_than_needed(spark, name, scans):
    df = entry.queries()[name](spark, SF_DIR)
    df.collect()
    final = plan_of(df).split("\n+- == Initial Plan ==")[0]
    assert sum("FileScan" in line and "text#" in line for line in final.splitlines()) == scans


def test_a_build_that_counts_its_stages_scans_no_more(spark):
    """As many scans of the texts as without counts, and each dedup shuffle still runs once."""
    from gleanset.catalog import fixtures as fx
    from gleanset.catalog import registry
    from gleanset.operators.observed import StageCounts
    from gleanset.plans import datasets

    counts = {"EN": StageCounts(), "VI": StageCounts()}
    raw = fx.en_raw(spark, SF_DIR), fx.vi_raw(spark, SF_DIR)
    df = datasets.build_dataset(*raw, registry.EN_QUOTA, registry.VI_QUOTA, counts=counts)
    rows = sorted(map(tuple, df.collect()))
    plain = datasets.build_dataset(*raw, registry.EN_QUOTA, registry.VI_QUOTA)
    assert rows == sorted(map(tuple, plain.collect()))
    final = plan_of(df).split("\n+- == Initial Plan ==")[0]
    assert sum("FileScan" in line and "text#" in line for line in final.splitlines()) == 4
    for language, funnel in (("EN", datasets.english_funnel(raw[0])), ("VI", datasets.second_funnel(raw[1]))):
        assert sorted(map(tuple, counts[language].table(spark).collect())) == sorted(map(tuple, funnel.collect()))
    with pytest.raises(ValueError, match="other rows"):
        datasets.build_dataset(*raw, counts=counts)
    with pytest.raises(ValueError, match="nothing is watched"):
        StageCounts().counts()


def test_all_metrics_share_one_scan(spark):
    df = entry.queries()["metric_table"](spark, SF_DIR)
    df.collect()
    assert plan_of(df).split("\n+- == Initial Plan ==")[0].count("FileScan") == 1
