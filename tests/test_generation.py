import pytest
from pyspark.sql import functions as F

from gleanset import fixed
from gleanset.operators import generation
from gleanset.operators import ranking as rk
from gleanset.plans import synthetic


def test_schedule_cycles_the_prompts(spark):
    prompts = spark.createDataFrame([(0, "p0:"), (1, "p1:"), (2, "p2:")], "prompt_no long, prompt string")
    rows = generation.prompt_schedule(prompts, target=7, per_prompt=2).orderBy("attempt").collect()
    assert [r.attempt for r in rows] == list(range((7 // 2 + 3) * 2))
    assert [r.prompt_no for r in rows] == [(i // 2) % 3 for i in range(12)]
    assert all(r.prompt == f"p{r.prompt_no}:" for r in rows)
    with pytest.raises(ValueError):
        generation.prompt_schedule(prompts.limit(0))


@pytest.mark.parametrize("numbers", [(0, 1, 5), (1, 2, 3), (0, 1, 1), (0, None, 1)])
def test_schedule_refuses_gaps_offsets_and_repeats(spark, numbers):
    prompts = spark.createDataFrame([(i, "p") for i in numbers], "prompt_no long, prompt string")
    with pytest.raises(ValueError, match="numbered 0 to 2"):
        generation.prompt_schedule(prompts)


def test_an_answer_that_is_no_text_is_a_row_error(spark):
    def load():
        return lambda prompts: [7 if p == "odd" else p for p in prompts]

    df = spark.createDataFrame([(0, "odd"), (1, "x")], "id long, prompt string").coalesce(1)
    got = {r["id"]: (r.raw, r.error) for r in generation.batch_infer(df, "prompt", load).collect()}
    assert got == {0: (None, "TypeError: the answer is int, not str"), 1: ("x", None)}


def test_finish_takes_first_copies_that_pass(spark):
    rows = [(i, "ins", f"one two three text {i % 4}", "raw", "neutral" if i % 4 else "odd", bool(i % 4), 5, True) for i in range(20)]
    df = spark.createDataFrame(
        rows, "id long, instruction string, input string, output_raw_llm string, output string, label_is_valid boolean, word_count long, input_length_ok boolean"
    )
    assert sorted(r["id"] for r in synthetic.finish(df, 10).collect()) == [1, 2, 3]
    assert tuple(synthetic.synthetic_checks(df).first()) == (20, 5, 0, 16)


def test_schedule_size_of_the_default_run(spark):
    prompts = spark.range(47).select(F.col("id").alias("prompt_no"), F.lit("p").alias("prompt"))
    assert generation.prompt_schedule(prompts).count() == 1035


def failing_model():
    def load():
        def answer(prompts):
            if any("bad" in p for p in prompts):
                raise KeyError("bad prompt")
            return [p.upper() for p in prompts]

        return answer

    return load


def test_batch_infer_reports_failing_rows(spark):
    rows = [(i, "bad" if i % 10 == 3 else f"p{i}", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, prompt string, w double").repartition(3)
    inferred = generation.batch_infer(df, "prompt", failing_model())
    good = generation.answered(inferred).collect()
    assert {(r["id"], r.raw, r.w) for r in good} == {(i, p.upper(), w) for i, p, w in rows if p != "bad"}
    broken = generation.failed(inferred).collect()
    assert {r["id"] for r in broken} == {i for i, p, _ in rows if p == "bad"}
    assert all("KeyError" in r.error for r in broken)


def test_collect_unique_keeps_attempt_order(spark, monkeypatch):
    texts = ["b", "a", "b", "c", "a", "d"]
    df = spark.createDataFrame(list(enumerate(texts)), "attempt long, text string").repartition(3)

    def got():
        return sorted((r.attempt, r.text) for r in generation.collect_unique(df, 3).collect())

    assert got() == [(0, "b"), (1, "a"), (3, "c")]
    monkeypatch.setattr(rk, "ONE_TASK_ROWS", 0)
    assert got() == [(0, "b"), (1, "a"), (3, "c")]


def test_snippets(spark):
    rows = [("Say. Headline:", " one two three four "), ("Say: up", "up one two three"), ("Say: up", "up one two three four")]
    df = spark.createDataFrame(rows, "prompt string, raw string")
    assert [r.text for r in generation.snippets(df).collect()] == ["one two three four", "one two three four"]


def test_labelled_and_validated(spark):
    rows = [
        (1, "a b c d", "Positive."),
        (2, "a b c", "negative, x"),
        (3, "a b c d", "Positive!"),
        (4, "a b c d", " "),
        (5, " ".join("w" * 81), "neutral"),
    ]
    df = spark.createDataFrame(rows, "id long, text string, raw string")
    checked = generation.validated(generation.labelled_rows(df))
    assert checked.columns == [
        "id", "instruction", "input", "output_raw_llm", "output", "label_is_valid", "word_count", "input_length_ok",
    ]
    got = {r["id"]: (r.output, r.label_is_valid, r.word_count, r.input_length_ok) for r in checked.collect()}
    assert got == {
        1: ("positive", True, 4, True),
        2: ("negative", True, 3, False),
        3: ("positive!", False, 4, True),
        5: ("neutral", True, 81, False),
    }
    assert [r["id"] for r in generation.passing(checked).collect()] == [1]


def counting_writer(folder):
    """Leaves one file per model call, so that a test can count the calls."""

    def load():
        def answer(prompts):
            import os
            import uuid

            open(os.path.join(folder, uuid.uuid4().hex), "w").close()
            return [f"{p} one two three" for p in prompts]

        return answer

    return load


def labeller():
    def load():
        return lambda prompts: ["Neutral." for _ in prompts]

    return load


def test_synthetic_build_asks_each_model_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    prompts = spark.range(12).select(F.col("id").alias("prompt_no"), F.concat(F.lit("text "), F.col("id")).alias("prompt"))
    made = synthetic.build_synthetic(
        prompts, counting_writer(str(calls)), labeller(), str(tmp_path / "run"), n=5, target=10, per_prompt=1
    )
    rows = made.collect()
    batches = len(list(calls.iterdir()))
    assert len(rows) == 5 and {r.output for r in rows} == {"neutral"}
    assert {r.instruction for r in rows} == {fixed.INSTRUCTION}
    made.count()
    assert len(list(calls.iterdir())) == batches


def cycling_writer(folder, texts):
    """Gives prompt ``p<n>`` the text of that number, and notes every prompt it is asked."""

    def load():
        def answer(prompts):
            import os
            import uuid

            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write("\n".join(prompts))
            return [f"one two three text {int(p[1:]) % texts}" for p in prompts]

        return answer

    return load


def asked(folder):
    return sum(len(f.read_text().splitlines()) for f in folder.iterdir())


@pytest.mark.parametrize("texts", [1, 7, 60, 200])
@pytest.mark.parametrize("few", [True, False])
def test_waves_give_the_same_texts_and_stop_at_the_cap(spark, tmp_path, monkeypatch, texts, few):
    """``texts`` different ones come out of 200 prompts; 40 are wanted."""
    if not few:
        monkeypatch.setattr(rk, "BROADCAST_ROWS", 0)
    cap, per_prompt, n = 40, 2, 200
    prompts = spark.range(n).select(F.col("id").alias("prompt_no"), F.concat(F.lit("p"), F.col("id")).alias("prompt"))
    calls = [tmp_path / "all", tmp_path / "waves"]
    for folder in calls:
        folder.mkdir()
    attempts = generation.prompt_schedule(prompts, cap, per_prompt)
    answers = generation.answered(generation.batch_infer(attempts, "prompt", cycling_writer(str(calls[0]), texts)))
    generation.snippets(answers).write.parquet(str(tmp_path / "answers"))
    everything = spark.read.parquet(str(tmp_path / "answers"))
    want = sorted(map(tuple, generation.collect_unique(everything, cap).collect()))
    load = cycling_writer(str(calls[1]), texts)
    got = generation.collect_in_waves(prompts, load, str(tmp_path / "run"), cap, per_prompt)
    assert sorted(map(tuple, got.collect())) == want and len(want) == min(cap, texts)
    total = (cap // per_prompt + n) * per_prompt
    assert asked(calls[0]) == total
    if texts >= cap:
        # Each prompt gives its text twice, so 80 attempts are the fewest that have 40 texts.
        assert 2 * cap <= asked(calls[1]) <= 2 * cap * 1.3 < total
    else:
        assert asked(calls[1]) == total


def test_a_lost_run_goes_on_with_the_next_wave(spark, tmp_path):
    prompts = spark.range(50).select(F.col("id").alias("prompt_no"), F.concat(F.lit("p"), F.col("id")).alias("prompt"))
    calls = tmp_path / "calls"
    calls.mkdir()

    def wanted(folder):
        load = cycling_writer(str(calls), 50)
        return sorted(map(tuple, generation.collect_in_waves(prompts, load, str(tmp_path / folder), 20, 2).collect()))

    first = wanted("run")
    before = asked(calls)
    (tmp_path / "run" / "wave-00001" / "_SUCCESS").unlink()  # as if the second wave had not ended
    assert wanted("run") == first
    waves = len(list((tmp_path / "run").glob("wave-*")))
    assert waves > 1 and 0 < asked(calls) - before < before


def test_wave_sizes():
    assert generation.wave_size(100, 0, 0, 1000) == 100
    assert generation.wave_size(100, 50, 100, 1000) == 110  # half were new: as many again and a tenth
    assert generation.wave_size(100, 0, 100, 1000) == 400  # none were new: no more than four times as many
    assert generation.wave_size(100, 99, 990, 1000) == 10
    assert generation.wave_size(0, 0, 0, 10) == 1


def profile_of(df):
    node = df._jdf.queryExecution().analyzed()
    while "MapInArrow" not in node.nodeName():
        node = node.children().apply(0)
    return node.profile()


def test_a_model_stage_gets_its_own_resources(spark):
    df = spark.range(4).select("id", F.lit("p").alias("prompt"))
    load = labeller()
    assert profile_of(generation.batch_infer(df, "prompt", load)).isEmpty()
    wanted = generation.model_profile(
        task_cpus=4, task_gpus=0.5, executor_cores=8, executor_memory="20g", executor_gpus=1, gpu_script="/opt/gpus.sh"
    )
    inferred = generation.batch_infer(df, "prompt", load, wanted)
    found = profile_of(inferred).get()
    tasks, executors = found.taskResources(), found.executorResources()
    assert {k: tasks.apply(k).amount() for k in ("cpus", "gpu")} == {"cpus": 4.0, "gpu": 0.5}
    assert {k: executors.apply(k).amount() for k in ("cores", "memory", "gpu")} == {"cores": 8, "memory": 20480, "gpu": 1}
    assert executors.apply("gpu").discoveryScript() == "/opt/gpus.sh"
    assert inferred.columns == ["id", "prompt", "raw", "error"]
    # The stage before and after keep the session's resources: nothing else in the plan has a profile.
    assert str(inferred.filter("raw = 'x'")._jdf.queryExecution().analyzed()).count("MapInArrow") == 1


def test_plans_hand_profiles_on(spark):
    from gleanset.plans import evaluation

    wanted = generation.model_profile(task_cpus=2)
    texts = spark.range(2).select(F.col("id").alias("attempt"), F.lit("a b c d").alias("text"))
    assert profile_of(synthetic.label_snippets(texts, labeller(), wanted)).get().taskResources().apply("cpus").amount() == 2
    rows = spark.range(2).selectExpr("id", "'EN' AS language", "'i' AS instruction", "'x' AS input", "'neutral' AS output")
    answered = evaluation.answer_all(rows, labeller(), labeller(), wanted)
    assert profile_of(answered).get().taskResources().apply("cpus").amount() == 2
    assert profile_of(synthetic.label_snippets(texts, labeller())).isEmpty()
