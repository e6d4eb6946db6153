"""Prompt fan-out, batch inference and checks on what comes back."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanset import fixed
from gleanset.functions import chat, labels as lb, text as tx
from gleanset.operators import dedup
from gleanset.operators import ranking as rk
from gleanset.session import is_complete, materialized


def model_profile(
    task_cpus: int = 1,
    task_gpus: float = 0,
    executor_cores: int | None = None,
    executor_memory: str | None = None,
    executor_gpus: int = 0,
    gpu_script: str = "",
) -> ResourceProfile:
    """Resources for the stages that run a model; the rest of a run keeps the session's own.

    Given executor figures ask the cluster for executors of their own (which takes dynamic allocation);
    without them the tasks share the session's executors and only take other slots there. ``gpu_script``
    is the discovery script for GPUs. ``task_gpus`` below 1 lets several tasks share one.
    """
    builder = ResourceProfileBuilder()
    tasks = TaskResourceRequests().cpus(task_cpus)
    builder.require(tasks.resource("gpu", task_gpus) if task_gpus else tasks)
    if executor_cores is not None or executor_memory is not None or executor_gpus:
        wanted = ExecutorResourceRequests()
        if executor_cores is not None:
            wanted = wanted.cores(executor_cores)
        if executor_memory is not None:
            wanted = wanted.memory(executor_memory)
        if executor_gpus:
            wanted = wanted.resource("gpu", executor_gpus, gpu_script)
        builder.require(wanted)
    return builder.build


def prompt_schedule(
    prompts: DataFrame,
    target: int = fixed.SYNTHETIC_ATTEMPT_TARGET,
    per_prompt: int = fixed.ATTEMPTS_PER_PROMPT,
) -> DataFrame:
    """Attempts in order: ``target // per_prompt + number of prompts`` rounds that cycle the prompts.

    ``prompts`` has ``prompt_no`` (0, 1, .., each once, or this fails) and ``prompt``. The attempts are
    a range that Spark splits over its tasks; only the extent of the numbers is fetched.
    """
    n = prompt_count(prompts)
    return _attempts(prompts, n, per_prompt, 0, attempt_count(n, target, per_prompt))


def prompt_count(prompts: DataFrame) -> int:
    """How many prompts there are; fails unless they are numbered 0, 1, .. with each number once."""
    number = F.col("prompt_no")
    n, low, high, different = prompts.agg(
        F.count(F.lit(1)), F.min(number), F.max(number), F.count_distinct(number)
    ).first()
    if n == 0:
        raise ValueError("no prompts")
    if (low, high, different) != (0, n - 1, n):
        raise ValueError(f"prompts are numbered 0 to {n - 1}; found {low} to {high}, {different} different")
    return n


def attempt_count(n: int, target: int, per_prompt: int) -> int:
    """Attempts that ``n`` prompts are given at most."""
    return (target // per_prompt + n) * per_prompt


def _attempts(prompts: DataFrame, n: int, per_prompt: int, start: int, stop: int) -> DataFrame:
    attempts = prompts.sparkSession.range(start, stop).select(
        F.col("id").alias("attempt"),
        F.pmod(F.floor(F.col("id") / per_prompt), F.lit(n)).alias("prompt_no"),
    )
    return attempts.join(prompts.select(F.col("prompt_no").cast("bigint").alias("prompt_no"), "prompt"), "prompt_no")


def batch_infer(
    df: DataFrame,
    prompt_col: str,
    load: Callable[[], Callable[[Sequence[str]], Sequence[str]]],
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Run a model over a prompt column; adds ``raw`` and ``error``.

    ``load`` runs once per task and returns a function from a list of prompts to a list of
    answers. When a batch fails its prompts are retried one by one, so a failing prompt gets an
    ``error`` and a null ``raw`` while the others keep their answers. Other columns pass through
    as Arrow data. The function sees each partition batch by batch, never a whole partition.

    With a ``profile`` (see :func:`model_profile`) the stage that runs the model gets those resources.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("raw", T.StringType()), T.StructField("error", T.StringType())])

    # Both functions are nested so that they travel to the workers by value.
    def answers(model, prompts):
        try:
            together = list(model(prompts))
            if len(together) == len(prompts) and all(a is None or isinstance(a, str) for a in together):
                return together, [None] * len(prompts)
        except Exception:  # noqa: BLE001 - whatever user code raised, look for the failing prompt
            pass
        raw, errors = [], []
        for prompt in prompts:
            try:
                (answer,) = model([prompt])
                if not (answer is None or isinstance(answer, str)):
                    raise TypeError(f"the answer is {type(answer).__name__}, not str")
                raw.append(answer)
                errors.append(None)
            except Exception as failure:  # noqa: BLE001
                raw.append(None)
                errors.append(f"{type(failure).__name__}: {failure}")
        return raw, errors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            raw, errors = answers(model, batch.column(prompt_col).to_pylist())
            columns = [*batch.columns, pa.array(raw, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "raw", "error"])

    return df.mapInArrow(run, schema, profile=profile)


def answered(inferred: DataFrame) -> DataFrame:
    """Rows the model answered."""
    return inferred.filter(F.col("error").isNull()).drop("error")


def failed(inferred: DataFrame) -> DataFrame:
    """Rows the model failed on, with the reason."""
    return inferred.filter(F.col("error").isNotNull()).drop("raw")


def snippets(attempts: DataFrame, prompt_col: str = "prompt", raw_col: str = "raw") -> DataFrame:
    """Generated texts with the prompt's tail cut off, longer than three words, as ``text``."""
    text = chat.strip_prompt_echo(F.col(prompt_col), tx.strip(F.col(raw_col)))
    return attempts.withColumn("text", text).filter(
        tx.has_min_words(F.col("text"), fixed.SNIPPET_MIN_WORDS)
    )


def collect_unique(attempts: DataFrame, cap: int, text_col: str = "text", order_col: str = "attempt") -> DataFrame:
    """The first ``cap`` distinct texts in attempt order, as (text, attempt) rows.

    Texts are compared by key, and only the chosen ones are fetched. ``attempts`` is read twice, so
    it should be a written table when it comes from a model.
    """
    firsts = dedup.first_of_each(attempts, [text_col], order_col).select(order_col)
    return _first_texts(attempts.select(text_col, order_col), firsts, cap, text_col, order_col)


def _first_texts(attempts: DataFrame, firsts: DataFrame, cap: int, text_col: str, order_col: str) -> DataFrame:
    """The texts of the first ``cap`` of the attempts in ``firsts``."""
    if cap <= rk.ONE_TASK_ROWS:
        picked = firsts.orderBy(order_col).limit(cap)
    else:
        slotted = rk.with_id_slot(firsts, order_col)
        ranked = rk.rank_by_slots(slotted, rk.slot_counts(slotted), upto=cap, order=(order_col,))
        picked = ranked.select(order_col)
    return rk.fetch(attempts, picked, order_col, cap).select(text_col, order_col)


#: The first wave has as many attempts as texts are wanted, later ones what the yield so far calls for
#: and this part more, and none more than so many times all attempts before it.
SPARE, FASTEST = 0.1, 4


def wave_size(cap: int, found: int, done: int, total: int) -> int:
    """Attempts to make next, with ``found`` different texts after ``done`` of ``total`` attempts."""
    size = cap
    if done:
        size = min(-(-(cap - found) * done // max(found, 1)) * (1 + SPARE), FASTEST * done)
    return min(max(int(size), 1), total - done)


def collect_in_waves(
    prompts: DataFrame,
    load: Callable[[], Callable[[Sequence[str]], Sequence[str]]],
    folder: str,
    cap: int,
    per_prompt: int = fixed.ATTEMPTS_PER_PROMPT,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """The first ``cap`` distinct texts in attempt order, asking the model no further than they need.

    What :func:`collect_unique` makes of all attempts of :func:`prompt_schedule`, but the attempts are made
    in waves, until there are enough texts or no attempts are left. Each wave's answers are written under
    ``folder``, then the keys that no wave before had; those are 40 bytes a text, ``cap`` and a wave of
    them at most. A wave that is there complete is not asked for again, so a run that was lost goes on
    where it stopped, given the same folder, prompts and numbers.
    """
    spark, n = prompts.sparkSession, prompt_count(prompts)
    total, done, found, wave = attempt_count(n, cap, per_prompt), 0, 0, 0
    written, keys = [], []
    while not written or (done < total and found < cap):
        size = wave_size(cap, found, done, total)
        path = f"{folder}/wave-{wave:05d}"
        if is_complete(spark, path):
            made = spark.read.parquet(path)
        else:
            asked = _attempts(prompts, n, per_prompt, done, done + size)
            made = materialized(snippets(answered(batch_infer(asked, "prompt", load, profile))), path, "overwrite")
        firsts = dedup.first_of_each(made, ["text"], "attempt", keep_keys=True).select("_key0", "attempt")
        if keys:
            known = reduce(DataFrame.unionByName, keys).select("_key0")
            if found <= rk.BROADCAST_ROWS:
                known = F.broadcast(known)
            firsts = firsts.join(known, "_key0", "left_anti")
        firsts = materialized(firsts, f"{folder}/keys-{wave:05d}", "overwrite")
        written.append(made.select("text", "attempt"))
        keys.append(firsts)
        found, done, wave = found + firsts.count(), done + size, wave + 1
    texts, firsts = (reduce(DataFrame.unionByName, part) for part in (written, keys))
    return _first_texts(texts, firsts.select("attempt"), cap, "text", "attempt")


def labelled_rows(answers: DataFrame, text_col: str = "text", raw_col: str = "raw") -> DataFrame:
    """Instruction rows from labelling answers; a blank answer gives no row."""
    columns = [c for c in answers.columns if c not in (text_col, raw_col)]
    return answers.select(
        *columns,
        F.lit(fixed.INSTRUCTION).alias("instruction"),
        F.col(text_col).alias("input"),
        F.col(raw_col).alias("output_raw_llm"),
        lb.clean_label(F.col(raw_col)).alias("output"),
    ).filter(F.col("output").isNotNull())


def validated(rows: DataFrame) -> DataFrame:
    """Add the label flag, the word count and the length flag."""
    return (
        rows.withColumn("label_is_valid", lb.in_label_set(F.col("output")))
        .withColumn("word_count", tx.word_count(F.col("input")))
        .withColumn(
            "input_length_ok",
            F.col("word_count").between(fixed.SNIPPET_MIN_WORDS, fixed.SNIPPET_MAX_WORDS),
        )
    )


def passing(rows: DataFrame) -> DataFrame:
    """Rows that pass both flags."""
    return rows.filter(F.col("label_is_valid") & F.col("input_length_ok"))
