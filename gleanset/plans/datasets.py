"""Building the train and eval sets from the two labelled sources.

The only wide step is the last one. Up to the split, rows are a 32-byte text key, an id and a
class index: keep-first needs one narrow shuffle, and what depends on the text alone is filtered
before it, which leaves the same rows because all copies of a text agree on it. The chosen ids
(their number is the quota) are then broadcast to a second scan that fetches and cleans the text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanset import fixed
from gleanset.functions import chat
from gleanset.functions import labels as lb
from gleanset.functions.keys import text_key
from gleanset.functions import text as tx
from gleanset.operators import combine, dedup, ranking, sampling
from gleanset.operators.observed import StageCounts
from gleanset.operators.profile import stage_funnel
from gleanset.sources.readers import DATASET_SCHEMA, Checked, check_csv, check_instructions, read_csv, read_dataset
from gleanset.sources.writers import write_shuffled


def english_text_ok(text: Column, min_words: int = fixed.EN_MIN_WORDS) -> Column:
    """Enough words and an ASCII letter left after cleaning.

    Edge whitespace changes neither, and a text without markers is tested as it is.
    """

    def ok(x: Column) -> Column:
        return tx.has_min_words(x, min_words) & tx.has_ascii_letter(x)

    return F.when(tx.has_markers(text), ok(tx.remove_markers(text))).otherwise(ok(text))


def second_text_ok(text: Column, min_words: int = fixed.VI_MIN_WORDS) -> Column:
    return tx.has_min_words(text, min_words)


def _class_or_none(label: Column) -> Column:
    return F.coalesce(lb.class_index(label), F.lit(-1))


def english_rows(
    raw: DataFrame, min_words: int = fixed.EN_MIN_WORDS, counts: StageCounts | None = None
) -> DataFrame:
    """(id, label) of the usable rows of (id, input, output): first copies with text and label.

    With ``counts`` the same plan also counts the rows of :func:`english_funnel` as it runs; unusable
    texts then go through the dedup too, as keys, because the funnel counts them there.
    """
    if counts is None:
        raw = raw.filter(english_text_ok(F.col("input"), min_words))
    firsts = _english_firsts(raw, min_words)
    if counts is not None:
        firsts = counts.watch(firsts, *english_stages()).filter("text_ok")
    return firsts.filter("class >= 0").select("id", lb.class_name(F.col("class")).alias("label"))


def second_rows(
    raw: DataFrame,
    unwanted: Sequence[str] = fixed.CONTRADICTED_SENTENCES,
    min_words: int = fixed.VI_MIN_WORDS,
    counts: StageCounts | None = None,
) -> DataFrame:
    """(id, label) of the usable rows of (id, sentence, sentiment). For ``counts`` see :func:`english_rows`."""
    if counts is None:
        raw = dedup.drop_listed(raw, "sentence", unwanted).filter(second_text_ok(F.col("sentence"), min_words))
    firsts = _second_firsts(raw, unwanted, min_words)
    if counts is not None:
        firsts = counts.watch(firsts, *second_stages()).filter("text_ok AND NOT listed")
    return firsts.filter("class >= 0").select("id", lb.class_name(F.col("class")).alias("label"))


def english_clean(raw: DataFrame, min_words: int = fixed.EN_MIN_WORDS, folder: str | None = None) -> DataFrame:
    """All usable English rows with their cleaned text, for uses that need every one of them.

    With a ``folder`` the ids of surplus copies are written there, so that the texts need not travel.
    """
    usable = raw.filter(english_text_ok(F.col("input"), min_words))
    kept = dedup.dedup_keep_first(usable, ["input"], folder=folder)
    return (
        kept.withColumn("label", lb.map_terms(F.col("output")))
        .dropna(subset=["label"])
        .select("id", tx.clean_text(F.col("input")).alias("input"), "label")
    )


def _english_firsts(raw: DataFrame, min_words: int) -> DataFrame:
    return dedup.first_of_each(
        raw,
        ["input"],
        carry={
            "text_ok": english_text_ok(F.coalesce("input", F.lit("")), min_words),
            "class": _class_or_none(lb.map_terms(F.col("output"))),
        },
    )


def english_stages() -> tuple[dict[str, Column], dict[str, Column]]:
    """The stages a first copy passes, and what it stands for before them."""
    stages = {"deduplicated": F.lit(True), "cleaned": F.col("text_ok"), "mapped": F.col("class") >= 0}
    return stages, {"loaded": F.col("copies")}


def english_funnel(raw: DataFrame, min_words: int = fixed.EN_MIN_WORDS) -> DataFrame:
    """Rows left after dedup, cleaning and mapping, from one narrow aggregate."""
    return stage_funnel(_english_firsts(raw, min_words), *english_stages())


def _second_firsts(raw: DataFrame, unwanted: Sequence[str], min_words: int) -> DataFrame:
    text = F.col("sentence")
    return dedup.first_of_each(
        raw,
        ["sentence"],
        carry={
            "listed": F.coalesce(text.isin(list(unwanted)), F.lit(False)),
            "text_ok": F.coalesce(second_text_ok(text, min_words), F.lit(False)),
            "class": _class_or_none(lb.map_codes(F.col("sentiment"))),
        },
    )


def second_stages() -> tuple[dict[str, Column], dict[str, Column]]:
    """See :func:`english_stages`."""
    stages = {
        "unlisted": ~F.col("listed"),
        "deduplicated": F.lit(True),
        "long_enough": F.col("text_ok"),
        "mapped": F.col("class") >= 0,
    }
    return stages, {"loaded": F.col("copies"), "unlisted": F.col("copies")}


def second_funnel(
    raw: DataFrame,
    unwanted: Sequence[str] = fixed.CONTRADICTED_SENTENCES,
    min_words: int = fixed.VI_MIN_WORDS,
) -> DataFrame:
    """Rows left after removing listed sentences, dedup, the length filter and mapping."""
    return stage_funnel(_second_firsts(raw, unwanted, min_words), *second_stages())


def build_dataset(
    english: DataFrame,
    second: DataFrame,
    en_rows: tuple[int, int] = (fixed.EN_EVAL_ROWS, fixed.EN_TRAIN_ROWS),
    vi_rows: tuple[int, int] = (fixed.VI_EVAL_ROWS, fixed.VI_TRAIN_ROWS),
    seed: int = fixed.SEED,
    counts: Mapping[str, StageCounts] | None = None,
    strict: bool = False,
) -> DataFrame:
    """Train and eval rows of both languages: language, split, id, instruction, input, output.

    ``english`` has (id, input, output), ``second`` (id, sentence, sentiment); quotas are
    (eval, train). ``counts`` (for ``EN`` and ``VI``) take the rows left after each stage from the run
    that writes the result; see :func:`english_rows`. ``strict`` fails a run whose English ``eval``
    cannot be filled; see :func:`gleanset.operators.sampling.balanced_split`.
    """
    counts = counts or {}
    en_split = sampling.balanced_split(english_rows(english, counts=counts.get("EN")), *en_rows, seed=seed, strict=strict)
    vi_split = sampling.scarce_first_split(second_rows(second, counts=counts.get("VI")), *vi_rows, seed=seed)
    en = ranking.fetch(english.select("id", F.col("input").alias("text")), en_split, "id", sum(en_rows))
    vi = ranking.fetch(second.select("id", F.col("sentence").alias("text")), vi_split, "id", sum(vi_rows))
    keep = ("split", "id")
    return combine.tagged_union(
        {
            "EN": combine.to_instructions(en.withColumn("text", tx.clean_text(F.col("text"))), "text", "label", keep),
            "VI": combine.to_instructions(vi, "text", "label", keep),
        },
        "language",
    )


def write_dataset(dataset: DataFrame, path: str, seed: int = fixed.SEED, files: int = 16) -> None:
    """One job: ``split=train`` and ``split=eval`` folders of JSON lines, shuffled across languages.

    Read in the order of their names, the files of a split hold its rows in draw order; see
    :func:`gleanset.sources.writers.write_shuffled`. ``files`` is how many there are of each split at most.
    """
    write_shuffled(dataset, path, files, ("split",), ("language", "id"), seed)


def add_synthetic(train: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Training rows of both origins, with a ``source`` column."""
    columns = ["instruction", "input", "output"]
    return combine.tagged_union({"original": train.select(columns), "synthetic": synthetic.select(columns)}, "source")


def prepare_training(
    spark: SparkSession,
    dataset_path: str,
    synthetic_path: str | None = None,
    template: chat.ChatTemplate = chat.ChatTemplate(),
) -> DataFrame:
    """Chat texts for training from written files: (split, source, text).

    The train split of a written dataset (JSON lines), with the synthetic rows of a CSV folder added
    to it, and its eval split. A record without instruction, input or output fails the run.
    """
    rows = read_dataset(spark, dataset_path).withColumn("source", F.lit("original")).select(TRAINING)
    if synthetic_path is not None:
        rows = rows.unionByName(_synthetic(read_csv(spark, synthetic_path)))
    checked = rows.filter(chat.require_fields(F.col("instruction"), F.col("input"), F.col("output")))
    return _training_texts(checked, template)


TRAINING = ["split", "source", "instruction", "input", "output"]


def _synthetic(made: DataFrame) -> DataFrame:
    return made.withColumns({"split": F.lit("train"), "source": F.lit("synthetic")}).select(TRAINING)


def _training_texts(rows: DataFrame, template: chat.ChatTemplate) -> DataFrame:
    messages = chat.to_messages(F.col("instruction"), F.col("input"), F.col("output"))
    return rows.select("split", "source", chat.render_chat(messages, template).alias("text"))


def check_training(
    spark: SparkSession,
    dataset_path: str,
    folder: str,
    synthetic_path: str | None = None,
    template: chat.ChatTemplate = chat.ChatTemplate(),
) -> Checked:
    """:func:`prepare_training` that goes on: the good texts, and (source, file, record, reason) of every line
    or row that is malformed or lacks a field. What was read is written once under the new ``folder``."""
    # Split folders are no part of a line, so their names are not asked for there.
    original = check_instructions(spark, dataset_path, f"{folder}/original", DATASET_SCHEMA)
    good = original.good.withColumn("source", F.lit("original")).select(TRAINING)
    rejects = original.rejects.withColumn("source", F.lit("original"))
    if synthetic_path is not None:
        made = check_csv(spark, synthetic_path, f"{folder}/synthetic")
        good = good.unionByName(_synthetic(made.good))
        rejects = rejects.unionByName(made.rejects.withColumn("source", F.lit("synthetic")))
    return Checked(_training_texts(good, template), rejects.select("source", "file", "record", "reason"))


def dataset_shortfall(dataset: DataFrame, wanted: dict[str, dict[str, int]]) -> DataFrame:
    """What each language's splits wanted and got; ``wanted`` maps a language to rows per split."""
    got = dataset.select("language", "split", F.col("output").alias("label"))
    return combine.tagged_union(
        {
            language: sampling.shortfall(got.filter(F.col("language") == language).drop("language"), goals)
            for language, goals in wanted.items()
        },
        "language",
    )


def dataset_overlap(dataset: DataFrame) -> DataFrame:
    """How far the built splits share rows (language and id) and final texts."""
    return sampling.split_overlap(
        dataset.select(
            "split", F.concat_ws(":", "language", "id").alias("id"), text_key(F.col("input")).alias("key")
        )
    )
