"""Label expressions: mapping, cleaning, parsing and checking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanset import fixed
from gleanset.functions import text as tx


def map_terms(label: Column, terms: Mapping[str, Sequence[str]] = fixed.LABEL_TERMS) -> Column:
    """Fold source labels into the label set by exact match; anything else is null."""
    return F.coalesce(*[F.when(label.isin(list(sources)), F.lit(name)) for name, sources in terms.items()])


def map_codes(code: Column, codes: Mapping[int, str] = fixed.SENTIMENT_CODES) -> Column:
    """Look an integer code up; an unknown code is null."""
    entries = [F.lit(x) for pair in codes.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), code)


def map_topics(code: Column) -> Column:
    return map_codes(code, fixed.TOPIC_CODES)


def class_index(label: Column, classes: Sequence[str] = fixed.LABELS) -> Column:
    """Zero-based position in the class list, null for a label outside it."""
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), label)
    return F.when(position > 0, position - 1).cast("bigint")


def class_name(index: Column, classes: Sequence[str] = fixed.LABELS) -> Column:
    """Inverse of :func:`class_index`."""
    return F.get(F.array(*[F.lit(c) for c in classes]), index.cast("int"))


def in_label_set(label: Column, classes: Sequence[str] = fixed.LABELS) -> Column:
    return F.coalesce(label.isin(list(classes)), F.lit(False))


def clean_label(raw: Column) -> Column:
    """First word of an answer, lower-cased, without full stops and commas; null when blank."""
    word = tx.first_word(raw)
    return F.when(word != "", F.translate(F.lower(word), ".,", ""))


def _whole_word(word: str) -> str:
    return rf"(^|[^{tx.WORD}]){word}([^{tx.WORD}]|$)"


# fixed values: the order in which labels are looked for in an answer
PARSE_ORDER = ("positive", "negative", "neutral")


def parse_sentiment(raw: Column) -> Column:
    """Label named in a free-form answer, or ``unparseable``.

    Whole words win over substrings, and both are looked for in :data:`PARSE_ORDER`; last comes
    the first word with its punctuation taken out.
    """
    answer = tx.strip(F.lower(F.coalesce(raw, F.lit(""))))
    head = F.regexp_replace(tx.first_word(answer), rf"[^{tx.WORD}]", "")
    return F.coalesce(
        *[F.when(F.rlike(answer, F.lit(_whole_word(w))), F.lit(w)) for w in PARSE_ORDER],
        *[F.when(F.contains(answer, F.lit(w)), F.lit(w)) for w in PARSE_ORDER],
        F.when(head.isin(list(PARSE_ORDER)), head),
        F.lit(fixed.UNPARSEABLE),
    )


def is_correct(prediction: Column, truth: Column) -> Column:
    """Prediction equals truth; an unparseable answer never counts."""
    return F.coalesce((prediction == truth) & (prediction != fixed.UNPARSEABLE), F.lit(False))
