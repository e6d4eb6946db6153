"""Text expressions. Every function takes and returns a Column and stays in the JVM.

Whitespace and word characters are Unicode-wide: the classes below spell out what the
ASCII shorthands of the regex engine leave out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: character classes and removal patterns
SPACE = r"\s\p{Z}\x0b\x1c-\x1f\x85"
WORD = r"\p{L}\p{N}_"
URL = r"https?://[^\s\p{Z}\x0b\x1c-\x1f\x85]+"
HANDLE = r"@[\p{L}\p{N}_]+"
TICKER = r"\$[\p{L}\p{N}_]+"
ASCII_LETTER = r"[a-zA-Z]"


# fixed values: code points of SPACE
SPACE_POINTS = (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B))
SPACE_CHARS = "".join(map(chr, (*SPACE_POINTS, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(text: Column) -> Column:
    """Cut whitespace off both ends; looks at the edges only."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def has_markers(text: Column) -> Column:
    """Whether a URL, handle or ticker can be there: byte searches for what each of them must hold."""
    return F.contains(text, F.lit("@")) | F.contains(text, F.lit("$")) | F.contains(text, F.lit("://"))


def remove_markers(text: Column) -> Column:
    """Remove URLs, then handles, then tickers."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, URL, ""), HANDLE, ""), TICKER, "")


def clean_text(text: Column) -> Column:
    """Remove URLs, handles and tickers, then edge whitespace; null becomes empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return strip(F.when(has_markers(text), remove_markers(text)).otherwise(text))


def char_length(text: Column) -> Column:
    return F.length(text).cast("bigint")


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words; null stays null."""
    return F.regexp_count(text, F.lit(rf"[^{SPACE}]+")).cast("bigint")


def has_min_words(text: Column, n: int) -> Column:
    """``word_count(text) >= n``, decided as soon as the n-th word starts.

    Anchored and possessive: a text that is one endless word is read once, not from every position.
    """
    if n <= 0:
        return text.isNotNull()
    return F.rlike(text, F.lit(rf"^[{SPACE}]*+(?:[^{SPACE}]++[{SPACE}]++){{{n - 1}}}[^{SPACE}]"))


def has_ascii_letter(text: Column) -> Column:
    return F.rlike(text, F.lit(ASCII_LETTER))


def words_between(text: Column, low: int, high: int) -> Column:
    """Whether the word count lies in ``low..high``, both ends included."""
    return word_count(text).between(low, high)


def first_word(text: Column) -> Column:
    """First run of non-space characters, empty when there is none."""
    return F.regexp_extract(text, rf"[^{SPACE}]+", 0)


def alphabetic_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, as an array."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))
