"""Fill-in-middle transformation with a sparse exception index.

A text is cut twice and written with its middle last, so that a model learns to fill gaps. Cuts are
chosen in units (tokens or code points) and made in bytes. Text that is ASCII needs no table for that: a
code point is a byte. Only multibyte characters are exceptions, so only they are recorded, by position
and by how many bytes they have beyond one; ``searchsorted`` over them turns a code-point cut into a
byte cut and back, and what lies between two exceptions is plain arithmetic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanset.llm.rows import parts

# fixed values: markers of the parts, and the forms of an output
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bytes looked at at a time; what is kept of a slice are its exceptions and a count.
SLICE = 1 << 22


@dataclass(frozen=True)
class Exceptions:
    """The multibyte characters of a text: their code-point positions, and the excess bytes of all
    characters up to and including each of them."""

    at: np.ndarray
    excess: np.ndarray

    @classmethod
    def of(cls, text: np.ndarray) -> Exceptions:
        """``text`` is UTF-8 as an array of bytes."""
        places, extra = [], []
        for start in range(0, len(text), SLICE):
            part = text[start : start + SLICE]
            lead = np.flatnonzero(part >= 0xC0)
            if len(lead):
                first = part[lead]
                places.append(lead + start)
                extra.append(1 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0))
        if not places:
            return cls(np.zeros(0, np.int64), np.zeros(0, np.int64))
        extra = np.concatenate(extra)
        excess = np.cumsum(extra)
        # A character's code point is its byte less the excess of those before it.
        return cls(np.concatenate(places) - (excess - extra), excess)

    def _before(self, index: int) -> int:
        return int(self.excess[index - 1]) if index else 0

    def to_byte(self, point: int) -> int:
        """The byte at which code point ``point`` begins."""
        return point + self._before(int(np.searchsorted(self.at, point, "left")))

    def to_point(self, byte: int) -> int:
        """The code point that begins at ``byte``."""
        # Where the exceptions begin in bytes grows with them, so it can be searched as well.
        starts = _Starts(self)
        low, high = 0, len(self.at)
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if starts[middle] < byte else (low, middle)
        return byte - self._before(low)

    def total(self, n_bytes: int) -> int:
        """Code points of a text of ``n_bytes``."""
        return n_bytes - self._before(len(self.at))


class _Starts:
    """The byte at which each exception begins, worked out when asked for."""

    def __init__(self, index: Exceptions):
        self.index = index

    def __getitem__(self, i: int) -> int:
        return int(self.index.at[i]) + self.index._before(i)


def _is_space(text: np.ndarray) -> np.ndarray:
    return (text == 0x20) | ((text >= 0x09) & (text <= 0x0D))


def _token_ends(part: np.ndarray, following: int | None) -> np.ndarray:
    """Where tokens end inside a slice: after each run of other than white space. ``following`` is the
    byte after the slice (None: the text ends)."""
    space = _is_space(part)
    after = np.append(space[1:], True if following is None else bool(_is_space(np.array([following]))[0]))
    return np.flatnonzero(~space & after) + 1


class Tokens:
    """The cuts of a text at its tokens: a run of other than white space with the white space before it;
    white space at the end is a token of its own. Only the number of tokens of each slice is kept."""

    def __init__(self, text: np.ndarray):
        self.text, self.counts = text, []
        for start in range(0, len(text), SLICE):
            self.counts.append(len(self._ends(start)))
        self.trailing = bool(len(text)) and bool(_is_space(text[-1:])[0])
        self.n = sum(self.counts) + self.trailing

    def _ends(self, start: int) -> np.ndarray:
        stop = min(start + SLICE, len(self.text))
        return _token_ends(self.text[start:stop], int(self.text[stop]) if stop < len(self.text) else None)

    def cut(self, k: int) -> int:
        """The byte after the first ``k`` tokens."""
        if k == 0:
            return 0
        if k == self.n:
            return len(self.text)
        for i, count in enumerate(self.counts):
            if k <= count:
                return i * SLICE + int(self._ends(i * SLICE)[k - 1])
            k -= count
        raise IndexError(k)


def draws(key, seed: int) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 for a document, from its key alone (a null key: an empty string)."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4))


def transform(text: bytes, key, unit: str, seed: int, rate: int, spm_rate: int):
    """Output, form, units, and the code points of prefix and middle (None where the form is plain)."""
    data = np.frombuffer(text, np.uint8)
    h1, h2, h3, h4 = draws(key, seed)
    index = None
    if unit == "token":
        tokens = Tokens(data)
        n, cut = tokens.n, tokens.cut
    else:
        index = Exceptions.of(data)
        n, cut = index.total(len(data)), index.to_byte
    if not text or h3 % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return text, PLAIN, n, None, None
    index = index or Exceptions.of(data)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = cut(a), cut(b)
    view = memoryview(text)
    prefix, middle, suffix = view[:a], view[a:b], view[b:]
    form = SPM if h4 % 100 < spm_rate else PSM
    if form == SPM:
        out = b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    else:
        out = b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    first = index.to_point(a)
    return out, form, n, first, index.to_point(b) - first


def fill_in_middle(
    docs: DataFrame,
    unit: str = "token",
    rate: int = 50,
    spm_rate: int = 80,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, ``n`` (units of the text), ``form``, ``prefix_chars`` and
    ``middle_chars`` (code points; null where the form is plain) and ``output``.

    ``rate`` of 100 documents are transformed, ``spm_rate`` of 100 of those with their suffix first; a
    document's draws depend on ``seed`` and its id only. ``unit`` is ``token`` or ``char``. Plain, that
    is unchanged, are an empty or null text (``n`` is 0) and a text that holds a marker. A null id draws
    like an empty one; repeated ids draw alike, repeated rows come back as often as they came; an empty
    table gives no rows; other columns are not read. A text is handled whole, in slices, with memory for
    the text, its output and its multibyte characters. No shuffle.
    """
    if unit not in ("token", "char"):
        raise ValueError(f"unit is token or char, not {unit!r}")
    rows = docs.select(
        F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text")
    )
    schema = T.StructType(
        [T.StructField("id", rows.schema["id"].dataType), T.StructField("n", T.LongType())]
        + [T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType())]
        + [T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            sizes = [t.as_buffer().size for t in texts]
            for start, stop in parts(sizes, sizes):
                keys = batch.column(0).slice(start, stop - start)
                made = [
                    transform(t.as_buffer().to_pybytes(), k, unit, seed, rate, spm_rate)
                    for t, k in zip(texts.slice(start, stop - start), keys.to_pylist())
                ]
                out, form, n, first, middle = (list(c) for c in zip(*made))
                yield pa.RecordBatch.from_arrays(
                    [
                        keys, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(first, pa.int64()),
                        pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string()),
                    ],
                    schema.names,
                )

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from, by its form. A text that is transformed holds no marker,
    and a cut text cannot form one with a marker's edge, so each marker is found at its one place."""
    p, s, m = (x.decode() for x in (PREFIX, SUFFIX, MIDDLE))

    def between(text: Column, left: str, right: str) -> Column:
        return F.substring_index(F.substring_index(text, left, -1), right, 1)

    middle = F.substring_index(output, m, -1)
    return (
        F.when(form == PSM, F.concat(between(output, p, s), middle, between(output, s, m)))
        .when(form == SPM, F.concat(between(output, p, m), middle, between(output, s, p)))
        .otherwise(output)
    )
