"""Token counts by the whole-token shortcut.

Before any text is read, every string of the vocabulary is put to a proof: it is one pre-token, and
the merges turn it into one token. In a text such a string as a pre-token counts one without any
merge, because merging sees a pre-token alone. All other pre-tokens are merged by the library.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanset.llm.pretokens import Known, PreTokens, byte_alphabet, load
from gleanset.llm.rows import parts


def whole_tokens(vocabulary: str) -> list[str]:
    """Vocabulary strings (as a normalised text has them) that are proven to encode as one token.

    Bounded by the vocabulary. Strings that are cut, or that normalisation changes, are left out.
    """
    library = load(vocabulary)
    to_byte = {c: b for b, c in byte_alphabet().items()}
    suffix = getattr(library.model, "end_of_word_suffix", None) or ""
    proven = []
    for entry in library.get_vocab(with_added_tokens=False):
        piece = entry.removesuffix(suffix) if suffix else entry
        if not piece or (suffix and piece == entry) or any(c not in to_byte for c in piece):
            continue
        try:
            text = bytes(to_byte[c] for c in piece).decode()
        except UnicodeDecodeError:
            continue
        if library.normalizer is not None and library.normalizer.normalize_str(text) != text:
            continue
        pieces = library.pre_tokenizer.pre_tokenize_str(text)
        if len(pieces) == 1 and len(library.model.tokenize(pieces[0][0])) == 1:
            proven.append(text)
    return sorted(proven)


class Counter(PreTokens):
    """Counts tokens; ``proven`` are the strings of :func:`whole_tokens`."""

    def __init__(self, vocabulary: str, proven: list[str]):
        super().__init__(vocabulary)
        self.counts = Known(lambda word: len(self.merge(word)), dict.fromkeys(proven, 1))

    def count(self, texts: list[str]) -> list[int]:
        return [sum(map(self._section, self.sections(t))) for t in texts]

    def _section(self, section: str | int) -> int:
        if isinstance(section, int):
            return 1
        words = self.latin(section)
        if words is None:
            normal = self.library.normalizer
            plain = normal.normalize_str(section) if normal is not None else section
            # Pieces come in the byte alphabet; a proven string is found by what it stands for.
            pieces = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]
            words = [bytes(map(self.byte_of.__getitem__, p)).decode(errors="surrogateescape") for p in pieces]
            return sum(1 if w in self.counts.start else len(self.tokenize(p)) for w, p in zip(words, pieces))
        return sum(map(self.counts.__getitem__, words))

    @cached_property
    def byte_of(self) -> dict[str, int]:
        return {c: b for b, c in self.alphabet.items()}


def count_tokens(
    docs: DataFrame,
    vocabulary: str = "word_bpe_49k.json",
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    A null or empty text has 0 bytes and 0 tokens. Rows are independent: repeated rows and ids come
    back as often as they came, a null id stays null, an empty table gives an empty result, and other
    columns, whatever their names, are not read. No shuffle; what is broadcast is bounded by the
    vocabulary.
    """
    proven = docs.sparkSession.sparkContext.broadcast(whole_tokens(vocabulary))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or Counter(vocabulary, proven.value)
            texts = batch.column(1).to_pylist()
            n = [k for a, b in parts(texts) for k in counter.count(texts[a:b])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"]
            )

    schema = T.StructType(
        [rows.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )
    counted = rows.mapInArrow(count, schema)
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
