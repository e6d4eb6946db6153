"""Token ids of the ``tokenizers`` library, one merge per different pre-token.

A byte-pair tokenizer splits a text into pre-tokens and merges each by itself, so the ids of a text
are the ids of its pre-tokens in order. Most pre-tokens of a corpus repeat. Here a text of Latin-1
characters is split by ``re`` with the tokenizer's own pattern spelled out for those 256 characters,
known pre-tokens come from a table, and only new ones go through the library. Any other text goes
through the library as a whole. Strings of added tokens are cut out first, as the library does.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: The classes of the two split patterns within Latin-1, and the patterns themselves.
LETTER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"
SUFFIX = "'s|'t|'re|'ve|'m|'ll|'d"
WORD_SPLIT = f"{SUFFIX}|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+"
BYTE_SPLIT = (
    f"{SUFFIX}| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)

#: Known pre-tokens are forgotten when there are more, so that a worker's memory stays bounded.
KNOWN = 600_000


def tokenizer_path(name: str) -> str:
    """A file as it is, or the installed public file of that name (resolved where the task runs)."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def load(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones are
    themselves, the others follow 255 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(moved)}}


class PreTokens:
    """Splits texts as a word-level (``WORD_SPLIT``, lower case) or byte-level tokenizer does."""

    def __init__(self, name: str):
        self.library = load(name)
        added = self.library.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.cut = re.compile("|".join(f"({re.escape(s)})" for s in self.special) or "(?!)")
        self.lower = self.library.normalizer is not None
        self.split = re.compile(WORD_SPLIT if self.lower else BYTE_SPLIT).findall
        self.alphabet = byte_alphabet()
        self.tokenize = self.library.model.tokenize

    def sections(self, text: str):
        """The text between added tokens, and the added tokens' ids in place."""
        if not any(s in text for s in self.special):
            yield text
            return
        at = 0
        for match in self.cut.finditer(text):
            if match.start() > at:
                yield text[at : match.start()]
            yield self.special[match.group()]
            at = match.end()
        if at < len(text):
            yield text[at:]

    def latin(self, text: str) -> list[str] | None:
        """Pre-tokens of a Latin-1 text without added tokens, None for other text."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return self.split(text.lower() if self.lower else text)

    def merge(self, word: str) -> list:
        """The library's tokens of one pre-token."""
        if not (word.isascii() and word.isalnum()):
            word = word.encode().decode("latin-1").translate(self.alphabet)
        return self.tokenize(word)


class Known(dict):
    """A pre-token's value, worked out when it is first met and forgotten when there are too many."""

    def __init__(self, work, start: dict | None = None):
        super().__init__(start or {})
        self.work, self.start = work, start or {}

    def __missing__(self, word: str):
        if len(self) > KNOWN + len(self.start):
            self.clear()
            self.update(self.start)
        self[word] = value = self.work(word)
        return value


class IdEncoder(PreTokens):
    """Ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, name: str):
        super().__init__(name)
        size = self.library.get_vocab_size(with_added_tokens=True)
        coded = [i.to_bytes(4, "little") for i in range(size)]
        self.known = Known(lambda word: b"".join([coded[t.id] for t in self.merge(word)]))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [b"".join(map(self._section, self.sections(t))) for t in texts]

    def _section(self, section: str | int) -> bytes:
        if isinstance(section, int):
            return section.to_bytes(4, "little")
        words = self.latin(section)
        if words is None:
            return np.array(self.library.encode(section, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.known.__getitem__, words))
