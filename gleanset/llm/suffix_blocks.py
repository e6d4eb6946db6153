"""Repeated windows of a text, by blockwise suffix sorting with a difference cover.

Suffixes are sorted up to ``length`` bytes, one bucket of them at a time, so that memory is for the text,
the cover sample and one bucket. The sample holds the positions whose remainder by ``PERIOD`` is in
``COVER``; for any two positions there is a shift below ``PERIOD`` that takes both into the sample. Its
ranks are worked out once, by doubling. Suffixes of a bucket are then sorted by their first ``PERIOD``
bytes, and a longer tie is settled by the ranks of the two shifted positions, whatever its length.
"""

from __future__ import annotations

import numpy as np

# fixed values: a least difference cover
PERIOD, COVER = 32, (0, 1, 2, 3, 7, 11, 19)
#: Suffixes of a bucket, about.
BUCKET = 1 << 18
WORD = 8
WORDS = PERIOD // WORD


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For two remainders the least shift into the cover, and the number of a remainder in the cover."""
    number = np.full(PERIOD, -1, np.int64)
    number[list(COVER)] = np.arange(len(COVER))
    shift = np.full((PERIOD, PERIOD), -1, np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            shift[a, b] = next(d for d in range(PERIOD) if min(number[(a + d) % PERIOD], number[(b + d) % PERIOD]) >= 0)
    return shift, number


SHIFT, NUMBER = _tables()


def least_length() -> int:
    """The shortest ``length`` that one rank and both ends cover."""
    return 2 * PERIOD - 1


class Sorter:
    def __init__(self, text: np.ndarray, length: int):
        """``text`` holds bytes; windows of ``length`` bytes will be asked for that lie inside it."""
        if length < least_length():
            raise ValueError(f"length is {least_length()} or more")
        self.length = length
        self.depth = PERIOD
        while 2 * self.depth <= length - PERIOD + 1:
            self.depth *= 2
        padded = np.concatenate([text, np.zeros(2 * PERIOD, np.uint8)])
        # The eight bytes at every position, as one number that sorts as they do.
        self.word = np.ndarray((len(padded) - WORD + 1,), ">u8", padded, strides=(1,))
        self.names = self._sample_ranks(len(text))

    def _words(self, at: np.ndarray, k: int) -> np.ndarray:
        return self.word[at + k * WORD].astype(np.uint64)

    def _sorted(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of positions by the ``PERIOD`` bytes there, and where they differ from the one before."""
        keys = [self._words(at, k) for k in range(WORDS)]
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(at), bool)
        new[:1] = True
        for key in keys:
            key = key[order]
            new[1:] |= key[1:] != key[:-1]
        return order, new

    def _sample_ranks(self, n: int) -> np.ndarray:
        """Ranks of the sample by ``depth`` bytes; equal bytes, equal ranks. A sampled position is
        ``PERIOD * i + COVER[j]`` and has number ``len(COVER) * i + j``."""
        rows = -(-n // PERIOD)
        at = (np.arange(rows)[:, None] * PERIOD + np.array(COVER)).ravel()
        order, new = self._sorted(at)
        names = np.empty(len(at), np.int64)
        names[order] = np.cumsum(new)
        reach = PERIOD
        while reach < self.depth:
            step = reach // PERIOD * len(COVER)
            beyond = np.concatenate([names[step:], np.zeros(min(step, len(names)), np.int64)])
            both = names * (len(names) + 1) + beyond
            order = np.argsort(both, kind="stable")
            both = both[order]
            new = np.concatenate([[True], both[1:] != both[:-1]])[: len(both)]
            names[order] = np.cumsum(new)
            reach *= 2
        return names.astype(np.int32)

    def _rank(self, at: np.ndarray) -> np.ndarray:
        return self.names[at // PERIOD * len(COVER) + NUMBER[at % PERIOD]]

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair of windows whose first ``PERIOD`` bytes are the same."""
        shift = SHIFT[a % PERIOD, b % PERIOD]
        last = (self.length - shift - self.depth) // PERIOD * PERIOD
        steps = [np.full(len(a), k) for k in range(0, self.length - PERIOD - self.depth + 2, self.depth)] + [last]
        sign = np.zeros(len(a), np.int8)
        for step in steps:
            left, right = self._rank(a + shift + step), self._rank(b + shift + step)
            sign = np.where(sign == 0, np.sign(left - right), sign)
        # The sample may leave up to PERIOD bytes at the end.
        open_ = np.flatnonzero(sign == 0)
        end = self.length - PERIOD
        for k in range(WORDS):
            if not len(open_):
                break
            left, right = self._words(a[open_] + end, k), self._words(b[open_] + end, k)
            sign[open_] = (left > right).astype(np.int8) - (left < right)
            open_ = open_[left == right]
        return sign

    def repeated(self, at: np.ndarray, bucket: int = BUCKET) -> np.ndarray:
        """For each of the positions, all different, whether the window there is that at another one."""
        marks = np.zeros(len(at), bool)
        first = self._words(at, 0)
        count = -(-len(at) // bucket)
        if count <= 1:
            own = [np.arange(len(at))]
        else:
            splitters = np.sort(first[:: max(1, len(first) // (count * 64))])
            splitters = np.unique(splitters[:: max(1, len(splitters) // count)])
            of = np.searchsorted(splitters, first, "right")
            order = np.argsort(of, kind="stable")
            own = np.split(order, np.cumsum(np.bincount(of, minlength=len(splitters) + 1))[:-1])
        for members in own:
            if len(members) > 1:
                self._bucket(at, members, marks)
        return marks

    def _bucket(self, at: np.ndarray, members: np.ndarray, marks: np.ndarray) -> None:
        order, new = self._sorted(at[members])
        members, group = members[order], np.cumsum(new)
        rng = np.random.default_rng(len(members))
        # Ties are parted around a pivot of each, all of them at once, until all are settled.
        while True:
            edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else group
            size = np.diff(np.append(edge, len(group)))
            keep = np.repeat(size > 1, size)
            if not keep.any():
                return
            members, size = members[keep], size[size > 1]
            edge = np.concatenate([[0], np.cumsum(size)[:-1]])
            pivot = members[edge + rng.integers(0, size)]
            sign = self.compare(at[members], at[np.repeat(pivot, size)])
            same = sign == 0
            marks[members[same & np.repeat(np.add.reduceat(same.astype(np.int64), edge) > 1, size)]] = True
            group = (np.repeat(np.arange(len(size)), size) * 2 + (sign > 0))[~same]
            members = members[~same]
            order = np.argsort(group, kind="stable")
            members, group = members[order], group[order]
