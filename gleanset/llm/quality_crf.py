"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's potential is a weighted sum of what its characters and
words look like and of the same features of the lines before and after it; neighbouring labels have a
potential of their own. The forward-backward pass gives each line's marginal probability of being good,
and the mean of these, weighted by line length, is the document's. It is trained by maximum likelihood
on documents whose label every line takes, and the document score is calibrated on the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanset.functions.keys import free_name
from gleanset.llm.rows import parts, stored

#: Training documents, lines of one of them, and lines of all of them at most (about 1 KB each on the driver); a
#: document of more lines is not trained on, and the last documents in the order of the hash give way.
TRAIN_DOCS, TRAIN_LINES, TRAIN_TOTAL = 4000, 2000, 300_000
#: Folds of documents by crc32 of the id, and the one that is never trained on.
FOLDS, HELD_OUT = 4, 2
#: Lines of padded sequences that are passed over at a time, and lines that are expanded at a time.
PADDED, EXPANDED = 100_000, 50_000
#: A document of more lines is passed over in blocks, all of them side by side.
LONG_LINES = 4096
#: Characters of a text that are measured at a time.
PIECE = 1_000_000
#: The features that say how often a line occurs in its document, and those that grow with a line.
TIMES, GROWING, LONGEST = (20, 21), (8, 9, 15), 12

# Upper, lower, digit, space, punctuation, symbol, beyond ASCII, line feed.
CLASSES = np.full(256, 5, np.uint8)
CLASSES[65:91], CLASSES[97:123], CLASSES[48:58], CLASSES[128:] = 0, 1, 2, 6
CLASSES[[9, 11, 12, 13, 32]] = 3
CLASSES[[ord(c) for c in ".,;:'\"?()-"]] = 4
CLASSES[10] = 7
N_FEATURES = 23
with np.errstate(over="ignore"):
    POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))


def _mixed(x: np.ndarray, salt: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x + salt.astype(np.uint64)) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def features_of(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text a row of features per line, and the lines' lengths in characters (1 at least).

    All lines of all texts are measured together, those of a long text piece by piece.
    """
    short = [i for i, t in enumerate(texts) if len(t) <= PIECE]
    made: list = [None] * len(texts)
    if short:
        out, length, whole, lines_of = _measured([texts[i] for i in short])
        _add_times(out, whole, np.repeat(np.arange(len(short)), lines_of), length)
        for i, b, n in zip(short, np.cumsum(lines_of), lines_of):
            made[i] = (out[b - n : b], length[b - n : b].astype(np.float64))
    for i, text in enumerate(texts):
        if made[i] is None:
            out, length, whole = (np.concatenate(c) for c in zip(*_pieces(text)))
            _add_times(out, whole, np.zeros(len(out), np.int64), length)
            made[i] = (out, length.astype(np.float64))
    return made


def _pieces(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A long text's lines, measured some at a time; a line that is longer than a piece by itself."""
    at = 0
    while at <= len(text):
        end = len(text) if len(text) - at <= PIECE else text.rfind("\n", at, at + PIECE)
        if end < 0:
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            yield _long_line(text[at:end])
        else:
            yield _measured([text[at:end]])[:3]
        at = end + 1


def _long_line(line: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A very long line, in parts cut at a space where there is one: counts are added up, shares and means are
    those of the parts, weighted by their length."""
    at, rows, lengths, whole = 0, [], [], np.zeros(1, np.uint64)
    while at < len(line):
        end = min(at + PIECE, len(line))
        if end < len(line) and (space := line.rfind(" ", at + 1, end)) > 0:
            end = space
        row, length, own, _ = _measured([line[at:end]])
        rows.append(row[0])
        lengths.append(length[0])
        whole = _mixed(whole, own)
        at = end
    rows, lengths = np.array(rows), np.array(lengths)
    out = np.average(rows, axis=0, weights=lengths)
    out[list(GROWING)] = np.log1p(np.expm1(rows[:, GROWING].astype(float)).sum(axis=0))
    out[LONGEST] = rows[:, LONGEST].max()
    return out[None].astype(np.float32), np.array([lengths.sum()]), whole


def _add_times(out: np.ndarray, whole: np.ndarray, doc: np.ndarray, length: np.ndarray) -> None:
    """How often each line occurs in its document; an empty one does not count."""
    _, at, copies = np.unique(_mixed(whole, doc), return_inverse=True, return_counts=True)
    times = np.where(out[:, 0] == 0, copies[at], 0)
    out[:, TIMES[0]], out[:, TIMES[1]] = times > 1, np.log1p(times)


def _measured(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of the texts but for their times, lengths, hashes, and the lines of each text."""
    data = np.frombuffer("\n".join(texts).encode(), np.uint8)
    kind = CLASSES[data]
    breaks = np.flatnonzero(kind == 7)
    start, stop = np.concatenate([[0], breaks + 1]), np.append(breaks, len(data))
    n_lines, size = len(start), stop - start
    line = np.repeat(np.arange(n_lines), size + 1)[:-1]
    share = np.maximum(size, 1)[:, None]
    kinds = np.bincount(line * 8 + kind, minlength=8 * n_lines).reshape(-1, 8)[:, :7] / share
    chars = size - np.bincount(line, (data & 0xC0) == 0x80, n_lines).astype(np.int64)

    blank = (kind == 3) | (kind == 7)
    edge = np.diff(np.concatenate([[1], blank.astype(np.int8), [1]]))
    first, after = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    of, width = line[first], after - first
    n_words = np.bincount(of, minlength=n_lines)
    per = np.maximum(1, n_words)

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(of, values, n_lines) / per

    with np.errstate(over="ignore"):
        value = data.astype(np.uint64) + np.uint64(1)
        place = np.arange(len(data)) - np.repeat(start, size + 1)[:-1]
        whole = np.zeros(n_lines, np.uint64)
        if len(data):
            full = size > 0
            whole[full] = np.add.reduceat(np.where(kind == 7, np.uint64(0), value * POWERS[place & 4095]), start[full])
        word = np.zeros(0, np.uint64)
        if len(first):
            begun = np.repeat(np.append(0, first), np.diff(np.concatenate([[0], first, [len(data)]])))
            inside = value * POWERS[(np.arange(len(data)) - begun) & 4095]
            word = np.add.reduceat(np.where(blank, np.uint64(0), inside), first)
        pair = _mixed(word[:-1], word[1:])

    def different(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        _, at = np.unique(_mixed(hashes, owner), return_index=True)
        return np.bincount(owner[at], minlength=n_lines)

    lines_of = np.array([t.count("\n") + 1 for t in texts])
    longest = np.zeros(n_lines)
    if len(first):
        begins = np.flatnonzero(np.diff(of, prepend=-1))
        longest[of[begins]] = np.maximum.reduceat(width, begins)
    kept = of[1:] == of[:-1]
    words, pairs = different(word, of), different(pair[kept], of[1:][kept])
    average = mean(width)
    tail = kind[after - 1]
    out = np.stack(
        [
            size == 0,
            *kinds.T,
            np.log1p(chars),
            np.log1p(n_words),
            average,
            np.sqrt(np.maximum(0, mean(width * width.astype(float)) - average**2)),
            longest,
            words / per,
            pairs / np.maximum(1, n_words - 1),
            np.log1p(words),
            mean(width <= 3),
            mean(width == 1),
            mean(kind[first] == 0),
            mean((tail == 4) | (tail == 5)),
            np.zeros(n_lines),
            np.zeros(n_lines),
            (kinds > 0).sum(axis=1),
        ],
        axis=1,
    ).astype(np.float32)
    return out, np.maximum(1, chars), whole, lines_of


@dataclass
class LineCrf:
    """Two states, 0 bad and 1 good. ``knots`` bend each feature; ``weights`` score good against bad."""

    mean: np.ndarray
    spread: np.ndarray
    knots: np.ndarray
    weights: np.ndarray
    step: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)

    def expand(self, lines: np.ndarray) -> np.ndarray:
        """Own features, bent at the knots, and the neighbours' (zero beyond the first and last line)."""
        x = np.clip((lines - self.mean) / self.spread, -4, 4)
        bent = [np.maximum(0, x - k) for k in self.knots]
        none = np.zeros((1, x.shape[1]), x.dtype)
        before, after = np.concatenate([none, x[:-1]]), np.concatenate([x[1:], none])
        return np.concatenate([np.ones((len(x), 1), x.dtype), x, *bent, before, after], axis=1)

    def marginals(self, unary: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Padded documents x lines of potentials for good: marginal of good, expected count of each
        pair of neighbouring labels, and the log of the normaliser, for sequences of ``n`` lines."""
        docs, longest = unary.shape
        score = np.stack([np.zeros_like(unary), unary], axis=2)
        forward = np.zeros((docs, longest, 2))
        forward[:, 0] = score[:, 0]
        for t in range(1, longest):
            reach = _logsum(forward[:, t - 1, :, None] + self.step[None], 1)
            forward[:, t] = np.where((t < n)[:, None], reach + score[:, t], forward[:, t - 1])
        total = _logsum(forward[:, -1], 1)
        backward = np.zeros((docs, longest, 2))
        pairs = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            live = (t + 1 < n)[:, None]
            ahead = score[:, t + 1] + backward[:, t + 1]
            backward[:, t] = np.where(live, _logsum(self.step[None] + ahead[:, None, :], 2), 0)
            joint = forward[:, t, :, None] + self.step[None] + ahead[:, None, :] - total[:, None, None]
            pairs += np.where(live[:, :, None], np.exp(np.minimum(joint, 0)), 0).sum(axis=0)
        return np.exp(np.minimum(0, forward[..., 1] + backward[..., 1] - total[:, None])), pairs, total

    def unary(self, lines: np.ndarray) -> np.ndarray:
        """The potential for good of every line of a document, some lines at a time."""
        out = np.zeros(len(lines))
        for a in range(0, len(lines), EXPANDED):
            low, high = max(0, a - 1), min(len(lines), a + EXPANDED + 1)
            some = self.expand(lines[low:high]) @ self.weights
            out[a : a + EXPANDED] = some[a - low : a - low + EXPANDED]
        return out

    def long_marginals(self, unary: np.ndarray) -> np.ndarray:
        """The marginal of good for every line of one long document.

        The chain is cut into blocks. The steps inside all blocks are multiplied up side by side, as 2 x 2
        products forward and backward; then one pass over the blocks joins them.
        """
        n, never = len(unary), -1e30
        width = int(np.ceil(np.sqrt(n)))
        blocks = -(-n // width)
        same = np.array([[0.0, never], [never, 0.0]])
        links = np.broadcast_to(same, (blocks * width, 2, 2)).copy()
        links[:n] = self.step
        links[:n, :, 1] += unary[:, None]
        links[0] = [[0.0, unary[0]], [never, never]]  # nothing comes before the first line
        links = links.reshape(blocks, width, 2, 2)

        def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return _logsum(a[..., :, :, None] + b[..., None, :, :], -2)

        ahead, behind = np.empty_like(links), np.empty_like(links)
        ahead[:, 0], behind[:, -1] = links[:, 0], same
        for t in range(1, width):
            ahead[:, t] = product(ahead[:, t - 1], links[:, t])
            behind[:, -t - 1] = product(links[:, -t], behind[:, -t])
        start, stop = np.zeros((blocks, 2)), np.zeros((blocks, 2))
        start[0] = [0.0, never]
        for b in range(1, blocks):
            start[b] = _logsum(start[b - 1][:, None] + ahead[b - 1, -1], 0)
        for b in range(blocks - 2, -1, -1):
            stop[b] = _logsum(ahead[b + 1, -1] + stop[b + 1][None], 1)
        forward = _logsum(start[:, None, :, None] + ahead, 2)
        both = forward + _logsum(behind + stop[:, None, None, :], 3)
        good = np.exp(np.minimum(0, both[..., 1] - _logsum(both, 2)))
        return good.reshape(-1)[:n]

    def document_means(self, documents: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Length-weighted mean marginal of each document's lines."""
        out = np.zeros(len(documents))
        counts = np.array([len(d[0]) for d in documents], np.int64)
        order = np.argsort(counts, kind="stable")
        start = 0
        while len(order) and counts[order[-1]] > LONG_LINES:
            i, order = order[-1], order[:-1]
            out[i] = np.average(self.long_marginals(self.unary(documents[i][0])), weights=documents[i][1])
        while start < len(order):
            stop = start + 1
            while stop < len(order) and (stop + 1 - start) * counts[order[stop]] <= PADDED:
                stop += 1
            some = order[start:stop]
            n = counts[some]
            unary = np.zeros((len(some), n[-1]))
            for row, i in zip(unary, some):
                row[: counts[i]] = self.unary(documents[i][0])
            good = self.marginals(unary, n)[0]
            for p, i in zip(good, some):
                out[i] = np.average(p[: counts[i]], weights=documents[i][1])
            start = stop
        return out

    def scores(self, documents: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        means = self.document_means(documents)
        return _sigmoid(self.scale[0] * _logit(means) + self.scale[1])


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(documents: list[np.ndarray], lengths: list[np.ndarray], labels: np.ndarray, rounds: int = 100) -> LineCrf:
    """Maximum likelihood by Adam over all documents at once; the same input gives the same model."""
    lines = np.concatenate(documents)
    mean, spread = lines.mean(axis=0), lines.std(axis=0) + 1e-3
    model = LineCrf(mean, spread, np.array([-1.0, 0.0, 1.0, 2.0], np.float32), np.zeros(0), np.zeros((2, 2)))
    order = np.argsort([len(d) for d in documents], kind="stable")
    groups = []
    for some in np.array_split(order, min(len(order), 12)):
        n = np.array([len(documents[i]) for i in some])
        mask = np.arange(n.max())[None] < n[:, None]
        x = np.zeros((*mask.shape, len(model.expand(documents[0])[0])), np.float32)
        for at, i in enumerate(some):
            x[at, : n[at]] = model.expand(documents[i])
        groups.append((x, n, mask, labels[some]))
    size = groups[0][0].shape[2]
    theta, m, v = np.zeros(size + 4), np.zeros(size + 4), np.zeros(size + 4)
    for k in range(1, rounds + 1):
        grad = -0.3 * theta
        grad[0] = 0
        model.weights, model.step = theta[:size], theta[size:].reshape(2, 2)
        for x, n, mask, y in groups:
            good, pairs, _ = model.marginals((x @ model.weights.astype(np.float32)).astype(float), n)
            grad[:size] += np.einsum("dtf,dt->f", x, (mask * (y[:, None] - good)).astype(np.float32))
            seen = np.zeros((2, 2))
            for label in (0, 1):
                seen[label, label] = (n[y == label] - 1).sum()
            grad[size:] += (seen - pairs).ravel()
        grad /= len(lines)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    model.weights, model.step = theta[:size], theta[size:].reshape(2, 2)
    x = _logit(model.document_means(list(zip(documents, lengths))))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * x + b)
        w = p * (1 - p)
        hess = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        da, db = np.linalg.solve(hess, np.array([((labels - p) * x).sum() - (a - 1), (labels - p).sum()]))
        a, b = a + np.clip(da, -1, 1), b + np.clip(db, -1, 1)
    model.scale = (float(a), float(b))
    return model


def held_out(id_col: str = "doc_id"):
    """Whether a row's id falls in the fold that is never trained on; a null id does not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    train_docs: int = TRAIN_DOCS,
    train_lines: int = TRAIN_LINES,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    train_total: int = TRAIN_TOTAL,
) -> LineCrf | float:
    """A model from at most ``train_docs`` labelled documents outside the held-out fold, the first in
    the order of the id's hash, of fewer than ``train_lines`` lines each and ``train_total`` together.

    Without two classes among them: the share of good ones (0.5 if none). A label or id that is null is
    left out; an id with several labels has the largest; rows of a repeated id are documents of their own.
    The features are written to the shared folder, and only the chosen documents' come to the driver.
    """
    chosen = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label_col).alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(train_docs)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    texts = texts.join(F.broadcast(chosen), "_id").filter(
        F.length("_text") - F.length(F.replace("_text", F.lit("\n"))) < train_lines
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_ = batch.column(1).to_pylist()
            made = [m for a, b in parts(texts_) for m in features_of(texts_[a:b])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(n) for _, n in made], pa.int64())]
                + [pa.array([f.tobytes() for f, _ in made], pa.binary())]
                + [pa.array([n.tobytes() for _, n in made], pa.binary())],
                ["_id", "_label", "_n", "_lines", "_lengths"],
            )

    schema = T.StructType(
        [texts.schema["_id"], T.StructField("_label", texts.schema["_label"].dataType)]
        + [T.StructField("_n", T.LongType()), T.StructField("_lines", T.BinaryType()), T.StructField("_lengths", T.BinaryType())]
    )
    # Repeated ids could be many rows: the order and limits hold for documents too.
    found = stored(texts.select("_id", "_text", "_label").mapInArrow(extract, schema), "training-lines")
    place = [F.xxhash64("_id").alias("_at"), "_id", F.xxhash64("_lines").alias("_own")]
    sizes = found.select(*place, "_n").orderBy("_at", "_id", "_own").limit(train_docs).collect()
    taken = int(np.searchsorted(np.cumsum([r["_n"] for r in sizes]), train_total, "right"))
    if not taken:
        return 0.5
    upto = found.select("*", *place[::2]).filter(F.col("_at") <= sizes[taken - 1]["_at"])
    sample = upto.orderBy("_at", "_id", "_own").limit(taken).collect()
    y = np.array([float(r["_label"]) for r in sample])
    if len(set(y)) < 2:
        return float(y.mean())
    features = [np.frombuffer(r["_lines"], np.float32).reshape(-1, N_FEATURES) for r in sample]
    return fit(features, [np.frombuffer(r["_lengths"], np.float64) for r in sample], y)


def with_scores(docs: DataFrame, model: LineCrf | float, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1, by the text alone: higher means label 1 is likelier.

    A null text counts as empty; an empty text is one empty line. Rows are independent, so repeated
    rows score alike; an empty table stays empty; every other column is passed through, and one that is
    called like the score is replaced. A text may be as long as a string can be: it is measured in pieces of
    :data:`PIECE` characters, and needs memory for a row of features a line.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(score_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(score_col, T.DoubleType())])
    at = kept.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            if isinstance(shared.value, float):
                scores = np.full(len(texts), shared.value)
            else:
                made = [shared.value.scores(features_of(texts[a:b])) for a, b in parts(texts)]
                scores = np.concatenate(made) if made else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], schema.names)

    return kept.mapInArrow(score, schema)


def drop_low_quality(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, text_col: str = "text", **train_options
) -> DataFrame:
    """``docs`` that score ``threshold`` or more, by :func:`train` and :func:`with_scores`.

    A null text is judged as an empty one; repeated rows stay or go alike; an empty table stays empty. All
    columns come back as they are, whatever they are called.
    """
    score = free_name(docs, "_quality")
    scored = with_scores(docs, train(docs, labels, text_col=text_col, **train_options), text_col, score)
    return scored.filter(F.col(score) >= threshold).drop(score)
