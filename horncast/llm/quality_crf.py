"""Document quality by a linear-chain conditional random field over lines.

Every line is good (1) or bad (0).  A line's potential is linear in its own features and in those of the
line before and the line after; neighbouring labels have a potential of their own.  Forward-backward gives
each line's probability of being good; their mean, weighted by line length, is the document's raw quality,
and a logistic calibration (fitted on documents) makes it a score.

Labels are of documents, so lines are labelled in two steps: a line-by-line logistic model is fitted with
each document's label on all its lines; in bad documents, lines that this model finds good are relabelled
good, but for the worst line.  Then the field is fitted by gradient ascent on the conditional likelihood.

Fitting uses at most ``TRAIN_DOCS`` labelled documents (those with the least hash of their id; of rows that share
an id, one, always the same), each with all its lines; one that would bring the lines of all to more than
``TRAIN_LINES`` is passed over as a whole.  This bounds what reaches the driver.  Scoring covers every line of every
text, on executors, with the fitted weights broadcast.

Defined results: a null text, and one without a line that has a visible byte, has no line and scores 0.0.
Without labelled documents of both kinds every other text scores 0.5.  Repeated rows score alike.  A null id
has no label.  Columns of the input are kept, whatever their names, but for those that are called as the new ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkern
from .common import Shielded, by_value, drop_scratch, revive, settle, share

TRAIN_DOCS, TRAIN_LINES = 4000, 800_000
EMPTY_SCORE = 0.0
#: Byte classes that are counted for each line.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:'\"?-()",
    "bang": b"!",
    "sign": b"#$%&*@^~+=_`",
    "bar": b"|<>{}[]\\/",
    "space": b" \t\r\x0b\x0c",
}
OWN = 16


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines, OWN) of all lines of a slice, their rows and their lengths in bytes."""
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    begin = begin[begin < len(data)]
    row = np.searchsorted(offsets, begin, side="right") - 1
    end = np.minimum(np.append(begin[1:], len(data)), offsets[row + 1])
    # A break belongs to the line it ends.
    broken = (end > begin) & (data[np.maximum(end - 1, 0)] == 10)
    end = end - broken
    words = textkern.Words(data, offsets)
    first, last = np.searchsorted(words.start, begin), np.searchsorted(words.start, end)
    some = last > first
    begin, end, row, first, last = begin[some], end[some], row[some], first[some], last[some]
    n, size = len(begin), (end - begin).astype(np.float64)
    if not n:
        return np.zeros((0, OWN)), np.zeros(0, np.int64), np.zeros(0)
    counts = {}
    for name, members in CLASSES.items():
        table = np.zeros(256, dtype=np.int64)
        table[list(members)] = 1
        counts[name] = (textkern.counts_before(table, data, end) - textkern.counts_before(table, data, begin)).astype(np.float64)
    n_words = (last - first).astype(np.float64)
    length = (words.end - words.start).astype(np.float64)
    total = np.concatenate([[0], np.cumsum(length)])
    short = np.concatenate([[0], np.cumsum(length <= 3)])
    line_of = np.repeat(np.arange(n), last - first)  # a line break ends a word, so each word is in one line
    _, d, _ = textkern.distinct_weighted(words.hash, line_of)
    distinct = np.bincount(d, minlength=n)
    line_hash = np.zeros(n, dtype=np.uint64)
    np.add.at(line_hash, line_of, words.hash)  # order does not matter for what this is used for
    _, back, often = np.unique(np.stack([line_hash, row.astype(np.uint64)]), axis=1, return_inverse=True, return_counts=True)
    letters = counts["upper"] + counts["lower"] + 1.0
    out = np.stack(
        [
            np.ones(n), np.log1p(size), np.log1p(n_words), counts["upper"] / letters, counts["digit"] / size, counts["stop"] / size, counts["bang"] / size,
            counts["sign"] / size, counts["bar"] / size, counts["space"] / size, (total[last] - total[first]) / n_words, (short[last] - short[first]) / n_words,
            distinct / n_words, np.log1p(n_words - distinct), np.log1p(often[back.ravel()] - 1.0), (counts["sign"] + counts["bang"] + counts["bar"]) / n_words,
        ],
        axis=1,
    )
    return out, row, size


def with_neighbours(own: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Own features, then those of the line before and of the line after (0 at a document's edge)."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    if len(own) > 1:
        same = (row[1:] == row[:-1])[:, None]
        before[1:] = own[:-1] * same
        after[:-1] = own[1:] * same
    return np.concatenate([own, before, after], axis=1)


class Chains:
    """Lines of documents of different lengths, walked place by place; longest documents first."""

    def __init__(self, row: np.ndarray):
        start = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
        lengths = np.diff(np.append(start, len(row)))
        order = np.argsort(-lengths, kind="stable")
        self.start, self.lengths = start[order], lengths[order]
        self.rows = row[self.start] if len(row) else row

    def active(self, place: int) -> np.ndarray:
        return self.start[: np.searchsorted(-self.lengths, -place, side="left")] + place

    def forward_backward(self, unary: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Log alphas and betas (lines, 2) for log potentials, and the sum of log partition functions."""
        alpha, beta = unary.copy(), np.zeros_like(unary)
        longest = int(self.lengths[0]) if len(self.lengths) else 0
        for t in range(1, longest):
            at = self.active(t)
            p = alpha[at - 1]
            alpha[at, 0] += np.logaddexp(p[:, 0] + step[0, 0], p[:, 1] + step[1, 0])
            alpha[at, 1] += np.logaddexp(p[:, 0] + step[0, 1], p[:, 1] + step[1, 1])
        for t in range(longest - 1, 0, -1):
            at = self.active(t)
            q = beta[at] + unary[at]
            beta[at - 1, 0] = np.logaddexp(q[:, 0] + step[0, 0], q[:, 1] + step[0, 1])
            beta[at - 1, 1] = np.logaddexp(q[:, 0] + step[1, 0], q[:, 1] + step[1, 1])
        ends = self.start + self.lengths - 1
        log_z = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
        return alpha, beta, float(log_z.sum())


@dataclass
class Crf:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of label good, over 3 * OWN features
    step: np.ndarray  # (2, 2) potentials of neighbouring labels
    slope: float = 1.0
    shift: float = 0.0
    fitted: bool = True

    def inputs(self, own: np.ndarray, row: np.ndarray) -> np.ndarray:
        return with_neighbours((own - self.mean) / self.scale, row)

    def marginals(self, own: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Probability that each line is good."""
        unary = np.zeros((len(own), 2))
        unary[:, 1] = self.inputs(own, row) @ self.weights
        alpha, beta, _ = Chains(row).forward_backward(unary, self.step)
        gap = (alpha[:, 0] + beta[:, 0]) - (alpha[:, 1] + beta[:, 1])
        return 1.0 / (1.0 + np.exp(np.clip(gap, -500, 500)))

    def raw(self, own: np.ndarray, row: np.ndarray, size: np.ndarray, n_rows: int) -> np.ndarray:
        """Length-weighted mean of the marginals of each row; nan for a row without lines."""
        good = np.bincount(row, self.marginals(own, row) * size, n_rows)
        with np.errstate(invalid="ignore"):
            return good / np.bincount(row, size, n_rows)

    def score(self, raw: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.where(np.isnan(raw), EMPTY_SCORE, 0.5)
        z = self.slope * _logit(raw) + self.shift
        return np.where(np.isnan(raw), EMPTY_SCORE, 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _ascend(gradient, x: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Adam."""
    m, v = np.zeros_like(x), np.zeros_like(x)
    for i in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x + rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
    return x


def fit(own: np.ndarray, row: np.ndarray, size: np.ndarray, labels: np.ndarray, *, steps: int = 120, ridge: float = 1e-3) -> Crf:
    """``row`` numbers documents, in order; ``labels`` has their 0 or 1."""
    scale = own.std(axis=0) if len(own) else np.ones(OWN)
    scale[scale == 0] = 1.0
    mean = own.mean(axis=0) if len(own) else np.zeros(OWN)
    mean[0], scale[0] = 0.0, 1.0
    model = Crf(mean, scale, np.zeros(3 * OWN), np.zeros((2, 2)))
    if len(set(labels[np.unique(row)].tolist())) < 2:
        model.fitted = False
        return model
    x, n = model.inputs(own, row), len(own)
    y = labels[row].astype(np.float64)

    def plain(w: np.ndarray) -> np.ndarray:
        return x.T @ (y - 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))) / n - ridge * w

    w = _ascend(plain, model.weights, steps, 0.1)
    seems = x @ w
    worst = np.full(len(labels), np.inf)
    np.minimum.at(worst, row, seems)
    y = np.where((y == 0) & (seems > 0) & (seems > worst[row]), 1.0, y)
    chains, same = Chains(row), row[1:] == row[:-1]
    a, b = y[:-1][same].astype(int), y[1:][same].astype(int)
    seen = np.zeros((2, 2))
    np.add.at(seen, (a, b), 1.0)

    def field(theta: np.ndarray) -> np.ndarray:
        w, step = theta[:-4], theta[-4:].reshape(2, 2)
        unary = np.zeros((n, 2))
        unary[:, 1] = x @ w
        alpha, beta, _ = chains.forward_backward(unary, step)
        both = alpha + beta
        p = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
        log_z = np.logaddexp(both[:, 0], both[:, 1])
        i, j = np.flatnonzero(same), np.flatnonzero(same) + 1
        expected = np.array([[np.exp(alpha[i, s] + step[s, t] + unary[j, t] + beta[j, t] - log_z[j]).sum() for t in (0, 1)] for s in (0, 1)])
        return np.concatenate([x.T @ (y - p) / n, ((seen - expected) / n).ravel()]) - ridge * theta

    theta = _ascend(field, np.concatenate([w, np.zeros(4)]), steps, 0.05)
    model.weights, model.step = theta[:-4], theta[-4:].reshape(2, 2)
    raw = model.raw(own, row, size, len(labels))
    some = ~np.isnan(raw)
    z, target = _logit(raw[some]), labels[some].astype(np.float64)

    def calibrate(p: np.ndarray) -> np.ndarray:
        e = target - 1 / (1 + np.exp(-np.clip(p[0] * z + p[1], -500, 500)))
        return np.array([(e * z).mean(), e.mean()]) - 1e-4 * p

    model.slope, model.shift = _ascend(calibrate, np.array([1.0, 0.0]), 400, 0.05).tolist()
    model.slope = max(model.slope, 1e-3)  # a score never falls as lines get better
    return model


def train(docs: DataFrame, labels: DataFrame, *, id_column: str, text: str, label: str, train_docs: int = TRAIN_DOCS) -> Crf:
    """Fits on rows of ``docs`` whose id has a label in ``labels`` (id_column, label)."""
    by_value()
    held, known = Shielded(docs), Shielded(labels)
    marked = known.rows.select(F.col(known.of(id_column)).alias("id"), F.col(known.of(label)).cast("int").alias("label")).where("id is not null and label is not null")
    picked = marked.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(train_docs)  # bounds what is broadcast
    rows = held.rows.select(F.col(held.of(id_column)).alias("id"), F.col(held.of(text)).alias("text"))
    sample = rows.join(F.broadcast(picked), "id").select("label", "text", F.xxhash64("id").alias("order"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in textkern.slices(batch.column(1)):
                own, row, size = line_features(data, offsets)
                edge = np.searchsorted(row, np.arange(len(offsets)))
                out: tuple[list, list, list, list] = ([], [], [], [])
                for r in range(len(offsets) - 1):
                    part = slice(edge[r], edge[r + 1])
                    out[0].append(batch.column(0)[first + r].as_py())
                    out[1].append(own[part].astype(np.float32).tobytes())
                    out[2].append(size[part].astype(np.float32).tobytes())
                    out[3].append(batch.column(2)[first + r].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.int64())], names=["label", "own", "size", "at"])

    made = sample.mapInArrow(work, "label int, own binary, size binary, at bigint")
    # Of rows that share an id, the one with the least features; then whole documents only, as many as fit.
    one = made.groupBy("at").agg(F.min(F.struct(F.xxhash64("label", "own", "size").alias("mark"), "label", "own", "size")).alias("of")).select("at", "of.*")
    held_rows = settle(one, "lines")
    room, kept = TRAIN_LINES, []
    for at, n in sorted(map(tuple, held_rows.select("at", F.expr("octet_length(size) div 4")).collect())):
        if n <= room:
            kept.append(at)
            room -= n
    rows = held_rows.join(F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in kept], "at bigint")), "at").collect()
    drop_scratch(held_rows)
    rows = sorted(rows, key=lambda r: (bytes(r["own"]), r["label"]))  # the same model, whatever the order of partitions
    own = [np.frombuffer(r["own"], np.float32).reshape(-1, OWN).astype(np.float64) for r in rows]
    size = [np.frombuffer(r["size"], np.float32).astype(np.float64) for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(s) for s in size]).astype(np.int64)
    return fit(np.concatenate([np.zeros((0, OWN)), *own]), row, np.concatenate([np.zeros(0), *size]), np.array([r["label"] for r in rows], dtype=np.int64))


def score_texts(docs: DataFrame, model: Crf, *, text: str = "text", score: str = "score", lines: str = "n_lines") -> DataFrame:
    """``docs`` with ``score`` and ``lines``, the number of its lines (replaced if they are there)."""
    by_value()
    held, shared = Shielded(docs, (score, lines)), share(docs.sparkSession, model)
    column = held.rows.columns.index(held.of(text))
    schema = T.StructType([*held.rows.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(lines, T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = revive(Crf, shared)
        for batch in batches:
            found, counts = [np.zeros(0)], [np.zeros(0, np.int64)]
            for _, data, offsets in textkern.slices(batch.column(column)):
                own, row, size = line_features(data, offsets)
                found.append(crf.score(crf.raw(own, row, size, len(offsets) - 1)))
                counts.append(np.bincount(row, minlength=len(offsets) - 1))
            extra = [pa.array(np.concatenate(found)), pa.array(np.concatenate(counts).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=schema.names)

    return held.restore(held.rows.mapInArrow(work, schema), (score, lines))


def held_out(id_column: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id, as text, leaves ``fold``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % folds == fold, F.lit(False))
