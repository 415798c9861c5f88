"""Document quality from a linear-chain conditional random field over lines.

Method: a line is described by shares of its characters and words (letters, capitals, digits,
symbols, repeated and distinct words, words that end in symbols, lengths), and by the same features
of the lines before and after. A conditional random field labels every line good or bad; the
marginal of each line comes from forward-backward, and a document's quality is the mean marginal
weighted by line length, calibrated by a logistic fit on the training documents. In training a line
has the label of its document.

Scale: fitted on the driver from at most ``SAMPLE`` labelled documents, those with the least hash
of their id (a documented bound; labels are read whole, only the sample's lines are collected). All
documents are scored whole in one scan, without a shuffle; a piece of texts steps through its lines
together.

Defined results: null and empty texts are one empty line and are scored like any other; rows are
scored one by one, repeated or not; labels that are null or of unknown documents are not used; of
repeated labels the greatest counts; with fewer than two classes in the sample all scores are 0.5;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geosieve.llm.arrays import pieces, raw, words
from geosieve.llm.tables import map_arrow

SAMPLE = 4000
NAMES = 14


def _class(*codes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for code in codes:
        table[code] = True
    return table


UPPER, LOWER_, DIGIT, SPACE = _class(slice(65, 91)), _class(slice(97, 123), slice(128, 256)), _class(slice(48, 58)), _class(32, slice(9, 14))
STOP = _class(*b".,;:'\"()-?")
SYMBOL = ~(UPPER | LOWER_ | DIGIT | SPACE | STOP)
NOT_SPACE = ~SPACE


def line_features(piece: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their byte lengths, and the n + 1 line offsets of the texts."""
    data, ends = raw(piece.column(column))
    newline = np.flatnonzero(data == 10)
    # A text of no bytes is one line: bounds repeat where texts are empty.
    own = np.searchsorted(ends[1:], newline, side="right")
    starts = np.concatenate([ends[:-1], newline + 1])
    order = np.argsort(np.concatenate([np.arange(len(ends) - 1), own]), kind="stable")
    starts = starts[order]
    counts = 1 + np.bincount(own, minlength=len(ends) - 1)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    stops = np.empty_like(starts)
    stops[:-1] = starts[1:] - 1
    last = offsets[1:] - 1
    stops[last] = ends[1:]
    size = np.maximum(stops - starts, 0)
    part = np.maximum(size, 1)

    def share(table):
        sums = np.concatenate([[0], np.cumsum(table[data])])
        return (sums[np.maximum(stops, starts)] - sums[starts]) / part

    w_start, w_end, w_hash, _ = words(data, ends, NOT_SPACE)
    line = np.searchsorted(starts, w_start, side="right") - 1
    # Starts repeat only for empty texts, whose lines hold no word.
    n = np.bincount(line, minlength=len(starts))
    some = np.maximum(n, 1)

    def mean(values):
        return np.bincount(line, weights=values, minlength=len(starts)) / some

    order = np.lexsort((w_hash, line))
    new = np.ones(len(order), bool)
    new[1:] = (w_hash[order][1:] != w_hash[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order][new], minlength=len(starts)) / some
    same = np.zeros(len(w_hash))
    same[1:] = (w_hash[1:] == w_hash[:-1]) & (line[1:] == line[:-1])
    final = data[w_end - 1] if len(w_end) else np.zeros(0, np.uint8)
    alone = (w_end - w_start == 1) & SYMBOL[data[w_start]] if len(w_start) else np.zeros(0)
    columns = [
        np.ones(len(starts)), share(UPPER), share(LOWER_), share(DIGIT), share(SYMBOL), share(STOP), share(SPACE),
        distinct, mean(same), mean(SYMBOL[final]), mean(alone), np.minimum(mean(w_end - w_start), 40) / 10,
        np.log1p(size) / 5, (n == 0).astype(float),
    ]
    own = np.stack(columns, axis=1)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[offsets[:-1]], after[last] = 0, 0
    return np.concatenate([own, before, after], axis=1), size, offsets


def marginals(emit: np.ndarray, trans: np.ndarray, offsets: np.ndarray):
    """P(good) of each line, expected transitions and log-partition; emit is the log-odds of good."""
    score = np.stack([np.zeros(len(emit)), emit], axis=1)
    ahead, behind = np.zeros_like(score), np.zeros_like(score)
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = offsets[:-1][order], sizes[order]
    steps = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(steps), side="left")  # texts with more than t lines
    if steps:
        ahead[first] = score[first]
    for t in range(1, steps):
        at = first[:live[t]] + t
        ahead[at] = score[at] + np.logaddexp(ahead[at - 1, :1] + trans[0], ahead[at - 1, 1:] + trans[1])
    for t in range(steps - 2, -1, -1):
        at = first[:live[t + 1]] + t
        nxt = score[at + 1] + behind[at + 1]
        behind[at] = np.logaddexp(trans[:, 0] + nxt[:, :1], trans[:, 1] + nxt[:, 1:])
    both = ahead + behind
    total = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    inner = np.ones(len(emit), bool)
    inner[offsets[1:] - 1] = False
    at = np.flatnonzero(inner)
    pair = np.exp(ahead[at][:, :, None] + trans[None] + (score[at + 1] + behind[at + 1])[:, None, :] - total[at][:, None, None])
    return good, pair.sum(axis=0)


class Field:
    """Weights of the field and of the final calibration."""

    def __init__(self, x: np.ndarray, size: np.ndarray, offsets: np.ndarray, label: np.ndarray,
                 rounds: int = 200, ridge: float = 1e-3):
        self.fitted = len(np.unique(label)) == 2
        if not self.fitted:
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self._scaled(x)
        line_label = np.repeat(label, np.diff(offsets)).astype(float)
        inner = np.ones(len(x), bool)
        inner[offsets[1:] - 1] = False
        seen = np.zeros((2, 2))
        for a in (0, 1):
            seen[a, a] = (inner & (line_label == a)).sum()
        self.w, self.trans = np.zeros(z.shape[1]), np.zeros((2, 2))
        theta = np.zeros(z.shape[1] + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, rounds + 1):
            self.w, self.trans = theta[:-4], theta[-4:].reshape(2, 2)
            good, pair = marginals(z @ self.w, self.trans, offsets)
            grad = np.concatenate([z.T @ (line_label - good), (seen - pair).ravel()]) / len(z) - ridge * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.w, self.trans = theta[:-4], theta[-4:].reshape(2, 2)
        # Calibration: label ~ logistic(a + b * mean marginal), by Newton steps.
        q = np.stack([np.ones(len(label)), self.quality(x, size, offsets)], axis=1)
        self.a = np.zeros(2)
        for _ in range(25):
            p = 1 / (1 + np.exp(-q @ self.a))
            h = (q * (p * (1 - p))[:, None]).T @ q + 1e-2 * np.eye(2)
            self.a = self.a + np.linalg.solve(h, q.T @ (label - p) - 1e-2 * self.a)

    def _scaled(self, x):
        z = (x - self.mean) / self.scale
        z[:, 0] = 1
        return z

    def quality(self, x, size, offsets) -> np.ndarray:
        good, _ = marginals(self._scaled(x) @ self.w, self.trans, offsets)
        weight = size + 1.0
        sums, total = (np.add.reduceat(v, offsets[:-1]) for v in (good * weight, weight))
        return sums / total

    def score(self, x, size, offsets) -> np.ndarray:
        if not self.fitted:
            return np.full(len(offsets) - 1, 0.5)
        return 1 / (1 + np.exp(-(self.a[0] + self.a[1] * self.quality(x, size, offsets))))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """``docs`` (id, text) and ``labels`` (id, label 0 or 1), both of the training rows."""
    chosen = (labels.filter("label is not null and id is not null").groupBy("id").agg(F.max("label").cast("double").alias("label"))
              .orderBy(F.xxhash64("id"), "id").limit(sample))

    def work(batches):
        for piece in pieces(batches, "text"):
            x, size, offsets = line_features(piece, "text")
            yield pa.RecordBatch.from_arrays(
                [piece.column("label"), pa.array(np.diff(offsets)), pa.array([row.astype(np.float32).tobytes() for row in np.split(x, offsets[1:-1])], pa.binary()),
                 pa.array([row.astype(np.int64).tobytes() for row in np.split(size, offsets[1:-1])], pa.binary())],
                names=["label", "n", "x", "size"])

    rows = map_arrow(docs.join(F.broadcast(chosen), "id").select("text", "label"), work,
                     "label double, n long, x binary, size binary").toArrow()
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, 3 * NAMES).astype(float)
    size = np.frombuffer(b"".join(rows["size"].to_pylist()), np.int64)
    offsets = np.concatenate([[0], np.cumsum(rows["n"].to_numpy())]).astype(np.int64)
    return Field(x, size, offsets, rows["label"].to_numpy())


def score_quality(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, score, predicted) of each row of ``docs``, learned from ``train_docs`` and ``labels``."""
    field = learn(train_docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")),
                  labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")))
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def work(batches):
        for piece in pieces(batches, text_col):
            score = shared.value.score(*line_features(piece, text_col))
            yield pa.RecordBatch.from_arrays([piece.column(id_col), pa.array(score)], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), work, f"id {kind}, score double").select(
        F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
