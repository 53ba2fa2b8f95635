"""Quality classifier: a byte-level convolutional network in numpy.

A filter of width K is a table of weights by tap and byte. Its responses along the whole
text are max-pooled over chunks of two adjacent cells of CELL bytes, so chunks overlap
by half and cover every byte. The largest and the mean chunk value of each filter feed
one logistic unit. Training back-propagates through the pooled positions only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import labelled_sample, ready, text_slices, utf8

FILTERS, WIDTH, CELL = 10, 5, 256
#: Bounds of the training: labelled documents of each class, passes, documents of a step.
PER_CLASS = 600
PASSES = 8
STEP_DOCUMENTS = 48
BLOCK = 1 << 16


@dataclass(frozen=True)
class QualityModel:
    """filters[tap, byte, filter], the weights of largest and mean chunk values, and the bias."""

    filters: np.ndarray
    top: np.ndarray
    mean: np.ndarray
    bias: float


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts with WIDTH zero bytes after each, first and end position of each cell, and cells before each text."""
    sizes = np.array([max(len(t), 1) for t in texts])
    data = np.frombuffer(b"".join([(t or b"\0") + b"\0" * WIDTH for t in texts]), np.uint8)
    first = np.cumsum(sizes + WIDTH) - sizes - WIDTH
    cells = -(-sizes // CELL)
    before = np.concatenate(([0], np.cumsum(cells)))
    starts = np.repeat(first, cells) + (np.arange(before[-1]) - np.repeat(before[:-1], cells)) * CELL
    ends = np.minimum(starts + CELL, np.repeat(first + sizes, cells))
    return data, starts, ends, before


def _cells(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, filters: np.ndarray, where: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """The largest response of each filter in each cell and, with ``where``, its position.

    A cell's windows start in its own text, so they read that text and its zero bytes only.
    """
    out = np.empty((len(starts), filters.shape[2]), np.float32)
    at = np.empty(out.shape, np.int64) if where else None
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK)))
        low, high = starts[i], ends[j - 1]
        responses = filters[0][data[low:high]]
        for k in range(1, WIDTH):
            responses += filters[k][data[low + k : high + k]]
        bounds = np.stack([starts[i:j], ends[i:j]], axis=1).ravel()[:-1] - low
        out[i:j] = np.maximum.reduceat(responses, bounds, axis=0)[::2]
        if where:
            for c in range(i, j):
                at[c] = starts[c] + responses[starts[c] - low : ends[c] - low].argmax(axis=0)
        i = j
    return out, at


def _chunks(cells: np.ndarray, before: np.ndarray) -> np.ndarray:
    """For each cell the larger of it and the next cell of its text: the chunk that starts there."""
    after = np.arange(1, len(cells) + 1)
    after[before[1:] - 1] -= 1
    return after


def _forward(model: QualityModel, texts: list[bytes], where: bool = False):
    data, starts, ends, before = _layout(texts)
    cells, at = _cells(data, starts, ends, model.filters, where)
    after = _chunks(cells, before)
    chunk = np.maximum(cells, cells[after])
    top = np.maximum.reduceat(chunk, before[:-1], axis=0)
    mean = np.add.reduceat(chunk, before[:-1], axis=0) / np.diff(before)[:, None]
    # summed row by row, as a matrix product rounds by its shape: a score depends on its text only
    logit = (top * model.top).sum(axis=1) + (mean * model.mean).sum(axis=1) + model.bias
    return logit, (data, before, cells, at, after, chunk, top, mean)


def predict(model: QualityModel, texts: list[bytes]) -> np.ndarray:
    """The probability of label 1 of each text."""
    return 1 / (1 + np.exp(-np.clip(_forward(model, texts)[0].astype(float), -30, 30)))


def train(rows: list[tuple[bytes, int, float]], seed: int = 7) -> QualityModel:
    """Fits all weights by Adam; classes count alike in training, then the bias gets the labelled shares back."""
    random = np.random.default_rng(seed)
    p = [random.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), random.normal(0, 0.3, FILTERS).astype(np.float32), random.normal(0, 0.3, FILTERS).astype(np.float32), np.zeros(1, np.float32)]
    y = np.array([label for _, label, _ in rows], np.float32)
    weight = np.array([w for *_, w in rows], float)
    good, bad = weight[y > 0].sum(), weight[y == 0].sum()
    if not good or not bad:
        return QualityModel(p[0] * 0, p[1], p[2], 2.0 if good >= bad else -2.0)
    balance = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y == 0).sum()))
    first, second, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    for done in range(PASSES):
        order = random.permutation(len(rows))
        for k in range(0, len(rows), STEP_DOCUMENTS):
            own = order[k : k + STEP_DOCUMENTS]
            logit, (data, before, cells, at, after, chunk, top, mean) = _forward(QualityModel(p[0], p[1], p[2], p[3][0]), [rows[i][0] for i in own], True)
            off = ((1 / (1 + np.exp(-logit)) - y[own]) * balance[own] / len(own)).astype(np.float32)
            counts = np.diff(before)
            document = np.repeat(np.arange(len(own)), counts)
            up = (off / counts)[document][:, None] * p[2]
            up += np.where(chunk == top[document], off[document][:, None] * p[1], 0)
            source = np.where(cells >= cells[after], np.arange(len(cells))[:, None], after[:, None])
            places = np.take_along_axis(at, source, axis=0)
            grad = np.zeros_like(p[0])
            for f in range(FILTERS):
                for tap in range(WIDTH):
                    grad[tap, :, f] = np.bincount(data[places[:, f] + tap], up[:, f], 256)
            grads, step = [grad, off @ top, off @ mean, off.sum(keepdims=True)], step + 1
            rate = 0.03 * (1 - done / PASSES) + 0.003
            for x, g, m, v in zip(p, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return QualityModel(p[0], p[1], p[2], float(p[3][0] + np.log(good / bad)))


def fit(df: DataFrame, id_column: str, text_column: str, labels: DataFrame, label: str, allowed, per_class: int = PER_CLASS) -> QualityModel:
    """Trains on a bounded sample of labelled documents: ``per_class`` of each class, whole texts."""
    return train(labelled_sample(df, id_column, text_column, labels, label, allowed, per_class))


def score(df: DataFrame, id_column: str, text_column: str, model: QualityModel) -> DataFrame:
    """Scores every whole text: id, score. Null and empty texts are scored as one zero byte; no shuffle.

    Repeated rows give repeated rows; other columns are not read; a text of any length
    is read to its end, in blocks.
    """
    ready(df.sparkSession)
    kind = df.schema[id_column].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(predict(model, utf8(batch.column("text"))))], ["id", "score"])

    source = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return source.mapInArrow(each, f"id {kind}, score double").withColumnRenamed("id", id_column)


def keep_good(df: DataFrame, id_column: str, text_column: str, model: QualityModel, least: float) -> DataFrame:
    """The rows of ``df`` whose text scores ``least`` or more, with all their columns; decided within a partition."""
    ready(df.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, text_column):
                yield batch.filter(pa.array(predict(model, utf8(batch.column(text_column))) >= least))

    return df.mapInArrow(each, df.schema)
