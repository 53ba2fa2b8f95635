"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or.

A sentence's probability is a logistic function of its words, and of their beginnings if
that predicts better; a document is toxic if any sentence is: P = 1 - prod(1 - p_s). Only
document labels are known, and the likelihood of those trains the weights through the
noisy-or. The same sentence scores then locate the offending sentences.

Whether beginnings are features is decided in training, on a part of its own rows that
the deciding fits do not see; labels of any other rows have no say in it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import labelled_sample, ready, text_slices, texts

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
#: Bounds of the training: labelled documents of each class, features of the model (those that tell most), gradient steps.
PER_CLASS = 1_200
MODEL_FEATURES = 3_000
STEPS = 150
LEAST_DOCUMENTS = 2
PENALTY = 0.02
START_BIAS = -6.0
#: The lengths of beginnings that training chooses among.
CHOICES = ((), (4, 5, 6, 7))
INNER_PARTS = 4
KNOWN_WORDS = 200_000


def features(word: str, prefixes: tuple[int, ...]) -> list[str]:
    """A word's features: itself, and its beginnings, which inflected forms share."""
    return [word, *(f"{word[:k]}*" for k in prefixes if len(word) > k)]


@dataclass(frozen=True)
class ToxicityModel:
    """Feature weights and bias of the sentence score."""

    weights: dict[str, float]
    bias: float
    prefixes: tuple[int, ...] = ()
    known: dict[str, float] = field(default_factory=dict, compare=False)

    def word(self, word: str) -> float:
        """The sum of a word's feature weights; remembered for a bounded number of words."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            found = self.known[word] = sum([self.weights.get(x, 0.0) for x in features(word, self.prefixes)])
        return found

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(first character, one past the last, log-odds) of each sentence that has a word."""
        get, out = self.word, []
        for m in SENTENCE.finditer(text):
            words = set(WORD.findall(m[0].lower()))
            if words:
                out.append((m.start(), m.end(), self.bias + sum(map(get, words))))
        return out


def noisy_or(logits: list[float]) -> float:
    """1 - prod(1 - sigmoid(z)); 0 without sentences."""
    return -math.expm1(-sum([z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z)) for z in logits]))


def likelihood(w: np.ndarray, ids: np.ndarray, sentence_of: np.ndarray, document_of: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The weighted negative log-likelihood of document labels and its gradient by ``w``, whose last entry is the bias.

    ``ids`` are features, ``sentence_of`` the sentence of each, ``document_of`` the
    document of each sentence.
    """
    z = w[-1] + np.bincount(sentence_of, w[ids], len(document_of))
    total = np.maximum(np.bincount(document_of, np.logaddexp(0, z), len(y)), 1e-9)  # -log of the chance that no sentence is
    loss = np.where(y > 0, -np.log(-np.expm1(-total)), total) @ weight
    away = np.where(y > 0, -1.0 / np.expm1(total), 1.0) * weight
    g = away[document_of] / (1 + np.exp(-z))
    return float(loss), np.append(np.bincount(ids, g[sentence_of], len(w) - 1), g.sum())


def train(rows: list[tuple[bytes, int, float]]) -> ToxicityModel:
    """Fits a model with the choice of features that does best on the inner part: rows whose text's crc32 is 0 modulo INNER_PARTS.

    Without rows of both classes every weight is zero.
    """
    inner = [r for r in rows if zlib.crc32(r[0]) % INNER_PARTS == 0]
    outer = [r for r in rows if zlib.crc32(r[0]) % INNER_PARTS]
    best, least = CHOICES[0], math.inf
    for prefixes in CHOICES:
        model = fitted(outer, prefixes)
        scores = [min(max(noisy_or([z for *_, z in model.sentences(text.decode())]), 1e-6), 1 - 1e-6) for text, _, _ in inner]
        loss = -sum(w * math.log(s if label else 1 - s) for s, (_, label, w) in zip(scores, inner, strict=True))
        if loss < least:
            best, least = prefixes, loss
    return fitted(rows, best)


def fitted(rows: list[tuple[bytes, int, float]], prefixes: tuple[int, ...]) -> ToxicityModel:
    """Fits feature weights to document labels by Adam on the noisy-or likelihood.

    Features are the MODEL_FEATURES with the highest chi-square between presence in a
    document and its label.
    """
    documents = [[[x for w in set(WORD.findall(s.lower())) for x in features(w, prefixes)] for s in SENTENCE.findall(text.decode())] for text, _, _ in rows]
    documents = [[s for s in d if s] for d in documents]
    y = np.array([label for _, label, _ in rows], float)
    weight = np.array([w for *_, w in rows], float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel({}, START_BIAS, prefixes)
    inside = [Counter(), Counter()]
    for d, label in zip(documents, y, strict=True):
        inside[int(label)].update(set().union(*d))
    n1, n0 = y.sum(), len(y) - y.sum()

    def chi(word: str) -> float:
        a, b = inside[1][word], inside[0][word]
        expected = (a + b) * n1 / (n0 + n1)
        return (a - expected) ** 2 / (expected + 1)

    names = [w for w in {*inside[0], *inside[1]} if inside[0][w] + inside[1][w] >= LEAST_DOCUMENTS]
    names = sorted(names, key=lambda w: (-chi(w), w))[:MODEL_FEATURES]
    index = {w: i for i, w in enumerate(names)}
    ids, sentence_of, document_of = [], [], []
    for k, d in enumerate(documents):
        for s in d:
            own = [index[w] for w in sorted(s) if w in index]
            ids.extend(own)
            sentence_of.extend([len(document_of)] * len(own))
            document_of.append(k)
    ids, sentence_of, document_of = np.array(ids, int), np.array(sentence_of, int), np.array(document_of, int)
    weight = weight / weight.sum()
    w = np.zeros(len(names) + 1)
    w[-1] = START_BIAS
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        _, grad = likelihood(w, ids, sentence_of, document_of, y, weight)
        grad[:-1] += PENALTY * w[:-1] / len(y)
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        w -= 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return ToxicityModel({n: float(x) for n, x in zip(names, w, strict=False) if abs(x) > 1e-3}, float(w[-1]), prefixes)


def fit(df: DataFrame, id_column: str, text_column: str, labels: DataFrame, label: str, allowed, per_class: int = PER_CLASS) -> ToxicityModel:
    """Trains on a bounded sample of labelled documents: ``per_class`` of each class, whole texts."""
    return train(labelled_sample(df, id_column, text_column, labels, label, allowed, per_class))


def score(df: DataFrame, id_column: str, text_column: str, model: ToxicityModel) -> DataFrame:
    """Scores every whole text and locates its offending sentences.

    Returns id, score, n_sentences, offending (array of start, end, score for sentences
    of probability 0.5 or more, in characters). Null, empty and wordless texts have no
    sentence and score 0. A text is read whole, however long; a null id stays null;
    repeated rows give repeated rows; an empty table gives no rows; other columns are not
    read. No shuffle.
    """
    ready(df.sparkSession)
    kind = df.schema[id_column].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                scores, counts, found = [], [], []
                for text in texts(batch.column("text")):
                    own = model.sentences(text)
                    scores.append(noisy_or([z for *_, z in own]))
                    counts.append(len(own))
                    found.append([{"start": a, "end": b, "score": 1 / (1 + math.exp(-z))} for a, b, z in own if z >= 0])
                place = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(found, place)], ["id", "score", "n_sentences", "offending"])

    source = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return source.mapInArrow(each, f"id {kind}, score double, n_sentences bigint, offending array<struct<start:bigint,end:bigint,score:double>>").withColumnRenamed("id", id_column)
