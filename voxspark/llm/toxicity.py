"""Toxicity by subword bags: embeddings of hashed character n-grams, averaged into a linear softmax, trained jointly.

A word is the mean of its n-gram vectors, a window the mean of its words, so a misspelt word shares most of its vectors
with the word it stands for. A toxic document is toxic somewhere, not everywhere: in every pass the model learns from the
window of it that looks worst by then, and from the worst and some other windows of a clean one. A logistic curve fitted
on other documents turns a document's worst window, its three worst and its number of words into a score.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from voxspark.llm.common import STEP, add_columns, mixed
from voxspark.llm.labelled import chance, labelled_sample, logistic_of

#: Documented parameters: labelled documents per class, longest text used for fitting, buckets, vector size, n-gram widths.
TRAIN_DOCUMENTS = 1500
TRAIN_BYTES = 32 << 10
BUCKET_BITS = 17
DIMENSIONS = 8
WIDTHS = (3, 4, 5)
WINDOW = 2
#: Worst windows that count, other windows of a clean document in a pass, passes, windows in a step, and the learning rate.
WORST = 3
OTHERS = 3
EPOCHS = 8
BATCH = 64
RATE = 0.25


#: Runs of letters and digits, as ``str.isalnum`` knows them.
WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray  # of each bucket, its vector times the difference of the two softmax rows
    bias: float
    slopes: np.ndarray
    intercept: float


@functools.cache
def _word_characters() -> np.ndarray:
    return np.fromiter((chr(code).isalnum() for code in range(0x110000)), bool, 0x110000)


def subwords(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(buckets, word of each bucket, words): hashed n-grams inside ``<word>`` marks, of the lower-cased text."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _word_characters()[codes]
    if not kinds.any():
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    keep = kinds.copy()
    keep[1:] |= kinds[:-1]
    codes = np.where(kinds, codes, 32)[keep]
    codes = np.concatenate(([32], codes, [32] if codes[-1] != 32 else [])).astype(np.uint64)
    gaps = codes == 32
    words = np.cumsum(gaps) - 1  # of a character: its word; of a gap: the word after it
    crossed = np.concatenate(([0], np.cumsum(gaps)))
    found, owners = [], []
    for width in WIDTHS:
        count = len(codes) - width + 1
        if count <= 0:
            continue
        inside = crossed[width - 1 : width - 1 + count] - crossed[1 : 1 + count] == 0
        total = np.full(count, width, np.uint64)
        for offset in range(width):
            total = total * STEP + codes[offset : offset + count]
        found.append((mixed(total[inside]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        owners.append(words[1 : 1 + count][inside])
    return np.concatenate(found), np.concatenate(owners), int(gaps.sum()) - 1


def word_logits(weights: np.ndarray, text: str | None) -> np.ndarray:
    """Of each word, the mean weight of its n-grams."""
    found, owners, words = subwords(text)
    if not words:
        return np.empty(0)
    total = np.bincount(owners, weights[found], words)
    return total / np.maximum(np.bincount(owners, minlength=words), 1)


def window_logits(logits: np.ndarray) -> np.ndarray:
    """The mean of every window of words; a shorter text is one window."""
    width = min(WINDOW, len(logits))
    sums = np.concatenate(([0.0], np.cumsum(logits)))
    return (sums[width:] - sums[:-width]) / width


def evidence(weights: np.ndarray, bias: float, text: str | None) -> tuple[float, float, float]:
    """(highest logit of any window, mean of the WORST highest, logarithm of the number of words) of the whole text."""
    logits = word_logits(weights, text)
    if not len(logits):
        return bias, bias, 0.0
    windows = window_logits(logits)
    count = min(WORST, len(windows))
    worst = np.partition(windows, len(windows) - count)[-count:]
    return bias + float(worst.max()), bias + float(worst.mean()), float(np.log1p(len(logits)))


@dataclass(frozen=True)
class _Words:
    """The different words of a sample: the buckets of each, one after the other; documents are numbers of words."""

    documents: list[np.ndarray]
    buckets: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(texts: list[str]) -> _Words:
        numbers: dict[str, int] = {}
        documents = [np.array([numbers.setdefault(word, len(numbers)) for word in WORD.findall(text.lower())], np.int64) for text in texts]
        buckets, owners, _ = subwords(" ".join(numbers))
        order = np.argsort(owners, kind="stable")
        return _Words(documents, buckets[order], np.bincount(owners, minlength=len(numbers)))

    def logits(self, weights: np.ndarray) -> np.ndarray:
        owners = np.repeat(np.arange(len(self.sizes)), self.sizes)
        return np.bincount(owners, weights[self.buckets], len(self.sizes)) / np.maximum(self.sizes, 1)

    def shares(self, items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(buckets, shares, item) of windows of words: the share of a bucket in the mean of means adds up to 1 an item."""
        words, lengths = np.concatenate(items), np.array([len(i) for i in items])
        sizes = self.sizes[words]
        starts = (np.cumsum(self.sizes) - self.sizes)[words]
        places = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        shares = 1.0 / np.maximum(sizes, 1) / np.repeat(lengths, lengths)
        return self.buckets[places], np.repeat(shares, sizes), np.repeat(np.repeat(np.arange(len(items)), lengths), sizes)


def _picked(words: _Words, labels: list[int], weights: np.ndarray, first: bool, random: np.random.Generator) -> list[tuple[np.ndarray, int]]:
    """The windows of a pass with their labels: at first windows from all over each document, then the worst of it, and
    of a clean one some others too."""
    logits, found = words.logits(weights), []
    for document, label in zip(words.documents, labels, strict=True):
        if not len(document):
            continue
        scores, width = window_logits(logits[document]), min(WINDOW, len(document))
        if first:
            starts = list(range(0, len(scores), WINDOW))
        else:
            starts = [int(scores.argmax()), *([] if label else random.integers(0, len(scores), OTHERS).tolist())]
        found += [(document[start : start + width], label) for start in starts]
    return found


def _train(sample: list[tuple[str, int]]) -> tuple[np.ndarray, float]:
    random = np.random.default_rng(7)
    vectors = random.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS))
    rows = random.normal(0, 0.5, (DIMENSIONS, 2))
    bias = np.zeros(2)
    words, marks = _Words.of([text for text, _ in sample]), [label for _, label in sample]
    speed, row_speed = np.full(1 << BUCKET_BITS, 1e-6), np.full((DIMENSIONS, 2), 1e-6)
    for epoch in range(EPOCHS):
        items = _picked(words, marks, vectors @ (rows[:, 1] - rows[:, 0]), epoch == 0, random)
        order = random.permutation(len(items))
        for start in range(0, len(order), BATCH):
            batch = [items[i] for i in order[start : start + BATCH]]
            buckets, shares, item = words.shares([window for window, _ in batch])
            labels = np.array([label for _, label in batch])
            hidden = np.stack([np.bincount(item, vectors[buckets, k] * shares, len(batch)) for k in range(DIMENSIONS)], axis=1)
            logits = hidden @ rows + bias
            logits -= logits.max(axis=1, keepdims=True)
            chances = np.exp(logits)
            chances /= chances.sum(axis=1, keepdims=True)
            chances[np.arange(len(batch)), labels] -= 1
            slope_rows = hidden.T @ chances / len(batch)
            back = chances @ rows.T / len(batch)
            distinct, inverse = np.unique(buckets, return_inverse=True)
            flat = back[item] * shares[:, None]
            slope = np.stack([np.bincount(inverse, flat[:, k], len(distinct)) for k in range(DIMENSIONS)], axis=1)
            speed[distinct] += (slope**2).mean(axis=1)
            vectors[distinct] -= RATE * slope / np.sqrt(speed[distinct])[:, None]
            row_speed += slope_rows**2
            rows -= RATE * 0.2 * slope_rows / np.sqrt(row_speed)
            bias -= RATE * 0.2 * chances.mean(axis=0)
    return vectors @ (rows[:, 1] - rows[:, 0]), float(bias[1] - bias[0])


def fit_toxicity(documents: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", per_class: int = TRAIN_DOCUMENTS) -> ToxicityModel:
    """Fit on a bounded sample. Without labels of both classes the score is the share of label 1 (0.5 without any)."""
    sample, sizes = labelled_sample(documents, labels, label, usable, per_class, TRAIN_BYTES)
    held, seen = [x for i, x in enumerate(sample) if i % 4 == 0], [x for i, x in enumerate(sample) if i % 4]
    weights, bias = _train(seen) if len({y for _, y in seen}) == 2 else (np.zeros(1 << BUCKET_BITS), 0.0)
    features = np.array([evidence(weights, bias, text) for text, _ in held]).reshape(-1, 3)
    slopes, intercept = logistic_of(features, [y for _, y in held], sizes)
    return ToxicityModel(weights.astype(np.float32), bias, slopes, intercept)


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` with ``score`` (0 to 1) of every row's whole text. Null texts and texts without a word get
    the score of the bias without words; equal texts get equal scores."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(texts: list) -> list[pa.Array]:
        m = shared.value
        found = np.array([evidence(m.weights, m.bias, value) for value in texts]).reshape(-1, 3)
        return [pa.array(chance(found @ m.slopes + m.intercept), pa.float64())]

    return add_columns(df, text, keep, [("score", "double")], score)
