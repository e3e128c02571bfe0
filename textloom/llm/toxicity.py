"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased, runs of characters other than letters and digits become one space, and it is the
set of its character n-grams, hashed to ``1 << BITS`` features. With p and q the
numbers of toxic and other texts that have a feature (plus one), r = log(p / |p|) - log(q / |q|) scales it,
and a logistic regression is fitted on the scaled features. The sample it is fitted on is bounded:
``most_toxic`` and ``most_other`` labelled texts (as many of either, so that toxic ones are not missed), each sent to
the driver as its features or, where that is shorter, as ``1 << BITS`` bits.

A text is scored in windows of ``WINDOW`` characters that overlap by half and cover all of it, and has the score of
its most toxic one: a sum over a set of bounded size, whatever the length of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import mix
from .learn import held_out, labelled, sample_ids, sigmoid, texts_of

BITS, GRAMS, WINDOW = 22, (3, 5, 7), 4000
_OTHER = re.compile(r"[\W_]+")


def _grams(text: str) -> np.ndarray:
    """The feature of every n-gram of a text, repeats included."""
    part = _OTHER.sub(" ", f" {text.lower()} ")
    x = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = [np.zeros(0, np.int32)]
    for n in GRAMS:
        if len(x) >= n:
            h = np.full(len(x) - n + 1, n, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + x[k : k + len(h)]
            out.append((mix(h) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(out)


def features(text: str, block: int = 1 << 20) -> np.ndarray:
    """The sorted features of a text, read in blocks that overlap by an n-gram."""
    return np.unique(np.concatenate([np.unique(_grams(text[at : at + block + max(GRAMS) - 1])) for at in range(0, max(len(text), 1), block)]))


def windows(text: str) -> Iterator[str]:
    """Runs of WINDOW characters, each half over the one before, to the end of the text."""
    half = WINDOW // 2
    for at in range(0, max(len(text) - half, 1), half):
        yield text[at : at + WINDOW]


def _packed(found: np.ndarray) -> bytes:
    """Features as 4 bytes each or as bits, whichever is shorter."""
    if 4 * len(found) < (1 << BITS) // 8:
        return found.astype("<i4").tobytes()
    flags = np.zeros(1 << BITS, bool)
    flags[found] = True
    return np.packbits(flags).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    if len(raw) < (1 << BITS) // 8:
        return np.frombuffer(raw, "<i4")
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8))).astype(np.int32)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), 256):
            part = batch.slice(i, 256)
            out = [_packed(features(t.as_py() or "")) for t in part["text"]]
            yield pa.RecordBatch.from_arrays([part["label"], pa.array(out, pa.binary())], ["label", "bits"])


def _parts(rows: list[bytes], most: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The first row's place and the features of runs of rows, of some ``most`` features or a single row each."""
    at, some, size = 0, [], 0
    for i, raw in enumerate(rows):
        x = _unpacked(raw)
        if some and size + len(x) > most:
            yield at, some
            at, some, size = i, [], 0
        some.append(x)
        size += len(x)
    if some:
        yield at, some


def fit(rows: list[bytes], label: np.ndarray, rounds: int = 80, ridge: float = 1e-3, part: int = 1 << 19) -> tuple[np.ndarray, float]:
    """Weights of the features (log-count ratio and coefficient in one) and the intercept, from packed rows.

    Full gradients, summed over parts of some ``part`` features so that little but the rows is in memory, with steps
    for each coordinate (Adam). Features that no row has keep the weight 0.
    """
    size = 1 << BITS
    y = label.astype(float)
    if not len(rows) or y.min() == y.max():
        return np.zeros(size, np.float32), float(40 * (y.mean() - 0.5)) if len(rows) else 0.0
    counts = {k: np.ones(size) for k in (0, 1)}
    for raw, k in zip(rows, label.tolist(), strict=True):
        counts[k][_unpacked(raw)] += 1
    seen = np.flatnonzero(counts[0] + counts[1] > 2)
    r = (np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum()))[seen]
    del counts
    place, size = np.zeros(size, np.int32), len(seen)
    place[seen] = np.arange(size)
    v, b = np.zeros(size), float(np.log(y.mean() / (1 - y.mean())))  # v: coefficient of the scaled feature
    m1, m2, c1, c2 = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, rounds + 1):
        w, g, gb = v * r, np.zeros(size), 0.0
        for i, some in _parts(rows, part):
            n = np.array([len(x) for x in some])
            flat = place[np.concatenate(some)]
            z = np.bincount(np.repeat(np.arange(len(some)), n), w[flat], minlength=len(some)) + b
            e = (sigmoid(z) - y[i : i + len(some)]) / len(rows)
            g += np.bincount(flat, np.repeat(e, n), minlength=size)
            gb += e.sum()
        g = g * r + ridge * v
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        v -= 0.02 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        c1, c2 = 0.9 * c1 + 0.1 * gb, 0.99 * c2 + 0.01 * gb * gb
        b -= 0.05 * (c1 / (1 - 0.9**t)) / (np.sqrt(c2 / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[seen] = v * r
    return weights, b


def logit(text: str, weights: np.ndarray, intercept: float, last: np.ndarray) -> float:
    """The score of a text's most toxic window before the logistic function; ``last`` is an array of ``1 << BITS`` integers to work in."""
    best = -np.inf
    for part in windows(text):
        x = _grams(part)
        at = np.arange(len(x), dtype=last.dtype)
        last[x] = at  # each feature counts where it is found last
        best = max(best, float(weights[x[last[x] == at]].sum(dtype=np.float64)) + intercept)
    return best


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = model.value
        last = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            s = sigmoid(np.array([logit(t.as_py() or "", weights, intercept, last) for t in batch["text"]]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = 1000, most_other: int = 1000) -> tuple[np.ndarray, float]:
    known = labelled(labels, "toxic")
    ids = sample_ids(known.where("label = 1"), most_toxic).unionByName(sample_ids(known.where("label = 0"), most_other))
    found = texts_of(docs, ids).select("label", "text").mapInArrow(_bits, "label int, bits binary").collect()
    found.sort()
    return fit([bytes(bits) for _, bits in found], np.array([k for k, _ in found], int))


def score_toxicity(docs: DataFrame, labels: DataFrame, most_toxic: int = 1000, most_other: int = 1000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text; other columns are not read).

    labels: doc_id, toxic (0, 1; others are ignored). Rows whose id is held out are not learnt from, at
    most ``most_toxic`` and ``most_other`` others are. Null and empty texts have no features and get the intercept's
    score; without labels all scores are 0.5, with labels of one kind all are near that kind. Rows may repeat.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, most_toxic, most_other))  # 2**BITS numbers
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")
