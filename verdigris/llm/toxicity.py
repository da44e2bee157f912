"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its words, its neighbouring pairs and its pairs with one word between, each hashed to
one of 2^BITS coordinates and counted as present or not. Every coordinate has its own learning rate, and L1
keeps most weights at zero, so the model is a short list of coordinates and weights that every task gets.

The model learns from at most TRAIN_ROWS labelled documents, the first in the order of a hash of their ids whose encoded
features fit into TRAIN_BYTES, encoded where they lie and gone through EPOCHS times in that order by one task.

Defined cases: a null or empty text has the bias alone as its features; without labelled rows, or with one
class only, the score is that of the bias (0.5 without rows); a null doc_id is never learnt from and
is held out if its null remainder says so, i.e. `held_out` is false; other columns do not matter; a very long text has its
features hashed whole, in its row's task; columns named score or predicted are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .labelled import WordCache, remainder, training_ids, with_labels

BITS = 20
#: Documents that are learnt from at most.
TRAIN_ROWS = 16_384
#: Bytes of their features (4 a coordinate, at most 2^BITS coordinates a document) that the learning task holds at most.
TRAIN_BYTES = 256 << 20
EPOCHS = 6
#: L1_ROOT is multiplied with the root of the number of rows, as the noise in a coordinate's gradient sum grows.
ALPHA, BETA, L1_ROOT, L2 = 2.0, 1.0, 0.15, 0.02
THRESHOLD = 0.5
#: Remainders of crc32(doc_id): rows with remainder HELD_OUT of MODULUS are not learnt from.
MODULUS, HELD_OUT = 5, 0

_EDGE = b".,;:!?\"'()[]{}<>*_-#$%&|/\\~`"
_PAIR, _SKIP, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _word(word: bytes) -> bytes:
    return xxhash.xxh64_digest(word.strip(_EDGE) or word, 7)


_CACHE = WordCache(_word)


def features(text: bytes, bits: int = BITS) -> np.ndarray:
    """Coordinates of a text, with repetitions; 0 is the bias."""
    words = text.lower().split()
    h = np.frombuffer(_CACHE.joined(words), "<u8")
    shift = np.uint64(64 - bits)
    grams = [h, h[:-1] * _PAIR + h[1:], h[:-2] * _SKIP + h[2:] + _SKIP] if len(h) > 1 else [h]
    found = [(((g ^ (g >> np.uint64(29))) * _MIX) >> shift).astype(np.int32) for g in grams]
    return np.concatenate([np.zeros(1, np.int32), *found])


@dataclass(frozen=True)
class Model:
    """Coordinates with a weight, and the weights."""

    bits: int
    coordinates: np.ndarray
    weights: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.coordinates] = self.weights
        return out


class Ftrl:
    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = 1.0, l2: float = L2) -> None:
        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, y: int) -> None:
        """One document: its distinct coordinates and its label."""
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def model(self) -> Model:
        w = self.weights(slice(None)).astype(np.float32)
        at = np.flatnonzero(w).astype(np.int32)
        return Model(self.bits, at, w[at])


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(features(x.as_buffer().to_pybytes())).tobytes() for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["turn", "y", "at"])


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, np.ndarray]] = []
    size = 0
    for b in batches:
        for y, at in zip(b.column(1).to_pylist(), b.column(2)):
            size += len(at.as_buffer())
            if size <= TRAIN_BYTES:
                rows.append((y, np.frombuffer(at.as_buffer().to_pybytes(), np.int32)))
    ftrl = Ftrl(l1=max(1.0, L1_ROOT * len(rows) ** 0.5))
    for _ in range(EPOCHS):
        for y, at in rows:
            ftrl.learn(at, y)
    model = ftrl.model()
    arrays = [pa.array([model.coordinates.tobytes()], pa.binary()), pa.array([model.weights.tobytes()], pa.binary())]
    yield pa.RecordBatch.from_arrays(arrays, ["coordinates", "weights"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id", rows: int = TRAIN_ROWS) -> Model:
    ids = training_ids(labels, label, remainder(F.col("doc_id"), MODULUS) != HELD_OUT, rows)
    encoded = with_labels(docs, ids, text, doc_id).mapInArrow(_encoded, "turn long, y int, at binary")
    one = encoded.repartition(1).sortWithinPartitions("turn", "at")
    found = one.mapInArrow(_trained, "coordinates binary, weights binary").collect()
    if not found:
        return Model(BITS, np.zeros(0, np.int32), np.zeros(0, np.float32))
    return Model(BITS, np.frombuffer(found[0].coordinates, np.int32), np.frombuffer(found[0].weights, np.float32))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with `score` (0 to 1, higher: toxic likelier) and `predicted`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    dense: list[np.ndarray] = []

    def scores(texts: pa.Array) -> pa.Array:
        if not dense:
            dense.append(sent.value.dense())
        w, out = dense[0], np.empty(len(texts))
        for i, x in enumerate(texts):
            at = features(x.as_buffer().to_pybytes(), model_bits)
            out[i] = w[np.unique(at[w[at] != 0])].sum()
        return pa.array(1 / (1 + np.exp(-out.clip(-30, 30))))

    model_bits = model.bits
    docs = docs.drop(*[c for c in ("score", "predicted") if c != text])
    found = docs.withColumn("score", F.arrow_udf(scores, "double")(text_of(docs, text).cast("binary")))
    return found.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
