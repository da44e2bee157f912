"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every coordinate of the hashed vocabulary has a sparse random index vector. A word's vector is the sum of the
index vectors of the words around it, over all documents, of unit length, plus its own index vector. A word
counts twice: by its letters, lower-cased, and by its shape (capitals, the marks it carries, a repetition of the
word before). A document is the mean of its words' vectors, with the logarithm of its length; a network of one hidden
layer gives its logit, and a temperature fitted on rows that the network has not seen makes that a
probability.

Word vectors are learnt from every document: tasks return a row of whole numbers for every coordinate that they met, and these
are added up by coordinate, exactly and in any order. Network and temperature come from at most TRAIN_ROWS labelled documents;
VOCABULARY vectors and pooled vectors of those documents are all that comes to the driver.

Defined cases: a null or empty text is the zero vector and has a score like any other; without labelled
rows every score is 0.5; of rows that repeat a doc_id the smallest text is learnt; a null doc_id is never learnt from and its
`held_out` is false; other columns do not matter; a very long text is pooled whole, some words at a time; columns named score or
predicted are replaced.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, text_of
from .labelled import WordCache, remainder, training_ids, with_labels

#: Coordinates of the vocabulary, size of a vector, entries of an index vector that aren't zero.
VOCABULARY, SIZE, ENTRIES = 1 << 15, 32, 4
#: Words on either side that count as around a word.
AROUND = 2
#: Labelled documents that are learnt from at most, and the tasks that pool them.
TRAIN_ROWS, POOL_TASKS = 8192, 8
HIDDEN, EPOCHS, BATCH, RATE = 32, 40, 256, 0.01
THRESHOLD = 0.7
#: Rows with remainder HELD_OUT of MODULUS are not learnt from.
MODULUS, HELD_OUT = 4, 2
REPEATED = 1

_EDGE = b".,;:!?\"'()[]{}<>*_-#$%&|/\\~`^+=@"


def _at(what: bytes, kind: int) -> int:
    return 2 + xxhash.xxh64_intdigest(what, kind) % (VOCABULARY - 2)


def _word(word: bytes) -> bytes:
    """Coordinates of a word's letters and of its shape; 0: it has no shape worth a word."""
    core = word.strip(_EDGE)
    marks = word.replace(core, b" ") if core else word
    shape = (b"A" if len(core) > 2 and core.isupper() else b"") + (b"" if marks in (b" ", b" .", b" ,") else marks)
    return struct.pack("<HH", _at(core.lower(), 1), _at(shape, 2) if shape else 0)


_CACHE = WordCache(_word)


def coordinates(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Coordinates of the words, those of shapes and repetitions, and the number of words."""
    words = text.split()
    both = np.frombuffer(_CACHE.joined(words), "<u2").reshape(-1, 2)
    letters, shapes = both[:, 0], both[:, 1]
    again = int(np.count_nonzero(letters[1:] == letters[:-1]))
    return letters, np.concatenate([shapes[shapes > 0], np.full(again, REPEATED, "<u2")]), len(words)


def index_vectors(seed: int = 17) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((VOCABULARY, SIZE), np.float32)
    for _ in range(ENTRIES):
        out[np.arange(VOCABULARY), rng.integers(0, SIZE, VOCABULARY)] += rng.choice(np.array([-1, 1], np.float32), VOCABULARY)
    return out


_SUMS = "w int, " + ", ".join(f"v{k} long" for k in range(SIZE))
#: Words whose surroundings are summed at once.
CHUNK = 50_000


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per coordinate met the sum of the index vectors of the words around it."""
    index, total = index_vectors().astype(np.int16), np.zeros((VOCABULARY, SIZE), np.int64)
    met = np.zeros(VOCABULARY, bool)

    def add(parts: list[np.ndarray]) -> None:
        """Documents one after the other, far enough apart not to meet."""
        gap = np.full(AROUND, VOCABULARY, np.int64)
        words = np.concatenate([x for p in parts for x in (p.astype(np.int64), gap)])
        vectors = np.concatenate((index, np.zeros((1, SIZE), np.int16)))[words]
        around = np.zeros(vectors.shape, np.int32)
        for k in range(1, AROUND + 1):
            around[k:] += vectors[:-k]
            around[:-k] += vectors[k:]
        order = np.argsort(words, kind="stable")
        firsts = np.flatnonzero(np.concatenate(([True], np.diff(words[order]) != 0)))
        at, sums = words[order][firsts], np.add.reduceat(around[order], firsts, axis=0)
        total[at[at < VOCABULARY]] += sums[at < VOCABULARY]
        met[at[at < VOCABULARY]] = True

    parts: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for x in batch.column(0):
            letters = coordinates(x.as_buffer().to_pybytes())[0]
            for i in range(0, len(letters), CHUNK):
                part = letters[max(0, i - AROUND) : i + CHUNK + AROUND]
                if len(letters) <= CHUNK:
                    parts.append(part)
                    size += len(part)
                else:  # of a long text the words beyond the chunk are around it only
                    _add_inner(total, met, index, part, min(i, AROUND), min(CHUNK, len(letters) - i))
                if size > CHUNK:
                    add(parts)
                    parts, size = [], 0
    if parts:
        add(parts)
    at = np.flatnonzero(met)
    if len(at):
        columns = [pa.array(at.astype(np.int32)), *(pa.array(np.ascontiguousarray(total[at, k])) for k in range(SIZE))]
        yield pa.RecordBatch.from_arrays(columns, ["w", *(f"v{k}" for k in range(SIZE))])


def _add_inner(total: np.ndarray, met: np.ndarray, index: np.ndarray, part: np.ndarray, start: int, n: int) -> None:
    vectors, around = index[part], np.zeros((len(part), SIZE), np.int32)
    for k in range(1, AROUND + 1):
        around[k:] += vectors[:-k]
        around[:-k] += vectors[k:]
    np.add.at(total, part[start : start + n], around[start : start + n])
    met[part[start : start + n]] = True


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The vectors of all coordinates, from all documents."""
    body = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    sums = body.mapInArrow(_summed, _SUMS).groupBy("w").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(SIZE)]).toArrow()
    total = np.zeros((VOCABULARY, SIZE), np.float64)
    if sums.num_rows:
        total[sums.column(0).to_numpy()] = np.stack([sums.column(1 + k).to_numpy() for k in range(SIZE)], axis=1)
    length = np.linalg.norm(total, axis=1, keepdims=True)
    return (total / np.maximum(length, 1) + index_vectors() / ENTRIES**0.5).astype(np.float32)


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def pooled(self, text: bytes) -> np.ndarray:
        return pool(text, self.vectors)

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        hidden = np.tanh((pooled - self.mean) / self.scale @ self.w1 + self.b1)
        return 1 / (1 + np.exp(-np.clip((hidden @ self.w2 + self.b2) / self.temperature, -30, 30)))


def pool(text: bytes, vectors: np.ndarray) -> np.ndarray:
    """Means of the word vectors by letters and by shapes, and log(1 + words)."""
    letters, extra, n = coordinates(text)
    if not n:
        return np.zeros(2 * SIZE + 1, np.float32)
    return np.concatenate([vectors[letters].sum(0) / n, vectors[extra].sum(0) / n, [np.log1p(n)]]).astype(np.float32)


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, seed: int = 3) -> Model:
    """The two layers by Adam on four fifths of the rows, the temperature by the rest's log loss."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    split = max(1, len(x) * 4 // 5)
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(split)
        for i in range(0, split, BATCH):
            at = order[i : i + BATCH]
            h = np.tanh(x[at] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[at]) / len(at)
            dh = np.outer(d, p[2]) * (1 - h * h)
            grads, t = [x[at].T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True)], t + 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    rest = slice(split, None) if split < len(x) else slice(None)
    logits = np.tanh(x[rest] @ p[0] + p[1]) @ p[2] + p[3]
    sign = np.where(y[rest] > 0, 1.0, -1.0)
    loss = {t: np.logaddexp(0, -sign * logits / t).mean() for t in np.geomspace(0.25, 8, 41)}
    return Model(vectors, mean, scale, *(a.astype(np.float32) for a in p[:3]), float(p[3][0]), float(min(loss, key=loss.get)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id", rows: int = TRAIN_ROWS) -> Model | None:
    """None without labelled rows."""
    ids = training_ids(labels, label, remainder(F.col("doc_id"), MODULUS) != HELD_OUT, rows)
    sample = stage(with_labels(docs, ids, text, doc_id).repartition(POOL_TASKS, "turn"), "quality-sample")
    vectors = word_vectors(docs, text)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [pool(x.as_buffer().to_pybytes(), sent.value).tobytes() for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], ["turn", "y", "x"])

    found = sorted((r.turn, r.y, r.x) for r in sample.mapInArrow(pooled, "turn long, y int, x binary").collect())
    if not found:
        return None
    x = np.array([np.frombuffer(r[2], np.float32) for r in found], np.float64)
    return train(x, np.array([r[1] for r in found], np.float64), vectors)


def score(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with `score` (0 to 1, higher: good quality likelier) and `predicted`."""
    docs = docs.drop(*[c for c in ("score", "predicted") if c != text])
    if model is None:
        found = docs.withColumn("score", F.lit(0.5))
    else:
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def scores(texts: pa.Array) -> pa.Array:
            pooled = [sent.value.pooled(x.as_buffer().to_pybytes()) for x in texts]
            return pa.array(sent.value.probability(np.array(pooled, np.float64).reshape(len(pooled), -1)) if pooled else [], pa.float64())

        found = docs.withColumn("score", F.arrow_udf(scores, "double")(text_of(docs, text).cast("binary")))
    return found.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
