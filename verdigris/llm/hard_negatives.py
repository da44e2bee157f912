"""Hard-negative mining: for anchors and their nearest rows of the same label, the nearest rows of other labels in a band of scores.

A score is the inner product of two vectors of whole numbers. Vectors are turned by an orthogonal matrix, the principal axes of a
sample, so that their leading components hold most of what a product is made of. A pair's product is summed up a few leading
components at a time; what is left is at most the product of the two remainders' lengths, widened by a slack for rounding. A
pair that can't come in any more is discarded, the others go on to the next components; those that stay to the end are
multiplied as whole numbers, which alone decide.

What can come in is known early: the k-th largest lower bound of an anchor's rows is a bar for the others, and so is the k-th best
score of the blocks before.

Anchors and rows meet in blocks (vectors.py): every block of anchors with every block of rows, which is the search that is asked for.
A task keeps the best rows of its anchors over all blocks that it sees and returns no more than those, and a
window over the tasks' finds gives the best of all. First the positives are found so, then, for bands made of their scores, the
negatives. No group of a label ever meets in one place.

The rotation is fitted on the SAMPLE rows that a hash of vec_id puts first; it decides how early pairs are discarded, and no result.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part; a vector shorter than the
longest is filled up with zeros; rows that repeat a vec_id are rows of their own, also as each other's positives; a row
without a vec_id is no anchor and comes last among equals; an anchor without positives, or without rows in a band, gives no rows; an empty
table gives no rows; components so large that products need 56 bits are an error; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stage, with_row_key
from .vectors import BLOCK, BLOCK_BYTES, TooLarge, blocks, known, packed, unpacked, whole

SCALE = 256.0
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
BAND = (30, 90)
#: Rows that the rotation is fitted on.
SAMPLE = 4096
#: Parts of the components after which bounds are looked at.
STAGES = (0.25, 0.5, 0.75)
#: Slack of a bound, in parts of both lengths' product and for each component: far above what rounding does.
SLACK = 1e-14
#: Anchors of a block at most: the matrices of a block of anchors and one of rows have so many rows.
ANCHORS = 1024
#: Pairs that are multiplied one by one at a time.
PAIRS = 1 << 16
_LEAST = np.iinfo(np.int64).min
_FOUND = "anchor_key long, anchor_id long, slot int, id long, key long, score long"


def rotation(embeddings: DataFrame, vector: str, vec_id: str, dim: int, scale: float = SCALE, sample: int = SAMPLE) -> np.ndarray:
    """An orthogonal matrix whose columns are the sample's principal axes (of products, so about zero), largest first."""
    ids = F.col(vec_id).cast("long")
    some = embeddings.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("vector"), F.xxhash64(ids).alias("hash"), ids.alias("id"))
    table = some.orderBy("hash", "id").limit(sample).select("vector").toArrow()
    _, values = whole(table.column(0).combine_chunks(), scale) if table.num_rows else (None, np.zeros((0, dim), np.int64))
    values = np.pad(values, ((0, 0), (0, dim - values.shape[1]))).astype(np.float64)
    return np.linalg.eigh(values.T @ values)[1][:, ::-1].copy()


class Turned:
    """Rows, their leading components along the axes, and lengths of what is left after each stage."""

    def __init__(self, ids: pa.Array, labels: pa.Array, keys: pa.Array, values: np.ndarray, axes: np.ndarray) -> None:
        (self.ids, self.absent), self.labels, self.keys = known(ids), known(labels)[0], known(keys)[0]
        self.values, self.floats = values, values.astype(np.float64)
        self.turned = self.floats @ axes
        self.cuts = sorted({max(1, int(len(axes) * s)) for s in STAGES if len(axes)})
        squares = self.turned**2
        self.lengths = np.sqrt(squares.sum(1))
        self.rest = [np.sqrt(squares[:, c:].sum(1)) for c in self.cuts]

    def __len__(self) -> int:
        return len(self.ids)


class Best:
    """The first `count` rows of every slot: by falling score, then rising id (null last) and key."""

    def __init__(self, slots: int, count: int) -> None:
        self.count = count
        #: A row below its slot's floor can't come in.
        self.floor = np.full(slots, _LEAST)
        self.rows = {c: np.zeros(0, np.int64) for c in ("slot", "score", "absent", "id", "key")}

    def add(self, **rows: np.ndarray) -> None:
        kept = rows["score"] >= self.floor[rows["slot"]]
        if not kept.any():
            return
        both = {c: np.concatenate([x, rows[c][kept].astype(np.int64)]) for c, x in self.rows.items()}
        order = np.lexsort((both["key"], both["id"], both["absent"], -both["score"], both["slot"]))
        slot = both["slot"][order]
        begins = np.flatnonzero(np.diff(slot, prepend=-1))
        rank = np.arange(len(slot)) - np.repeat(begins, np.diff(np.append(begins, len(slot))))
        order, rank = order[rank < self.count], rank[rank < self.count]
        self.rows = {c: x[order] for c, x in both.items()}
        full = rank == self.count - 1
        at, score = self.rows["slot"][full], self.rows["score"][full]
        self.floor[at] = np.maximum(self.floor[at], score)


def _exact(a: Turned, b: Turned, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whole-number products of pairs."""
    top = float(a.lengths.max()) * float(b.lengths.max()) if len(i) else 0.0
    if top >= 2.0**56:
        raise TooLarge("products of vectors must fit 56 bits")
    if 8 * len(i) > len(a) * len(b) and top < 2.0**52:  # sums of whole numbers below 2^53 are exact
        return (a.floats @ b.floats.T)[i, j].astype(np.int64)
    out = np.empty(len(i), np.int64)
    for k in range(0, len(i), PAIRS):
        np.einsum("nd,nd->n", a.values[i[k : k + PAIRS]], b.values[j[k : k + PAIRS]], out=out[k : k + PAIRS])
    return out


def candidates(a: Turned, b: Turned, allowed: np.ndarray, low: np.ndarray, high: np.ndarray | None, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of anchors and rows that may be among the best, with their scores. low[i, s], high[i, s]: the scores that slot s
    of anchor i takes (high None: all from low on)."""
    slack = SLACK * max(1, b.turned.shape[1]) * np.multiply.outer(a.lengths, b.lengths) + 1e-9
    partial, past, alive = np.zeros((len(a), len(b))), 0, allowed
    least = low.astype(np.float64)
    most = None if high is None else high.max(1).astype(np.float64)
    for k, cut in enumerate(a.cuts):
        partial += a.turned[:, past:cut] @ b.turned[:, past:cut].T
        past = cut
        room = np.multiply.outer(a.rest[k], b.rest[k]) + slack
        above, below = partial + room, partial - room
        bar = np.empty_like(least)
        for s in range(least.shape[1]):
            sure = alive & (below >= least[:, s, None])
            if high is not None:
                sure &= above <= high[:, s, None]
            bar[:, s] = least[:, s]
            rows = np.flatnonzero(sure.sum(1) >= count)
            if len(rows):
                bounds = np.where(sure[rows], below[rows], -np.inf)
                bar[rows, s] = np.maximum(bar[rows, s], np.partition(bounds, -count, axis=1)[:, -count])
        alive = alive & (above >= bar.min(1)[:, None])
        if most is not None:
            alive &= below <= most[:, None]
        if not alive.any():
            break
    i, j = np.nonzero(alive)
    return i, j, _exact(a, b, i, j)


def _search(pairs: DataFrame, axes: np.ndarray, slots: int, count: int, negatives: bool) -> DataFrame:
    """The best rows of every slot of the anchors of every pair of blocks, of each task's pairs together. pairs has the columns of a
    block of anchors, their `scores` (slots for each anchor), and those of a block of rows."""
    sent = pairs.sparkSession.sparkContext.broadcast(axes)
    width = len(BLOCK.split(", "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = sent.value
        seen: dict[tuple, tuple[Turned, Best, np.ndarray, np.ndarray | None]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                name = (batch.column(0)[i].as_py(), batch.column(4)[i].values[0].as_py())
                if name not in seen:
                    a, best = Turned(*unpacked(batch, i, len(axes)), axes), None
                    best = Best(len(a) * slots, count)
                    if negatives:
                        score = np.frombuffer(batch.column(width)[i].as_buffer(), "<i8").reshape(len(a), slots)
                        none = score == _LEAST
                        score = np.where(none, 0, score)
                        low = np.where(none, np.iinfo(np.int64).max, -(-BAND[0] * score // 100))
                        high = np.where(none, _LEAST, BAND[1] * score // 100)
                        best.floor[:] = low.reshape(-1)
                    else:
                        high = None
                    seen[name] = (a, best, high)
                a, best, high = seen[name]
                b = Turned(*unpacked(batch, i, len(axes), width + 1), axes)
                same = a.labels[:, None] == b.labels[None, :]
                allowed = ~same if negatives else same & (a.keys[:, None] != b.keys[None, :])
                low = best.floor.reshape(len(a), slots)
                at, row, score = candidates(a, b, allowed, low, high, count)
                for s in range(slots):
                    fits = slice(None) if high is None else score <= high[at, s]
                    best.add(slot=at[fits] * slots + s, score=score[fits], absent=b.absent[row[fits]], id=b.ids[row[fits]], key=b.keys[row[fits]])
        for a, best, _ in seen.values():
            r = best.rows
            anchor = r["slot"] // slots
            ids = pa.array(r["id"], mask=r["absent"].astype(bool))
            columns = [pa.array(a.keys[anchor]), pa.array(a.ids[anchor]), pa.array((r["slot"] % slots).astype(np.int32)), ids, pa.array(r["key"]), pa.array(r["score"])]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _FOUND.split(", ")])

    return pairs.mapInArrow(run, _FOUND)


def _best_of_all(found: DataFrame, count: int) -> DataFrame:
    order = Window.partitionBy("anchor_key", "slot").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def _anchor_blocks(anchors: DataFrame, parts: int) -> DataFrame:
    """Rows of key, id, label, components and scores, packed into blocks with a column `scores`; scores of missing slots are the
    least long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = max((len(x.as_buffer()) for x in batch.column(3)), default=0) // 8
            step = min(ANCHORS, max(1, BLOCK_BYTES // (8 * max(1, width))))
            for k in range(0, batch.num_rows, step):
                some = batch.slice(k, step)
                values = np.zeros((some.num_rows, width), np.int64)
                scores = np.full((some.num_rows, POSITIVES), _LEAST)
                for i, (body, found) in enumerate(zip(some.column(3), some.column(4).to_pylist())):
                    body = np.frombuffer(body.as_buffer(), "<i8")
                    values[i, : len(body)] = body
                    scores[i, : len(found)] = found
                block = packed(values, some.column(1), some.column(2), some.column(0))
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array([scores.astype("<i8").tobytes()], pa.binary())], [*block.schema.names, "scores"])

    return anchors.repartition(parts, "key").mapInArrow(run, f"{BLOCK}, scores binary")


def _anchors(rows: DataFrame, anchor: Column) -> DataFrame:
    """The anchors among rows in blocks: key, id, label, components and empty scores. `anchor` is a condition on `id`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels, keys, values = unpacked(batch, i, 0)
                yield pa.RecordBatch.from_arrays([keys, ids, labels, pa.array([v.tobytes() for v in values], pa.binary())], ["key", "id", "label", "components"])

    found = rows.mapInArrow(run, "key long, id long, label long, components binary")
    return found.where(anchor).withColumn("scores", F.array().cast("array<long>"))


def _paired(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Every block of anchors beside every block of rows."""
    return anchors.crossJoin(rows.select(*[F.col(c).alias(f"row_{c}") for c in rows.columns]))


def mine(
    embeddings: DataFrame, anchor: Column, label: Column, vector: str = "embedding", vec_id: str = "vec_id",
    positives: int = POSITIVES, negatives: int = NEGATIVES, scale: float = SCALE, sample: int = SAMPLE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score. `anchor` is a condition on a column `id`, the
    vec_id; `label` an expression over the table's columns. At most POSITIVES positives."""
    if not 0 < positives <= POSITIVES:
        raise ValueError(f"positives must be 1 to {POSITIVES}")
    (own,) = fresh(embeddings, "_label")
    keyed, key = with_row_key(embeddings.withColumn(own, label.cast("long")), vec_id)
    rows = stage(blocks(keyed.where(F.col(own).isNotNull()), scale, vector, F.col(vec_id), F.col(own), F.col(key)), "vector-blocks")
    longest = rows.agg(F.max("dim")).first()[0] or 0
    axes = rotation(embeddings, vector, vec_id, longest, scale, sample)
    anchors = stage(_anchors(rows, anchor), "anchors")
    parts = max(1, -(-anchors.count() // (4 * ANCHORS)))
    near = _search(_paired(_anchor_blocks(anchors, parts), rows), axes, 1, positives, False)
    near = stage(_best_of_all(stage(near, "positives"), positives), "positives")
    listed = near.groupBy(F.col("anchor_key").alias("key")).agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("found"))
    asked = anchors.drop("scores").join(listed, "key").withColumn("scores", F.col("found.score")).drop("found")
    asked = stage(_anchor_blocks(asked, parts), "anchors")
    far = _best_of_all(stage(_search(_paired(asked, rows), axes, POSITIVES, negatives, True), "negatives"), negatives)
    near = near.select("anchor_key", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    far = far.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).drop("key")
    return far.join(near, ["anchor_key", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
