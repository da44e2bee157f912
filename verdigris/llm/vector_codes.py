"""Vector code compression: every vector as eight indexes into codebooks, found through trees of codebook entries.

Vectors are cut into PARTS equal parts; a part's code is the index of the nearest of its position's ENTRIES codebook entries
(squared Euclidean distance over whole numbers, the lower index of equals). Codebooks start as the parts of the first vectors by id and
are replaced by the floored means of what they are assigned, ROUNDS times.

The entries of a position stand in a vantage-point tree: a node is an entry; of the others, those not farther from it than
their median are inside, the rest outside. A search takes the nearer side first and leaves a side out only if the triangle
inequality puts all of it farther away than the best entry so far. Distances that bound are square roots rounded away from the
decision, sides at exactly the best distance are visited, and distances that decide are whole numbers, so codes are exact.

A round is one pass over the rows: every task sums counts and components by entry, the sums of all tasks meet by entry, and
only codebooks, whose size doesn't depend on the rows, come to the driver. Blocks of rows are written once and read again
every round.

Defined cases: a row without a vector, or with a null or non-finite component, is dropped; vectors shorter than the longest, or
whose length is no multiple of the number of parts, are filled up with zeros; fewer rows than entries make fewer entries; rows
that repeat a vec_id are rows of their own, ordered by components; null vec_ids come last; a null label is a label of its own;
an empty table gives no rows; sums that don't fit 63 bits are an error; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .vectors import TooLarge, blocks, known, unpacked

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096.0
#: Rows that a task assigns together.
TOGETHER = 1 << 15
_UP, _DOWN = 1 + 2.0**-50, 1 - 2.0**-50


@dataclass
class Node:
    """An entry, and the other entries of its subtree by their distance from it."""

    index: int
    entry: np.ndarray
    #: No inside entry is farther, no outside entry nearer.
    inner: float = 0.0
    outer: float = 0.0
    inside: Node | None = None
    outside: Node | None = None


def tree(entries: np.ndarray, of: np.ndarray | None = None) -> Node | None:
    """The vantage-point tree of the entries: a node's entry is the one farthest from the mean of its own."""
    of = np.arange(len(entries)) if of is None else of
    if not len(of):
        return None
    spread = entries[of] - entries[of].mean(0)
    at = int((spread**2).sum(1).argmax())
    node, rest = Node(int(of[at]), entries[of[at]]), np.delete(of, at)
    if len(rest):
        d2 = ((entries[rest] - node.entry) ** 2).sum(1)
        near = d2 <= np.partition(d2, (len(rest) - 1) // 2)[(len(rest) - 1) // 2]
        node.inner = float(np.sqrt(d2[near].max())) * _UP
        node.outer = float(np.sqrt(d2[~near].min(initial=d2.max()))) * _DOWN
        node.inside, node.outside = tree(entries, rest[near]), tree(entries, rest[~near])
    return node


def nearest(root: Node, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every part the index of its nearest entry and the squared distance, and how many distances that took."""
    best, code = np.full(len(parts), np.iinfo(np.int64).max), np.full(len(parts), np.iinfo(np.int64).max)
    made = 0

    def visit(node: Node, rows: np.ndarray) -> None:
        nonlocal made
        made += len(rows)
        d2 = ((parts[rows] - node.entry) ** 2).sum(1)
        better = (d2 < best[rows]) | ((d2 == best[rows]) & (node.index < code[rows]))
        best[rows[better]], code[rows[better]] = d2[better], node.index
        if node.inside is None:
            return
        d = np.sqrt(d2.astype(np.float64))
        near = d <= node.inner
        for first in (True, False):
            mine, far = rows[near == first], d[near == first]
            for inside in (first, not first):
                side = node.inside if inside else node.outside
                if side is None or not len(mine):
                    continue
                least = far * _DOWN - node.inner if inside else node.outer - far * _UP
                open_ = least <= np.sqrt(best[mine].astype(np.float64)) * _UP
                if open_.any():
                    visit(side, mine[open_])

    visit(root, np.arange(len(parts)))
    return code, best, made


@dataclass(frozen=True)
class Codebooks:
    """entries[p] are the entries of part position p."""

    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()

    def assign(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes and squared distances, a column for each part."""
        count, _, width = self.entries.shape
        parts = values.reshape(len(values), count, width)
        if (np.abs(values).max(initial=0) + np.abs(self.entries).max(initial=0)) ** 2 * max(1, values.shape[1]) >= 2.0**62:
            raise TooLarge("squared distances must fit 62 bits")
        code, error = np.empty((len(values), count), np.int64), np.empty((len(values), count), np.int64)
        for p in range(count):
            code[:, p], error[:, p], _ = nearest(tree(self.entries[p]), np.ascontiguousarray(parts[:, p]))
        return code, error


def _together(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Ids, labels and components of about TOGETHER rows at a time."""
    held: list[tuple] = []
    for batch in batches:
        for i in range(batch.num_rows):
            ids, labels, _, values = unpacked(batch, i, dim)
            held.append((ids, labels, values))
            if sum(len(x[0]) for x in held) >= TOGETHER:
                yield tuple(f([x[c] for x in held]) for c, f in enumerate((pa.concat_arrays, pa.concat_arrays, np.concatenate)))
                held = []
    if held:
        yield tuple(f([x[c] for x in held]) for c, f in enumerate((pa.concat_arrays, pa.concat_arrays, np.concatenate)))


def first_vectors(rows: DataFrame, dim: int, count: int) -> np.ndarray:
    """The components of the first rows by id."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, values in _together(batches, dim):
            at, none = known(ids)
            rank = np.where(none, np.iinfo(np.int64).max, at)
            small = np.flatnonzero(rank <= np.partition(rank, min(count, len(rank)) - 1)[min(count, len(rank)) - 1])
            order = small[np.lexsort((*values[small].T[::-1], at[small], none[small]))][:count]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(order)), pa.array(list(values[order]), pa.list_(pa.int64()))], ["id", "components"])

    found = rows.mapInArrow(some, "id long, components array<long>")
    found = found.orderBy(F.col("id").asc_nulls_last(), "components").limit(count).collect()
    return np.array([r.components for r in found], np.int64).reshape(len(found), dim)


def refined(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every entry becomes the floored mean of the parts that are nearest to it; unused entries stay."""
    count, entries, width = books.entries.shape
    dim = count * width

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(count * entries, np.int64), np.zeros((count * entries, width), np.int64)
        room = 2**62
        for _, _, values in _together(batches, dim):
            code, _ = books.assign(values)
            room -= int(np.abs(values).max(initial=0)) * len(values)
            if room < 0:
                raise TooLarge("sums of components must fit 62 bits")
            slot = (code + np.arange(count) * entries).reshape(-1)
            n += np.bincount(slot, minlength=len(n))
            order = np.argsort(slot, kind="stable")
            starts = np.flatnonzero(np.diff(slot[order], prepend=-1))
            s[slot[order][starts]] += np.add.reduceat(values.reshape(-1, width)[order], starts, axis=0)
        used = np.flatnonzero(n)
        slots, place = np.repeat(used, width), np.tile(np.arange(width), len(used))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (slots, place, n[slots], s[slots, place])], ["slot", "place", "n", "s"])

    found = rows.mapInArrow(sums, "slot long, place long, n long, s long").groupBy("slot", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = books.entries.reshape(count * entries, width).copy()
    for r in found.collect():  # one row for each component of the codebooks
        out[r.slot, r.place] = r.s // r.n
    return Codebooks(out.reshape(count, entries, width))


def train(rows: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of all rows, given in blocks."""
    first = first_vectors(rows, dim, entries)
    books = Codebooks(first.reshape(len(first), parts, dim // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        books = refined(rows, books)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """One row per vector, given in blocks: vec_id, label, code and error."""
    dim = books.entries.shape[0] * books.entries.shape[2]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, values in _together(batches, dim):
            code, error = books.assign(values)
            hexed = pa.array([c.tobytes().hex() for c in code.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays([ids, labels, hexed, pa.array(error.sum(1))], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(coded, "vec_id long, label long, code string, error long")


def compress(
    embeddings: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE,
) -> tuple[DataFrame, Codebooks]:
    """vec_id, label, code (two hex digits a part), error and label_error (of all rows with that label); and the codebooks. Entries
    are at most 256."""
    rows = stage(blocks(embeddings, scale, vector, F.col(vec_id), F.col(label)), "vector-blocks")
    longest = rows.agg(F.max("dim")).first()[0] or 0
    books = train(rows, max(1, -(-longest // parts)) * parts, parts, entries, rounds)
    coded = stage(encode(rows, books), "vector-codes")
    per = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    found = coded.join(per, F.col("label").eqNullSafe(F.col("_label")), "left")
    return found.select("vec_id", "label", "code", "error", "label_error"), books
