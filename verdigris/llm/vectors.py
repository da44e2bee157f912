"""Vectors as whole numbers, in blocks of rows: what the vector operators share.

A block is one row: the ids and labels of its rows as arrays, and their components floor(scale * x) as little-endian 64-bit numbers,
row by row, filled up with zeros to the block's longest vector. A block holds about BLOCK_BYTES of components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
BLOCK = "n long, dim long, ids array<long>, labels array<long>, keys array<long>, components binary"


class TooLarge(ValueError):
    """Components whose whole numbers or sums do not fit."""


def whole(rows: pa.ListArray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a vector of finite components, and their floor(scale * x), with zeros after short vectors."""
    lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = rows.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(rows)), lengths)
    good = rows.is_valid().to_numpy(zero_copy_only=False)
    good[of[~np.isfinite(flat)]] = False
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(scale * flat)
    of_good = good[of]
    if (np.abs(values[of_good]) >= 2.0**53).any():
        raise TooLarge(f"components times {scale} must be below 2^53")
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row = np.cumsum(good) - 1
    out = np.zeros((int(good.sum()), int(lengths[good].max(initial=0))), np.int64)
    out[row[of[of_good]], place[of_good]] = values[of_good].astype(np.int64)
    return good, out


def blocks(rows: DataFrame, scale: float, vector: str, vec_id: Column, label: Column, key: Column | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows with a vector of finite components in blocks. keys tell rows apart that repeat an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, values = whole(batch.column(3), scale)
            kept = [batch.column(c).filter(pa.array(good)) for c in range(3)]
            step = max(1, block_bytes // (8 * max(1, values.shape[1])))
            for k in range(0, len(values), step):
                yield packed(values[k : k + step], *[c.slice(k, step) for c in kept])

    key = vec_id if key is None else key
    named = [vec_id.cast("long").alias("id"), label.cast("long").alias("label"), key.cast("long").alias("key")]
    return rows.select(*named, F.col(vector).cast("array<double>").alias("vector")).mapInArrow(run, BLOCK)


def packed(values: np.ndarray, ids: pa.Array, labels: pa.Array, keys: pa.Array) -> pa.RecordBatch:
    lists = [pa.array([c.to_pylist()], pa.list_(pa.int64())) for c in (ids, labels, keys)]
    body = pa.array([values.astype("<i8").tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([len(values)], pa.int64()), pa.array([values.shape[1]], pa.int64()), *lists, body], [f.split()[0] for f in BLOCK.split(", ")])


def unpacked(batch: pa.RecordBatch, i: int, dim: int, at: int = 0) -> tuple[pa.Array, pa.Array, pa.Array, np.ndarray]:
    """Ids, labels, keys and components, filled up with zeros to dim, of the batch's block i, whose columns begin at `at`."""
    n, own = batch.column(at)[i].as_py(), batch.column(at + 1)[i].as_py()
    values = np.frombuffer(batch.column(at + 5)[i].as_buffer(), "<i8").reshape(n, own)
    if own < dim:
        values = np.pad(values, ((0, 0), (0, dim - own)))
    return *(batch.column(at + c)[i].values for c in (2, 3, 4)), values


def known(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, 0 where null, and where they are null."""
    return pc.fill_null(array, 0).to_numpy(zero_copy_only=False), array.is_null().to_numpy(zero_copy_only=False)
