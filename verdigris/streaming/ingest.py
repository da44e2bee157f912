"""An extension: files that keep arriving, upserted micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.validate import newest
from ..sources.versioned import VersionedTable


def upsert_stream(rows: DataFrame, table: VersionedTable, keys: Sequence[str], newest_first: Sequence[str], prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataStreamWriter:
    """A writer that merges every micro-batch into the table, the newest row of each key first. A batch that is
    replayed after a failure changes nothing."""

    def merge(batch: DataFrame, batch_number: int) -> None:
        batch = prepare(batch) if prepare else batch
        tie = [c for c in batch.columns if c not in (*keys, *newest_first)]
        table.merge(newest(batch, keys, newest_first, tie), keys, skip_unchanged=True)

    return rows.writeStream.foreachBatch(merge)
