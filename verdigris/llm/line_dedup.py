"""Line deduplication over levelled sorted runs of line hashes.

A run is a sorted array of 128-bit line keys with the document that owns each. Documents come in batches;
a batch is merge-anti-joined with the runs of all levels, what is found there is lost to its earlier
owner, and what is new becomes a run of level 0. FANOUT runs of a level are compacted into one of the
next, so a key is looked up in O(log n) runs.

Inside a corpus the runs are built twice. First by every task over its own split of the documents, in whatever order
they come (an owner that turns out not to be the smallest is corrected): of a line that a third of all documents
share, one row per split is left. Then over what is left, dealt by key and sorted by it, where the runs of all
tasks merge as a stream that keeps one row. Over corpora that come one after the other (`LineStore`) the runs are tables, bucketed and
sorted by key, levelled and compacted in the same way.

A line's key is the line stripped of [\x20\x09-\x0D] and with A-Z lower-cased. Keys of MIN_CHARS code points
or more that occur in several documents stay in the document with the smallest doc_id only. Tasks return the row and
number of every lost line; the lines are then taken out by array functions, without Python.

Defined cases: a null or empty text is one empty line; a null doc_id comes after all others, and all rows
with a null doc_id are one document, as are rows that repeat a doc_id; rows stay one to one; a very long text is split whole, in one
task, and its lines count as any others; an empty table gives an empty table; columns named n_lines or n_dropped are replaced, all others stay whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_BYTES, fresh, nulls_last, release, stage, text_of, with_row_key

MIN_CHARS = 10
#: Runs of one level that are compacted into one of the next.
FANOUT = 4
#: Bytes of text whose lines are taken in as one batch.
BATCH_BYTES = 1 << 22
#: Rows of owners that one task merges, about.
PART_ROWS = 4_000_000

#: What becomes of a claim: it owns its line, has lost it, or goes the way of its document's first claim of that key.
OWNS, LOST, FOLLOWS = 0, 1, 2
_CLAIMS = "key binary, did long, row long, at int, fate int"
_PLACE = np.dtype([("row", "<i8"), ("at", "<i4")])


def line_key(line: bytes) -> bytes | None:
    """The 128-bit hash of a line's key; None where the key is too short to count."""
    key = line.strip(SPACE_BYTES).lower()  # of bytes: A-Z only
    if len(key) < 4 * MIN_CHARS and (len(key) < MIN_CHARS or len(key.decode("utf-8", "replace")) < MIN_CHARS):
        return None
    return xxhash.xxh3_128_digest(key)


class SortedRuns:
    """Line keys (16 bytes each), their owners and the places of the lines (row and line number), in levels of sorted runs."""

    def __init__(self, fanout: int = FANOUT) -> None:
        self.fanout = fanout
        self.levels: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []

    def entries(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for level in self.levels:
            yield from level

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for keys, docs, _ in self.entries():
            yield keys, docs

    def claim(self, keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take in a batch; returns the claims (key, doc) that are lost to a smaller doc."""
        keys, docs, _, fate = self.settle(keys, docs, np.zeros(len(keys), _PLACE))
        return keys[fate == LOST], docs[fate == LOST]

    def settle(self, keys: np.ndarray, docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Take in a batch; returns the claims that are lost, and those that follow another, as key, doc, place and fate."""
        order = np.lexsort((docs, keys))
        keys, docs, places = keys[order], docs[order], places[order]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        owner = np.cumsum(first) - 1
        own = [x[first] for x in (keys, docs, places)]
        beaten = docs != own[1][owner]
        again = ~beaten & ~first
        new = np.ones(len(keys), bool)  # a beaten document's first claim of a key
        new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
        out = [(keys[x], docs[x], places[x], np.full(np.count_nonzero(x), f)) for x, f in ((beaten & new, LOST), (again | beaten & ~new, FOLLOWS))]
        unknown = np.ones(len(own[0]), bool)
        for run in self.entries():
            at = np.minimum(np.searchsorted(run[0], own[0]), len(run[0]) - 1)
            hit = run[0][at] == own[0]
            unknown &= ~hit
            for mine, fate in ((hit & (run[1][at] < own[1]), LOST), (hit & (run[1][at] == own[1]), FOLLOWS)):
                out.append((*(x[mine] for x in own), np.full(np.count_nonzero(mine), fate)))
            sooner = hit & (run[1][at] > own[1])
            out.append((*(x[at[sooner]].copy() for x in run), np.full(np.count_nonzero(sooner), LOST)))
            for mine, theirs in zip(own[1:], run[1:]):
                theirs[at[sooner]] = mine[sooner]
        if unknown.any():
            self.push(*(x[unknown] for x in own))
        return tuple(np.concatenate(c) for c in zip(*out))

    def push(self, keys: np.ndarray, docs: np.ndarray, places: np.ndarray, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((keys, docs, places))
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            keys, docs, places = (np.concatenate(c) for c in zip(*full))
            order = np.argsort(keys, kind="stable")
            self.push(keys[order], docs[order], places[order], level + 1)


def _claims(keys: np.ndarray, docs: np.ndarray, places: np.ndarray, fate: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(keys), 50_000):
        k, d, p, f = (x[i : i + 50_000] for x in (keys, docs, places, fate))
        data = pa.py_buffer(np.ascontiguousarray(k).view(np.uint8))
        offsets = pa.py_buffer(np.arange(len(k) + 1, dtype=np.int32) * 16)
        binary = pa.Array.from_buffers(pa.binary(), len(k), [None, offsets, data])
        arrays = [binary, *(pa.array(np.ascontiguousarray(x)) for x in (d, p["row"], p["at"], f.astype(np.int32)))]
        yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _CLAIMS.split(", ")])


def _owners(runs: SortedRuns) -> Iterator[pa.RecordBatch]:
    for k, d, p in runs.entries():
        yield from _claims(k, d, p, np.full(len(k), OWNS))


def _pack(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), dtype="S16") if keys else np.empty(0, "S16")


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release(all_of_it=True)
    runs = SortedRuns()
    keys: list[bytes] = []
    docs: list[int] = []
    places: list[tuple[int, int]] = []
    size = 0
    for batch in batches:
        for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            body = text.as_buffer().to_pybytes()
            for at, line in enumerate(body.split(b"\n")):
                if key := line_key(line):
                    keys.append(key)
                    docs.append(doc)
                    places.append((row, at))
            size += len(body)
            if size > BATCH_BYTES and keys:
                yield from _claims(*runs.settle(_pack(keys), np.array(docs, np.int64), np.array(places, _PLACE)))
                keys, docs, places, size = [], [], [], 0
    if keys:
        yield from _claims(*runs.settle(_pack(keys), np.array(docs, np.int64), np.array(places, _PLACE)))
    yield from _owners(runs)
    del runs
    release()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fates of owners that come sorted by key, document and place: the runs of all tasks, merged as a stream. Nothing but
    the last row is kept from batch to batch."""
    key, owner, doc = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, docs = _pack(batch.column(0).to_pylist()), batch.column(1).to_numpy()
        places = np.empty(len(keys), _PLACE)
        places["row"], places["at"] = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        first = np.append(key is None or keys[0] != key, keys[1:] != keys[:-1])
        group = np.cumsum(first) - 1 + (not first[0])  # group 0 goes on from the batch before, if its key does
        owners = docs[first] if first[0] else np.append(owner, docs[first])
        anew = first | np.append(docs[0] != doc, docs[1:] != docs[:-1])
        fate = np.where(first, OWNS, np.where(anew & (docs != owners[group]), LOST, FOLLOWS))
        key, owner, doc = keys[-1], owners[-1], docs[-1]
        yield from _claims(keys, docs, places, fate)


def _claimed(rows: DataFrame, text: str) -> DataFrame:
    """The claims of rows (did, row, text): per key one owner, the others lost or following."""
    body = rows.select("did", "row", F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    local = stage(body.mapInArrow(_local, _CLAIMS), "line-claims")
    owners = local.where(F.col("fate") == OWNS).drop("fate")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-owners.count() // PART_ROWS))
    merged = owners.repartition(parts, "key").sortWithinPartitions("key", "did", "row", "at").mapInArrow(_merged, _CLAIMS)
    return local.where(F.col("fate") != OWNS).unionByName(stage(merged, "line-owners"))


def _known(found: DataFrame, runs: DataFrame | LineStore) -> DataFrame:
    """The claims after earlier corpora have taken the keys that their runs hold."""
    owners = stage(found.where(F.col("fate") == OWNS).drop("fate"), "line-own")
    held = runs.held(owners) if isinstance(runs, LineStore) else owners.join(runs.select("key"), "key", "left_semi")
    held = stage(held.select("key"), "line-held").withColumn("held", F.lit(True))
    settled = owners.join(held, "key", "left").withColumn("fate", F.when(F.col("held"), LOST).otherwise(OWNS)).drop("held")
    return stage(found.where(F.col("fate") != OWNS).unionByName(settled), "line-settled")


def _keyed_claims(docs: DataFrame, text: str, doc_id: str, runs: DataFrame | LineStore | None) -> tuple[DataFrame, str, DataFrame]:
    """docs with a row key, its name, and the claims."""
    docs, row = with_row_key(docs, doc_id)
    did = F.col(doc_id).cast("long") if row == doc_id else nulls_last(docs, doc_id)
    found = _claimed(docs.select(did.alias("did"), F.col(row).cast("long").alias("row"), F.col(text).alias("text")), "text")
    return docs, row, found if runs is None else _known(found, runs)


def claims(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", runs: DataFrame | LineStore | None = None) -> DataFrame:
    """(key, did, row, at, fate) of every line that may be lost: did is doc_id with nulls last, row the row's key
    (doc_id where that is unique) and at the line's number. Keys of `runs` (a table with the column key, or a store) belong to
    earlier corpora, which precede all of docs."""
    return _keyed_claims(docs, text, doc_id, runs)[2]


def new_run(claimed: DataFrame) -> DataFrame:
    """The run to keep for the next corpus: every key with its owner."""
    return claimed.where(F.col("fate") == OWNS).select("key", "did")


def lost_lines(claimed: DataFrame) -> DataFrame:
    """(row, at) of every lost line, those of documents that hold a lost line several times included."""
    lost = claimed.where(F.col("fate") == LOST)
    later = claimed.where(F.col("fate") == FOLLOWS).join(lost.select("key", "did"), ["key", "did"], "left_semi")
    return lost.select("row", "at").unionByName(later.select("row", "at"))


def drop_lost(docs: DataFrame, claimed: DataFrame, text: str, row: str) -> DataFrame:
    """docs without the lost lines, and n_lines (before) and n_dropped. Lines are taken out by their numbers, with hash
    sets, so the cost is that of the document's lines however many are lost."""
    docs = docs.drop(*[c for c in ("n_lines", "n_dropped") if c != text])
    key, gone = fresh(docs, "_lost_row", "_lost_at")
    lost = lost_lines(claimed).groupBy(F.col("row").alias(key)).agg(F.collect_list("at").alias(gone))
    out = docs.join(lost, docs[row] == lost[key], "left")
    body = text_of(out, text)
    lines = F.split(body, "\n", -1)
    n = F.size(lines)
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col(gone))
    # The array of one struct binds the lines once; written into the inner function they would be split again for each.
    once = F.array(F.struct(lines.alias("lines"), kept.alias("kept")))
    rest = F.get(F.transform(once, lambda s: F.array_join(F.transform(s["kept"], lambda i: F.get(s["lines"], i)), "\n")), F.lit(0))
    columns = [F.when(F.col(gone).isNull(), body).otherwise(rest).alias(c) if c == text else docs[c] for c in docs.columns]
    dropped = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone))
    return out.select(*columns, n.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", runs: DataFrame | LineStore | None = None) -> DataFrame:
    """docs with the lost lines taken out of the text, and n_lines (before) and n_dropped."""
    columns = [c for c in docs.columns if c == text or c not in ("n_lines", "n_dropped")]
    keyed, row, claimed = _keyed_claims(docs, text, doc_id, runs)
    return drop_lost(keyed, claimed, text, row).select(*columns, "n_lines", "n_dropped")


class LineStore:
    """The line keys of all corpora so far, as levelled runs: tables `<name>_l<level>_<id>`, bucketed and sorted by key.

    A new corpus is anti-joined with every run; its keys alone are shuffled, the runs lie as the join needs them. Its new
    keys become a run of level 0, and `fanout` runs of a level are compacted into one of the next. A writer that is lost
    after it wrote a compacted run leaves keys in two runs, which changes no result.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64, fanout: int = FANOUT) -> None:
        self.spark, self.name, self.buckets, self.fanout = spark, name, buckets, fanout

    def levels(self) -> dict[int, list[str]]:
        schema, _, short = self.name.rpartition(".")
        out: dict[int, list[str]] = {}
        for table in self.spark.catalog.listTables(schema or None, f"{short}_l*"):
            level = table.name[len(short) + 2 :].split("_")[0]
            if level.isdigit():
                out.setdefault(int(level), []).append(f"{schema}.{table.name}" if schema else table.name)
        return out

    def held(self, claimed: DataFrame) -> DataFrame:
        """Those rows of claimed whose key a run holds."""
        keys = claimed.repartition(self.buckets, "key")
        parts = [keys.join(self.spark.table(t).hint("merge"), "key", "left_semi") for ts in self.levels().values() for t in ts]
        return reduce(DataFrame.unionByName, parts) if parts else claimed.limit(0)

    def _write(self, keys: DataFrame, level: int) -> None:
        dealt = keys.select("key").repartition(self.buckets, "key")
        dealt.write.format("parquet").bucketBy(self.buckets, "key").sortBy("key").saveAsTable(f"{self.name}_l{level}_{uuid.uuid4().hex[:12]}")

    def add(self, keys: DataFrame) -> None:
        """A new run of keys that no run holds yet; full levels are compacted."""
        self._write(keys, 0)
        level = 0
        while len(full := self.levels().get(level, [])) >= self.fanout:
            self._write(reduce(DataFrame.unionByName, [self.spark.table(t) for t in full]).distinct(), level + 1)
            for table in full:
                self.spark.sql(f"DROP TABLE {table}")
            level += 1

    def dedup(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """`dedup_lines` of the next corpus against all before; its own lines are in the store afterwards."""
        columns = [c for c in docs.columns if c == text or c not in ("n_lines", "n_dropped")]
        keyed, row, claimed = _keyed_claims(docs, text, doc_id, self)
        out = stage(drop_lost(keyed, claimed, text, row).select(*columns, "n_lines", "n_dropped"), "line-kept")
        self.add(new_run(claimed))
        return out
