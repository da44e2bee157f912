"""Repeated byte strings, found by suffix order.

A string of MIN_BYTES bytes is repeated if it also starts elsewhere in the corpus. Suffixes that can match are
brought together first: of all GRAM-byte grams of a window of MIN_BYTES bytes the one with the smallest hash is
the window's anchor, so equal windows have equal anchors at equal places. Neighbouring windows with one
anchor make a span; spans whose anchor's gram occurs once in the corpus cannot repeat and go no further,
and equal spans are counted and stand for each other.

Where a gram has different spans, a task puts these, in corpus order, into one text and builds the array of longest
previous factors of its windows: windows in suffix order (doubling the compared length up to MIN_BYTES), the common
lengths of neighbours, and of every window the nearest ones with smaller position before and after it in that order; the longer
common length with these two is the longest previous factor, and the position it is with is the earlier match. A window
whose factor reaches MIN_BYTES is a later copy: `keep="first"` removes it. With its earlier match, and that one's, it makes up all
copies: `keep="none"` removes them too.

Results hold the union of the removed windows, judged on the input.

Defined cases: a null text is empty and keeps nothing; texts shorter than MIN_BYTES stay; rows that repeat a
doc_id (or have none) are documents of their own, in the order of a row number; matches never cross
documents; an empty table gives no rows; other columns do not matter; a very long text is cut into overlapping parts without a
loss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, text_of, with_row_key

MIN_BYTES = 200
#: Bytes of a gram: 32 + 16.
GRAM = 48
#: Bytes that are hashed at once; a place in them takes PLACE_BITS.
SLICE, PLACE_BITS = 1 << 18, 20
#: Rounds in which nearest smaller positions are looked for together.
ROUNDS = 48
#: Bytes of spans that one suffix array is built over, unless one gram has more.
ARRAY_BYTES = 1 << 20

_ANCHORS = "did long, pos long, kh long, sh long"
_SPANS = "kh long, sh long, did long, pos long, n long, bytes binary"
_VERDICTS = "kh long, sh long, earlier array<int>, `any` array<int>"

_rng = np.random.default_rng(20_11)
_TABLE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 64, 8, dtype=np.uint64) | np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at every place, by doubling."""
    h, step = _TABLE[data], 1
    halves = {}
    for k in range(5):
        h = h[:-step] * _ODD[k] + h[step:]
        step *= 2
        halves[step] = h
    h = halves[32][: len(data) - GRAM + 1] * _ODD[5] + halves[16][32:]
    h ^= h >> np.uint64(31)
    h *= _ODD[6]
    return h ^ (h >> np.uint64(29))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[j : j + w]) for all j: minima from the left and from the right of blocks of w."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    blocks = full.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def spans(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place, number of windows, gram hash and span hash of the spans of documents that lie at
    starts..ends of data and have MIN_BYTES bytes or more."""
    grams = gram_hashes(np.frombuffer(data, np.uint8))
    low = np.uint64((1 << PLACE_BITS) - 1)
    ranked = grams & ~low | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(ranked, MIN_BYTES - GRAM + 1)
    n_windows = ends - starts - MIN_BYTES + 1
    first = np.concatenate(([0], np.cumsum(n_windows)[:-1]))
    windows = np.arange(n_windows.sum()) + np.repeat(starts - first, n_windows)
    chosen = least[windows]
    at = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    place, length = windows[at], np.diff(np.concatenate((at, [len(chosen)])))
    anchor = (chosen[at] & low).astype(np.int64)
    digest = xxhash.xxh3_64_intdigest
    hashed = [digest(data[p : p + n + MIN_BYTES - 1], a - p) for p, n, a in zip(place.tolist(), length.tolist(), anchor.tolist())]
    return place, length, grams[anchor].view(np.int64), np.array(hashed, np.uint64).view(np.int64)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list[tuple[int, int]], list[bytes]]]:
    """Documents, cut where they are long so that no window is lost, in portions of about SLICE bytes:
    (doc, place in the document) and bytes."""
    heads: list[tuple[int, int]] = []
    parts: list[bytes] = []
    size = 0
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        body = text.as_buffer().to_pybytes()
        for i in range(0, len(body) - MIN_BYTES + 1, SLICE):
            part = body[i : i + SLICE + MIN_BYTES - 1]
            heads.append((doc, i))
            parts.append(part)
            size += len(part)
            if size >= SLICE:
                yield heads, parts
                heads, parts, size = [], [], 0
    if parts:
        yield heads, parts


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for heads, parts in _slices(batch):
            ends = np.cumsum([len(p) for p in parts])
            starts = ends - [len(p) for p in parts]
            place, n, kh, sh = spans(b"".join(parts), starts, ends)
            row = np.searchsorted(ends, place, side="right")
            docs, offsets = (np.array(x, np.int64) for x in zip(*heads))
            pos = (place - starts[row] + offsets[row]) << 8 | n
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (docs[row], pos, kh, sh)], ["did", "pos", "kh", "sh"])


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _SPANS.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.binary()]
    for batch in batches:
        rows = []
        for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            body = text.as_buffer().to_pybytes()
            for s in wanted:
                at, n = s["pos"] >> 8, s["pos"] & 255
                rows.append((s["kh"], s["sh"], doc, s["pos"], s["n"], body[at : at + n + MIN_BYTES - 1]))
        columns = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def suffix_ranks(text: np.ndarray, length: int) -> dict[int, np.ndarray]:
    """By a number of bytes (8, doubled, `length` last): for every place a number that orders so many bytes there (fewer
    at the end: after it only zeros), equal for equal bytes."""
    padded = np.concatenate((text, np.zeros(length, np.uint8)))
    n = len(text) + length - 8
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | padded[k : k + n]
    rank, have = np.unique(words, return_inverse=True)[1].astype(np.uint64), 8
    ranks = {8: rank.astype(np.uint32)}
    while have < length:
        step = min(have, length - have)
        pairs = rank[:-step] << np.uint64(32) | rank[step:]
        rank, have = np.unique(pairs, return_inverse=True)[1].astype(np.uint64), have + step
        ranks[have] = rank.astype(np.uint32)
    return ranks


def common_lengths(text: np.ndarray, ranks: dict[int, np.ndarray], order: np.ndarray, length: int) -> np.ndarray:
    """Of every place in the order the length, at most `length`, that it has in common with the one before it; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    a, b = order[:-1], order[1:]
    whole = ranks[length][a] == ranks[length][b]
    out[1:][whole] = length
    rest = np.flatnonzero(~whole)
    a, b, common = a[rest], b[rest], np.zeros(len(rest), np.int64)
    for step in sorted((k for k in ranks if k < length), reverse=True):
        fits = np.maximum(a, b) + common + step <= len(text)
        same = np.zeros(len(rest), bool)
        same[fits] = ranks[step][(a + common)[fits]] == ranks[step][(b + common)[fits]]
        common += step * same
    for _ in range(7):
        at = np.maximum(a, b) + common < len(text)
        same = np.zeros(len(rest), bool)
        same[at] = text[(a + common)[at]] == text[(b + common)[at]]
        if not same.any():
            break
        # A byte counts only if all before it did: where one differs, it goes on differing.
        common += same
    out[1 + rest] = np.minimum(common, length)
    return out


def nearest_smaller(values: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every element the index of the nearest smaller one before it (-1: none), and the smallest `common` on the way
    there: what the two have in common. Candidates are jumped over together; all between an element and its candidate are
    larger, so a candidate's own candidate is the next one to try. What is still open after ROUNDS rounds, as after long
    rising runs, is done by a stack."""
    n = len(values)
    at, least = np.arange(n) - 1, common.copy()
    open_ = np.arange(1, n)
    for _ in range(ROUNDS):
        c = at[open_]
        open_, c = (x[(c >= 0) & (values[c] > values[open_])] for x in (open_, c))
        if not len(open_):
            break
        jumped, shortest = at[c], np.minimum(least[open_], least[c])
        at[open_], least[open_] = jumped, shortest
    else:
        stack: list[int] = []
        rows, lengths, to, low = values.tolist(), common.tolist(), [0] * n, [0] * n
        for i in range(n):
            shortest = lengths[i]
            while stack and rows[stack[-1]] > rows[i]:
                shortest = min(shortest, low[stack.pop()])
            to[i], low[i] = stack[-1] if stack else -1, shortest
            stack.append(i)
        at, least = np.array(to, np.int64), np.array(low, np.int64)
    least[at < 0] = 0
    return at, least


def previous_factors(text: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the ascending places the longest string, of at most `length` bytes, that starts there and at an earlier one
    of them: its length and the index of that earlier place (-1: none)."""
    ranks = suffix_ranks(text, length)
    index = np.argsort(ranks[length][places], kind="stable")  # of equals in the order of places
    common = common_lengths(text, ranks, places[index], length)
    before, with_before = nearest_smaller(index, common)
    turned = np.zeros(len(index), np.int64)
    turned[1:] = common[1:][::-1]
    after, with_after = nearest_smaller(index[::-1], turned)
    after, with_after = np.where(after < 0, -1, len(index) - 1 - after)[::-1], with_after[::-1]
    take = with_before >= with_after
    factor, match = np.where(take, with_before, with_after), np.where(take, before, after)
    lengths, earlier = np.empty(len(index), np.int64), np.empty(len(index), np.int64)
    lengths[index] = factor
    earlier[index] = np.where(factor > 0, index[match], -1)
    return lengths, earlier


def longest_previous_factors(text: bytes) -> list[int]:
    """For every place the length of the longest string that starts there and also at an earlier place."""
    data = np.frombuffer(text, np.uint8)
    return previous_factors(data, np.arange(len(data)), max(8, len(data)))[0].tolist()


def _runs(flags: np.ndarray) -> list[int]:
    """[first, last, first, last, ...] of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    edges[1::2] -= 1
    return edges.tolist()


def _judge(rows: list[tuple]) -> pa.RecordBatch:
    """Verdicts on spans in corpus order, gram by gram."""
    sizes = np.array([len(r[5]) for r in rows])
    begin = np.cumsum(sizes) - sizes
    n_windows = sizes - MIN_BYTES + 1
    first = np.cumsum(n_windows) - n_windows
    places = np.arange(n_windows.sum()) + np.repeat(begin - first, n_windows)
    lengths, earlier = previous_factors(np.frombuffer(b"".join(r[5] for r in rows), np.uint8), places, MIN_BYTES)
    previous = lengths >= MIN_BYTES
    copies = previous.copy()
    copies[earlier[previous]] = True
    out: list[tuple] = []
    for (kh, sh, _, _, n, _), a, w in zip(rows, first.tolist(), n_windows.tolist()):
        before = previous[a : a + w]
        either = np.ones(w, bool) if n > 1 else copies[a : a + w]
        if either.any():
            out.append((kh, sh, _runs(before), _runs(either)))
    columns = list(zip(*out)) or [()] * 4
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["kh", "sh", "earlier", "any"])


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if size >= ARRAY_BYTES and row[0] != rows[-1][0]:
                yield _judge(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[5])
    if rows:
        yield _judge(rows)


def _cut(text: pa.Array, gone: pa.Array) -> pa.Array:
    kept, n_bytes, n_removed, n_spans = [], [], [], []
    for x, ranges in zip(text, gone.to_pylist()):
        body = x.as_buffer().to_pybytes()
        parts, at, removed, runs = [], 0, 0, 0
        for r in sorted((r["a"], r["b"]) for r in ranges or ()):
            if r[0] > at or not runs:
                parts.append(body[at : r[0]])
                runs += 1
                removed += r[1] - r[0]
                at = r[1]
            elif r[1] > at:
                removed += r[1] - at
                at = r[1]
        parts.append(body[at:])
        kept.append(b"".join(parts))
        n_bytes.append(len(body))
        n_removed.append(removed)
        n_spans.append(runs)
    arrays = [pa.array(kept, pa.binary()), *(pa.array(c, pa.int64()) for c in (n_bytes, n_removed, n_spans))]
    return pa.StructArray.from_arrays(arrays, ["kept", "n_bytes", "n_removed", "n_spans"])


def repeated_ranges(body: DataFrame, keep: str = "none") -> DataFrame:
    """(did, a, b): byte ranges a..b to remove, which may overlap, of rows (did, text) with distinct did."""
    anchors = stage(body.select("did", F.col("text").cast("binary").alias("text")).mapInArrow(_anchors, _ANCHORS), "suffix-anchors")
    shared = stage(anchors.groupBy("kh").count().where("count > 1").select("kh"), "suffix-grams")
    anchors = stage(anchors.join(shared, "kh", "left_semi"), "suffix-candidates")
    groups = anchors.groupBy("kh", "sh").agg(F.count("*").alias("n"), F.min(F.struct("did", "pos")).alias("ex"))
    groups = stage(groups.select("kh", "sh", "n", "ex.did", "ex.pos"), "suffix-spans")
    several = stage(groups.groupBy("kh").count().where("count > 1").select("kh"), "suffix-several")
    wanted = groups.join(several, "kh", "left_semi").groupBy("did").agg(F.collect_list(F.struct("kh", "sh", "pos", "n")).alias("wanted"))
    fetched = body.join(wanted.withColumnRenamed("did", "_did"), F.col("did") == F.col("_did"))
    fetched = fetched.select("did", F.col("text").cast("binary").alias("text"), "wanted").mapInArrow(_wanted, _SPANS)
    judged = fetched.repartition("kh").sortWithinPartitions("kh", "did", "pos").mapInArrow(_verdicts, _VERDICTS)
    judged = stage(judged, "suffix-verdicts")
    whole = F.array(F.lit(0), (F.col("pos").bitwiseAND(F.lit(255)) - 1).cast("int"))
    alone = groups.join(several, "kh", "left_anti").select("kh", "sh", F.lit(None).cast("array<int>").alias("earlier"), whole.alias("any"))
    verdicts = alone.unionByName(judged)
    if keep == "first":
        verdicts = groups.select("kh", "sh", F.col("did").alias("xd"), F.col("pos").alias("xp")).join(verdicts, ["kh", "sh"])
        found = anchors.join(verdicts, ["kh", "sh"])
        is_first = (F.col("did") == F.col("xd")) & (F.col("pos") == F.col("xp"))
        found = found.withColumn("runs", F.when(is_first, F.coalesce("earlier", F.array().cast("array<int>"))).otherwise(whole))
    else:
        found = anchors.join(verdicts.select("kh", "sh", "any"), ["kh", "sh"]).withColumn("runs", F.col("any"))
    start = F.shiftright("pos", 8)
    run = lambda k: F.get("runs", F.col("i") + k).cast("long")
    found = found.where(F.size("runs") > 0).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2))))
    return found.select("did", (start + run(0)).alias("a"), (start + run(1) + MIN_BYTES).alias("b"))


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "none") -> DataFrame:
    """One row per document: doc_id, kept (its remaining bytes), n_bytes, n_removed and n_spans (removed
    runs)."""
    body = docs.select(F.col(doc_id).alias("doc_id"), text_of(docs, text).alias("text"))
    body, key = with_row_key(body, "doc_id")
    body = body.select("doc_id", "text", F.col(key).cast("long").alias("did"))
    ranges = repeated_ranges(body, keep).groupBy("did").agg(F.collect_list(F.struct("a", "b")).alias("_gone"))
    out = body.join(ranges.withColumnRenamed("did", "_did"), F.col("did") == F.col("_did"), "left")
    cut = F.arrow_udf(_cut, "struct<kept:binary,n_bytes:long,n_removed:long,n_spans:long>")
    out = out.withColumn("_cut", cut(F.col("text").cast("binary"), F.col("_gone")))
    return out.select("doc_id", "_cut.kept", "_cut.n_bytes", "_cut.n_removed", "_cut.n_spans")
