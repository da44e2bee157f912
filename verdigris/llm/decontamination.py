"""Benchmark decontamination by Wu-Manber search over words.

Every WINDOW consecutive words of a benchmark item are a test string; an item of fewer words is one test string. Texts are
searched for all of them at once. The alphabet is words: a block is the last two words before a position. The shift table says,
for a block's hash, how far the nearest test string can end after it, so most positions are never looked at: in a text that
shares no block with the benchmark every ninth word is. Where the shift is nothing, the block selects a bucket of test strings
that end with it, the hash of their first block thins it out, and what is left is compared word by word with the text.

Positions are taken in step for many stretches of text at once: a round looks up the shifts of all stretches and moves every
one by its own. Words are never hashed unless a position that is looked at needs them: a word's code is its last eight bytes and
its length, and only the comparison decides.

A text is read in pieces of about PIECE_BYTES, cut between words, with the last words of a piece before the next one, so memory is
bounded whatever a text's length; only one word longer than that makes a longer piece. The tables of a pass hold about PATTERN_WORDS
words; a larger benchmark is dealt over several passes by a hash, and their finds are joined by document. Items are cut too.

Defined cases: a null or empty text has no words; an item that is null or has no words has no test string; items that repeat an
item_id are one item; items without an item_id hit, but are neither counted nor listed; documents that repeat a doc_id are
documents of their own; an empty table of documents gives no rows, an empty benchmark hits nothing; other columns do not matter.
Of the columns of docs only doc_id is returned; `decontaminate` returns them all, with their own values.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, release, stage, with_row_key

#: Words of a test string.
WINDOW = 10
#: Words of a block.
BLOCK = 2
PIECE_BYTES = 1 << 20
#: Words of an item's piece, and words of the benchmark whose tables one pass broadcasts: some 60 MB.
ITEM_WORDS, PATTERN_WORDS = 4096, 1 << 20
#: Entries of a shift table, as a power of two.
SHIFT_BITS = 22
#: Positions of a stretch of text that is searched in step with others.
STRETCH = 270

#: Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased: in UTF-8 these bytes.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
NO_WORD = re.compile(rb"[^0-9a-zA-Z\x80-\xff]")
_IS_WORD = np.zeros(256, np.int8)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_PAD = 8

_SPAN = "array<struct<start: long, end: long>>"


class Words:
    """The words of pieces of lower-case text, end to end, by their bytes' places."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.data = b" " * _PAD + b" ".join(pieces) + b" "
        at = np.frombuffer(self.data, np.uint8)
        edges = np.flatnonzero(np.diff(_IS_WORD[at], prepend=np.int8(0)))
        self.starts, self.ends = edges[::2], edges[1::2]
        self._eight = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        places = _PAD + np.cumsum([0, *[len(p) + 1 for p in pieces]])
        #: Piece k has the words bounds[k] to bounds[k + 1].
        self.bounds = np.searchsorted(self.starts, places)

    def codes(self, at: np.ndarray) -> np.ndarray:
        """A number for each of the words: of their last eight bytes and their length."""
        n = self.ends[at] - self.starts[at]
        tail = self._eight[self.ends[at] - 8] >> (8 * (8 - np.minimum(n, 8))).astype(np.uint64)
        return _mixed(tail * np.uint64(0x9E3779B97F4A7C15) + n.astype(np.uint64))

    def blocks(self, at: np.ndarray, size: int) -> np.ndarray:
        """A number for each block of words that ends at one of the words."""
        out = self.codes(at)
        for k in range(1, size):
            out = _mixed(out * np.uint64(0xC2B2AE3D27D4EB4F) + self.codes(at - k))
        return out

    def text(self, first: int, last: int) -> bytes:
        return self.data[self.starts[first] : self.ends[last]]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


@dataclass(frozen=True)
class Table:
    """Test strings of one length. Buckets hold them by their last block: bucket k those from starts[k] to starts[k + 1]."""

    length: int
    shifts: np.ndarray
    blocks: np.ndarray
    starts: np.ndarray
    prefixes: np.ndarray
    #: Where a test string is in the text of all items, and its item.
    begin: np.ndarray
    end: np.ndarray
    items: np.ndarray
    text: bytes

    @property
    def block(self) -> int:
        return min(BLOCK, self.length)


def tables(items: list[tuple[str | None, str]], window: int = WINDOW, bits: int = SHIFT_BITS) -> list[Table]:
    """The tables of items, given as pieces of (item_id, words joined by a blank): one of the windows, and one for each
    length of shorter items."""
    words = Words([t.encode() for _, t in items])
    first, past = words.bounds[:-1], words.bounds[1:]
    counts = past - first
    out = []
    for length in sorted({min(window, int(n)) for n in counts if n}):
        mine = np.flatnonzero(counts >= window if length == window else counts == length)
        n = counts[mine] - length + 1
        item = np.repeat(mine, n)
        begin = np.repeat(first[mine], n) + _running(n)
        last = begin + length - 1
        size = min(BLOCK, length)
        shifts = np.full(1 << bits if length == window else 1 << 16, length - size + 1, np.uint8 if length < 255 else np.int64)
        mask = np.uint64(len(shifts) - 1)
        for j in range(size - 1, length):
            np.minimum.at(shifts, (words.blocks(begin + j, size) & mask).astype(np.int64), length - 1 - j)
        code = words.blocks(last, size)
        order = np.argsort(code, kind="stable")
        blocks, starts = np.unique(code[order], return_index=True)
        begin, last, item = begin[order], last[order], item[order]
        out.append(Table(length, shifts, blocks, np.append(starts, len(order)), words.blocks(begin + size - 1, size), words.starts[begin], words.ends[last], item, words.data))
    return out


def _running(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. for each count, one after the other."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def search(words: Words, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """The occurrences of a table's test strings: the last word of each, and its item's number."""
    m, size, mask = table.length, table.block, np.uint64(len(table.shifts) - 1)
    lo, hi = words.bounds[:-1] + m - 1, words.bounds[1:]
    n = np.maximum(0, -(-(hi - lo) // STRETCH))
    at = np.repeat(lo, n) + _running(n) * STRETCH
    until = np.minimum(at + STRETCH, np.repeat(hi, n))
    seen, codes = [], []
    while len(at):
        code = words.blocks(at, size)
        shift = table.shifts[(code & mask).astype(np.int64)]
        here = shift == 0
        seen.append(at[here])
        codes.append(code[here])
        at = at + np.maximum(shift, 1)
        go = at < until
        at, until = at[go], until[go]
    if not seen:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, code = np.concatenate(seen), np.concatenate(codes)
    bucket = np.searchsorted(table.blocks, code)
    known = bucket < len(table.blocks)
    known[known] = table.blocks[bucket[known]] == code[known]
    at, bucket = at[known], bucket[known]
    prefix = words.blocks(at - m + size, size)
    found: list[tuple[int, int]] = []
    step, sizes = 0, table.starts[bucket + 1] - table.starts[bucket]
    while step < len(at):  # buckets of many strings are looked through a part at a time
        past = step + max(1, int(np.searchsorted(np.cumsum(sizes[step : step + 4096]), 1 << 20)))
        k = np.repeat(np.arange(step, min(past, len(at))), sizes[step:past])
        string = np.repeat(table.starts[bucket[step:past]], sizes[step:past]) + _running(sizes[step:past])
        close = table.prefixes[string] == prefix[k]
        text, told = "", None
        for i, s in zip(k[close].tolist(), string[close].tolist()):
            if told != i:
                text, told = b" ".join(WORD.findall(words.text(int(at[i]) - m + 1, int(at[i])))), i
            if text == table.text[table.begin[s] : table.end[s]]:
                found.append((int(at[i]), int(table.items[s])))
        step = past
    out = np.array(found, np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def pieces(texts: list[bytes | None], window: int = WINDOW, size: int = PIECE_BYTES) -> Iterator[list[tuple[int, bytes, int, int]]]:
    """Groups of pieces to be searched together, of about `size` bytes: the text's number, lower-case bytes, how many words of
    the piece before stand in front, and the number of the piece's first word in its text."""
    group, held = [], 0
    for i, text in enumerate(texts):
        text = text or b""
        begin, carried, before = 0, [], 0
        while True:
            cut = None
            if len(text) - begin > size and (m := NO_WORD.search(text, begin + size)):
                cut = m.start()
            body = text[begin:cut].lower()
            piece = b" ".join([*carried, body]) if carried else body
            group.append((i, piece, len(carried), before))
            held += len(piece)
            if held >= size:
                yield group
                group, held = [], 0
            if cut is None:
                break
            words = WORD.findall(piece)
            before += len(words)
            carried = words[max(0, len(words) - window + 1) :]
            before -= len(carried)
            begin = cut
    if group:
        yield group


def search_texts(texts: list[bytes | None], found_in: list[Table], names: list[str | None], window: int = WINDOW, size: int = PIECE_BYTES) -> tuple[list[int], list[list[tuple[int, int]]], list[set]]:
    """Of each text the number of words, the merged spans of words inside occurrences (first, past the last), and the items."""
    counts, spans, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
    for group in pieces(texts, window, size):
        words = Words([piece for _, piece, _, _ in group])
        for (i, _, carried, _), n in zip(group, np.diff(words.bounds).tolist()):
            counts[i] += n - carried
        for table in found_in:
            at, item = search(words, table)
            if not len(at):
                continue
            of = np.searchsorted(words.bounds, at, "right") - 1
            base = np.array([b for _, _, _, b in group])[of] - words.bounds[of]
            for k, first, one in sorted(set(zip(of.tolist(), (base + at - table.length + 1).tolist(), item.tolist()))):
                i = group[k][0]
                spans[i].append((first, first + table.length))
                if names[one] is not None:
                    items[i].add(names[one])
    return counts, [merged(s) for s in spans], items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, past in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(past, out[-1][1]))
        else:
            out.append((first, past))
    return out


def item_pieces(benchmark: DataFrame, text: str = "text", item_id: str = "item_id", window: int = WINDOW) -> DataFrame:
    """Items as pieces of at most ITEM_WORDS words that overlap by a window less one: item, words (joined by a blank), n_words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = WORD.findall((body or b"").lower())
                for k in range(0, max(1, len(words) - window + 1), ITEM_WORDS - window + 1):
                    some = words[k : k + ITEM_WORDS]
                    if some:
                        rows.append((item, b" ".join(some).decode(), len(some)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 3, (pa.string(), pa.string(), pa.int64()))], ["item", "words", "n_words"])

    body = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("binary").alias("text"))
    return body.mapInArrow(cut, "item string, words string, n_words long")


def _passes(benchmark: DataFrame, text: str, item_id: str, window: int, words: int) -> Iterator[list[tuple[str | None, str]]]:
    """The test strings in lists of about so many words."""
    found = stage(item_pieces(benchmark, text, item_id, window), "test-strings")
    total = found.agg(F.sum("n_words")).first()[0] or 0
    n = max(1, -(-total // words))
    part = F.pmod(F.xxhash64("item", "words"), F.lit(n))
    for k in range(n):
        yield [(r.item, r.words) for r in found.where(part == k).select("item", "words").collect()]


def _searched(docs: DataFrame, key: str, text: str, items: list[tuple[str | None, str]], window: int, hits_only: bool) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((tables(items, window), [i for i, _ in items]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_in, names = sent.value
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                counts, spans, hit = search_texts(some.column(1).to_pylist(), found_in, names, window)
                spans = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], span)
                out = [some.column(0), pa.array(counts, pa.int64()), spans, pa.array([sorted(h) for h in hit], pa.list_(pa.string()))]
                out = pa.RecordBatch.from_arrays(out, ["key", "n_words", "spans", "items"])
                yield out.filter(pa.array([bool(len(s)) for s in spans])) if hits_only else out
        release()

    body = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    return body.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, n_words long, spans {_SPAN}, items array<string>")


def _covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("past"))
    more = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], a["past"]))).alias("n"), F.greatest(a["past"], s["end"]).alias("past"))
    return F.aggregate(spans, none, more, lambda a: a["n"])


def scan(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id",
    window: int = WINDOW, pattern_words: int = PATTERN_WORDS,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside occurrences), spans (of words: start, end past the last) and
    items (ids of the items with occurrences, as sorted strings)."""
    todo = _passes(benchmark, item_text, item_id, window, pattern_words)
    first, second = next(todo), next(todo, None)
    if second is None:
        found = _searched(docs, doc_id, text, first, window, False).withColumnRenamed("key", "doc_id")
        return found.select("doc_id", "n_words", _covered(F.col("spans")).alias("n_hit"), "spans", "items")
    docs, key = with_row_key(docs, doc_id)
    found = stage(_searched(docs, key, text, first, window, False), "searched")
    while second is not None:
        found = found.unionByName(stage(_searched(docs, key, text, second, window, True), "searched"))
        second = next(todo, None)
    all_of = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    found = found.groupBy("key").agg(F.max("n_words").alias("n_words"), all_of("spans").alias("spans"), all_of("items").alias("items"))
    found = found.select("key", "n_words", _covered(F.col("spans")).alias("n_hit"), "spans", "items")
    if key == doc_id:
        return found.withColumnRenamed("key", "doc_id")
    ids = docs.select(F.col(key).alias("key"), F.col(doc_id).alias("doc_id"))
    return ids.join(found, "key").select("doc_id", "n_words", "n_hit", "spans", "items")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", window: int = WINDOW,
) -> DataFrame:
    """The documents, with all their columns, that hold no test string."""
    columns = docs.columns
    key, hit = fresh(docs, "_row", "_hit")
    docs = stage(docs.withColumn(key, F.monotonically_increasing_id()), "decontaminate")
    found = scan(docs, benchmark, text, key, item_text, item_id, window).where("n_hit > 0").select(F.col("doc_id").alias(hit))
    return docs.join(found, F.col(key) == F.col(hit), "left_anti").select(*columns)
