"""Packing token sequences by the sum-of-squares rule.

A document's ids are cut into whole windows, which are sequences of their own, and a remainder. Remainders
are placed online: of all fill levels that still have room, and of an empty window, the one is taken after which
the sum of the squared counts of partially filled windows is smallest. Only that array of counts per
level is looked at, so placing costs O(window) whatever has come before.

Every task packs its own split and needs no shuffle. A window that is full is written at once. At the end of a
split the open windows are emptied one into the other, cutting documents where a window ends; the rest of the split
goes into sequences whose lengths are powers of two, which need no padding. The rule leaves few windows open unless
hardly any two remainders fit together; even then they hold no more than the remainders of the split, 4 bytes an id.

Rows that come in an order that matters, such as a curriculum written as range-sorted files, are packed file by file
(`written_order`): sequence ids then rise with the order. Inside a part a sequence is numbered as it is opened, so ids rise with
the first document of each; only the windows that are emptied at a part's end come after all others.

Tokens come from a cache of ids by word: the tokenizer splits at blanks and line ends whatever stands around
them, so a text's ids are those of its words one after the other. The cache is bounded; what it forgets
is encoded again.

Defined cases: a null or empty text is one document of one id, END; a null doc_id stays null; rows that
repeat a doc_id are documents of their own; an empty table gives no rows; a very long text is encoded whole, as one document,
whose ids take 4 bytes each in its task; other columns do not matter.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, release, text_of

WINDOW = 4096
#: Follows every document.
END = 2
#: Bits of a sequence id that count the sequences of a part, and bits of a part of `written_order` that tell where in its file it
#: begins, in units of 64 KB.
PART_BITS, PLACE_BITS = 23, 16
#: Files whose parts `written_order` can number.
MOST_FILES = 1 << (63 - PART_BITS - PLACE_BITS)
#: Words whose ids a task remembers.
CACHED_WORDS = 400_000
#: Ends the last token of a word.
SUFFIX = "</w>"

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, "
    "sequence_tokens long"
)


class WordIds:
    """Ids of texts, as little-endian unsigned 32-bit numbers, by way of a cache of words.

    A tokenizer that ends every word with a suffix of its own and drops white space (`by_words`) gives a
    text the ids of its words. New Latin-1 words are then merged by tiktoken, with the tokenizer's own
    vocabulary as ranks and the byte FF in place of the suffix: the merge of lowest rank comes first in both,
    and both give every vocabulary entry its own id alone, so they agree (tests compare them). Anything else,
    and all texts of other tokenizers, go through the tokenizer itself.
    """

    def __init__(self, tokenizer_path: str, cached: int = CACHED_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.merges, self.pieces = self.by_words()
        self.cached, self.young, self.old = cached, {}, {}

    def by_words(self) -> tuple:
        """tiktoken's merges and the pattern of a word's pieces; (None, None) for other tokenizers."""
        import regex
        import tiktoken

        told = json.loads(self.tokenizer.to_str())
        model, steps = told["model"], (told["pre_tokenizer"] or {}).get("pretokenizers", [])
        normal = [x["type"] for x in (told["normalizer"] or {}).get("normalizers", [])]
        blank = r"[^\s\p{L}\p{N}]+"
        if (
            (model["type"], model.get("end_of_word_suffix"), normal) != ("BPE", SUFFIX, ["NFC", "Replace", "Lowercase"])
            or [x["type"] for x in steps] != ["Split", "ByteLevel"]
            or not steps[0]["pattern"].get("Regex", "").endswith(blank)
            or any(x["lstrip"] or x["rstrip"] or x["single_word"] or not x["content"].startswith("<|") for x in told["added_tokens"])
        ):
            return None, None
        special = {x["content"] for x in told["added_tokens"]}
        ranks = {_as_bytes(t): i for t, i in model["vocab"].items() if t not in special}
        made = [model["vocab"]["".join(m)] for m in model["merges"]]
        if made != list(range(len(ranks) - len(made), len(ranks))) or len(made) + 512 != len(ranks):
            return None, None
        merges = tiktoken.Encoding("words", pat_str=blank, mergeable_ranks=ranks, special_tokens={})
        return merges, regex.compile(steps[0]["pattern"]["Regex"])

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        if not word.isprintable() or "<|" in word:
            return self.encode(word)
        try:
            word.encode("latin-1")
        except UnicodeEncodeError:
            return self.encode(word)
        word = word.lower()
        ids: list[int] = []
        for piece in (word,) if word.isalpha() else self.pieces.findall(word):
            ids += self.merges._core_bpe.encode_single_piece(piece.encode() + b"\xff")
        return struct.pack(f"<{len(ids)}I", *ids)

    def of(self, texts: list[str]) -> list[bytes]:
        if self.merges is None:
            return [self.encode(t) for t in texts]
        if len(self.young) > self.cached:
            self.old, self.young = self.young, {}
        words = [lowered(t).replace("\n", " ").split(" ") for t in texts]
        young, old = self.young, self.old
        for w in {w for ws in words for w in ws}.difference(young):
            found = old.get(w)
            young[w] = self.word(w) if found is None else found
        return [b"".join(map(young.__getitem__, ws)) for ws in words]


def _as_bytes(token: str) -> bytes:
    """A token's bytes: the byte-level alphabet gives printable bytes their own character and the others
    the characters from 256 on; the suffix becomes FF."""
    ends = token.endswith(SUFFIX)
    return bytes(map(_BYTE_OF.__getitem__, token.removesuffix(SUFFIX) if ends else token)) + b"\xff" * ends


_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_BYTE_OF = {chr(b): b for b in _SHOWN} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


def lowered(text: str) -> str:
    """In lower case if it is Latin-1, where that is done character by character: fewer words to know."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text if "<|" in text else text.lower()


class Packer:
    """Places pieces; `take` and `finish` return (sequence number, pieces) of closed sequences."""

    def __init__(self, window: int = WINDOW, max_open: int | None = None) -> None:
        """With max_open, windows are emptied whenever more stand open; the operator sets none."""
        self.window, self.max_open, self.next, self.open = window, max_open, 0, 0
        #: Number of open windows per fill level, and these windows' numbers and pieces.
        self.counts = np.zeros(window + 1, np.int64)
        self.levels: list[list[list]] = [[] for _ in range(window + 1)]

    def number(self) -> int:
        self.next += 1
        return self.next - 1

    def best_level(self, size: int) -> int:
        """The fill level for a piece: moving a window from level h to h + size changes the sum of squares by
        2 * (count[h + size] - count[h]) + 2, where a full window counts nothing and level 0 is a new one."""
        w, n = self.window, self.counts
        change = 2 * (n[size:w] - n[: w - size]) + 2
        change[0] = 2 * n[size] + 1
        usable = n[: w - size] > 0
        usable[0] = True
        change = np.where(usable, change, np.iinfo(np.int64).max)
        best = int(change[::-1].argmin())  # of equals the fullest
        best = w - size - 1 - best
        if n[w - size] and 1 - 2 * n[w - size] <= change[best]:  # fills a window up
            return w - size
        return best

    def take(self, doc: tuple, ids: bytes) -> Iterator[tuple[int, list]]:
        total = len(ids) // 4
        whole = total - total % self.window
        for start in range(0, whole, self.window):
            yield self.number(), [(doc, start, ids[4 * start : 4 * (start + self.window)])]
        if size := total - whole:
            level = self.best_level(size)
            if level:
                number, pieces = self.levels[level].pop()
                self.counts[level] -= 1
                self.open -= 1
            else:
                number, pieces = self.number(), []
            pieces.append((doc, whole, ids[4 * whole :]))
            if level + size == self.window:
                yield number, pieces
            else:
                self.levels[level + size].append((number, pieces))
                self.counts[level + size] += 1
                self.open += 1
                if self.max_open is not None and self.open > self.max_open:
                    yield from self.drain(False)

    def drain(self, last: bool) -> Iterator[tuple[int, list]]:
        """Close all open windows, fullest first, cutting pieces where a window is full."""
        rest, room = [], self.window
        for level in range(self.window - 1, 0, -1):
            for _, pieces in self.levels[level]:
                for doc, start, ids in pieces:
                    while ids:
                        part, ids = ids[: 4 * room], ids[4 * room :]
                        rest.append((doc, start, part))
                        start += len(part) // 4
                        room -= len(part) // 4
                        if not room:
                            yield self.number(), rest
                            rest, room = [], self.window
            self.levels[level] = []
        self.counts[:] = 0
        self.open = 0
        if last:
            yield from self.powers(rest)
        elif rest:
            level = self.window - room
            self.levels[level].append((self.number(), rest))
            self.counts[level], self.open = 1, 1

    def powers(self, pieces: list) -> Iterator[tuple[int, list]]:
        """Sequences of falling powers of two, together as long as the pieces."""
        left = sum(len(ids) for _, _, ids in pieces) // 4
        pieces = pieces[::-1]
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            out = []
            while room:
                doc, start, ids = pieces.pop()
                part, ids = ids[: 4 * room], ids[4 * room :]
                out.append((doc, start, part))
                room -= len(part) // 4
                if ids:
                    pieces.append((doc, start + len(part) // 4, ids))
            yield self.number(), out

    def finish(self) -> Iterator[tuple[int, list]]:
        yield from self.drain(True)


def _rows(closed: Iterable[tuple[int, list]]) -> Iterator[pa.RecordBatch]:
    columns: list[list] = [[] for _ in range(8)]
    names = [f.strip().split()[0].strip("`") for f in PIECES.split(",")]

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    for number, pieces in closed:
        tokens, at = sum(len(ids) for _, _, ids in pieces) // 4, 0
        for (doc, n), start, ids in pieces:
            length = len(ids) // 4
            for c, x in zip(columns, (doc, start, length, zlib.crc32(ids), n, number, at, tokens)):
                c.append(x)
            at += length
        if len(columns[0]) > 50_000:
            yield batch()
            columns = [[] for _ in range(8)]
    if columns[0]:
        yield batch()


def written_order(docs: DataFrame) -> Column | None:
    """A number that rises with the place of rows in the files of one write, part-<number>..., for `part`: of the file, and of the
    split in it. Rows of a frame that reads no files are in the order of its partitions, which needs no number (None). Files
    whose order their names don't tell, or that are too many or too long for a number, are an error: an order that matters is
    never lost in silence."""
    files = docs.inputFiles()
    if not files:
        return None
    found = [re.search(r"/part-(\d+)[^/]*$", f) for f in files]
    about = docs.metadataColumn("_metadata")
    if len(files) == 1:
        number = F.lit(0).cast("long")
    elif all(found) and len({int(m[1]) for m in found}) == len(files):
        if max(int(m[1]) for m in found) >= MOST_FILES:
            raise ValueError(f"files numbered from {MOST_FILES} on can't be packed in order")
        number = F.regexp_extract(about["file_name"], r"^part-(\d+)", 1).cast("long")
    else:
        raise ValueError("the names of the files don't tell their order")
    place = F.shiftright(about["file_block_start"], 16)
    far = F.raise_error(F.lit("a file too long to be packed in order")).cast("long")
    return F.shiftleft(number, PLACE_BITS) + F.when(place < 1 << PLACE_BITS, place).otherwise(far)


def file_of(sequence_id: int) -> int:
    """The number of the file whose rows a sequence holds, if they were packed by `written_order`."""
    return sequence_id >> (PART_BITS + PLACE_BITS)


def pack(
    docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, part: Column | None = None
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and
    sequence_tokens. Neighbouring rows of one `part` (a number of at most 40 bits) are packed together, others never, and sequence ids
    hold it in their upper bits; without it, the number of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept((tokenizer_path, CACHED_WORDS), lambda: WordIds(tokenizer_path, CACHED_WORDS))
        packer = Packer(window)
        end = np.array([END], "<u4").tobytes()
        task = TaskContext.get().partitionId()

        def closed() -> Iterator[tuple[int, list]]:
            nonlocal packer
            at = None
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    some = batch.slice(i, 256)
                    for doc, mine, ids in zip(some.column(0).to_pylist(), some.column(2).to_pylist(), words.of(some.column(1).to_pylist())):
                        mine = task if mine is None else mine
                        if mine != at:
                            yield from numbered(at, packer.finish())
                            at, packer = mine, Packer(window)
                        ids += end
                        yield from numbered(at, packer.take((doc, len(ids) // 4), ids))
            yield from numbered(at, packer.finish())

        def numbered(at: int | None, found: Iterator[tuple[int, list]]) -> Iterator[tuple[int, list]]:
            for number, pieces in found:
                if number >> PART_BITS:
                    raise ValueError(f"more than {1 << PART_BITS} sequences in one part")
                yield ((at or 0) << PART_BITS) + number, pieces

        yield from _rows(closed())
        release()

    of_part = F.lit(None).cast("long") if part is None else part.cast("long")
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(docs, text).alias("text"), of_part.alias("part"))
    return body.mapInArrow(run, PIECES)
