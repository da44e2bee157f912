"""SimHash near-duplicates by a binary trie self-join.

A fingerprint's bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of the document's word
shingles. Documents of one fingerprint are collapsed first. Two fingerprints that differ in at most BUDGET of
64 bits agree in at least one of BLOCKS = BUDGET + 1 blocks of 16 bits, so every fingerprint goes to BLOCKS
tries, one per block, dealt by that block's value: a pair that links meets in at least one. Inside a task the
sorted fingerprints are the trie (a node is a range of them). Pairs of nodes are walked down
together, level by level in arrays; differing bits add up, and a pair is dropped when they exceed the
budget, or when all below it is known to be connected, so a dense group costs no pair per pair of
members. A task returns a spanning forest. Forests are joined to components by alternating large-star and
small-star steps over tables in the shared folder; nothing is collected.

Defined cases: texts without a word have the fingerprint zero and link like any other; a null doc_id
comes after all others, and a component of such rows alone has a null id; rows that repeat a doc_id
stay one to one; an empty table gives no rows; columns other than the two used do not matter; a very long text is shingled
whole, in its row's task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stage, text_of, unstage, with_row_key

SHINGLE = 3
SEED = 42
BUDGET = 3
BLOCK_BITS = 16
BLOCKS = 64 // BLOCK_BITS
#: Fingerprints that a task's tries hold on average at most.
TASK_ROWS = 500_000
#: Node pairs that are walked at once.
CHUNK = 1 << 18


def shingle_hashes(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> Iterator[np.ndarray]:
    """The XXH64 digests (8 bytes each, highest first) of the text's word shingles in their order, repeats included, by the
    chunk; one of all words if there are fewer, none if there is no word."""
    words = text.lower().split()  # of bytes: A-Z only, and [\x20\x09-\x0D]
    if not words:
        return
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= shingle:
        yield np.frombuffer(digest(joined, seed), np.uint8).reshape(1, 8)
        return
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], blanks[: len(words) - shingle] + 1)).tolist()
    ends = np.concatenate((blanks[shingle - 1 :], [len(joined)])).tolist()
    for i in range(0, len(starts), 65536):
        pairs = zip(starts[i : i + 65536], ends[i : i + 65536])
        yield np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in pairs]), np.uint8).reshape(-1, 8)


def majority(chunks: Iterable[np.ndarray]) -> int:
    """The number whose bits are those set in over half of the digests; zero without digests."""
    counts, n = np.zeros(64, np.int64), 0
    for digests in chunks:
        counts += np.unpackbits(digests, axis=1).sum(axis=0, dtype=np.int64)
        n += len(digests)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big") if n else 0


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    return majority(shingle_hashes(text, shingle, seed))


def _fingerprints(text: pa.Array) -> pa.Array:
    found = np.array([fingerprint(x.as_buffer().to_pybytes()) for x in text], np.uint64)
    return pa.array(found.view(np.int64))


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and fingerprint (its 64 bits as a signed long)."""
    one = F.arrow_udf(_fingerprints, "long")
    return docs.select(F.col(doc_id).alias("doc_id"), one(text_of(docs, text).cast("binary")).alias("fp"))


class Forest:
    """Connected components of the numbers 0..n-1; `root` is each one's smallest member."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.changed = True

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up
            self.changed = True


def trie_links(sorted_prints: np.ndarray, skip: int, budget: int = BUDGET) -> np.ndarray:
    """The root of each of the distinct, sorted 64-bit numbers, where numbers are linked that agree in
    the first `skip` bits and differ in at most `budget` others."""
    v, forest = sorted_prints, Forest(len(sorted_prints))
    if len(v) < 2:
        return forest.root
    cuts = np.flatnonzero(np.concatenate(([True], (v[1:] >> np.uint64(64 - skip)) != (v[:-1] >> np.uint64(64 - skip)))))
    lo, hi = cuts, np.concatenate((cuts[1:], [len(v)]))
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    ones: dict[int, np.ndarray] = {}
    turns = np.zeros(len(v), np.int64)
    # Node pairs (ranges a..b and c..d) with the bits that differ so far. Last in, first out: nodes with
    # themselves go down first, so that dense groups are connected before their pairs are walked.
    todo = [(skip, *(x[i : i + CHUNK] for x in (lo, hi, lo, hi, np.zeros(len(lo), np.int8)))) for i in range(0, len(lo), CHUNK)]
    while todo:
        depth, a, b, c, d, err = todo.pop()
        if forest.changed:
            turns[1:] = np.cumsum(forest.root[1:] != forest.root[:-1])
            forest.changed = False
        known = (turns[a] == turns[b - 1]) & (turns[c] == turns[d - 1]) & (forest.root[a] == forest.root[c])
        few = ((b - a) * (d - c) <= 16) | (depth == 64)
        if (now := few & ~known).any():
            x, y = _all_pairs(a[now], b[now], c[now], d[now])
            near = np.bitwise_count(v[x] ^ v[y]) <= budget
            if near.any():
                forest.link(x[near], y[near])
        rest = ~few & ~known
        if not rest.any():
            continue
        a, b, c, d, err = (x[rest] for x in (a, b, c, d, err))
        if depth not in ones:
            ones[depth] = np.concatenate(([0], np.cumsum((v >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)))
        n = ones[depth]
        m, k = b - (n[b] - n[a]), d - (n[d] - n[c])  # where the next bit turns to 1
        same, yes = a == c, np.ones(len(a), bool)
        below = []
        for p, q, r, s, e, use in (
            (a, m, k, d, err + 1, yes),
            (m, b, c, k, err + 1, ~same),
            (m, b, k, d, err, yes),
            (a, m, c, k, err, yes),
        ):
            use = use & (q > p) & (s > r) & (e <= budget) & ~((p == r) & (q - p < 2))
            below.append([x[use] for x in (p, q, r, s, e)])
        below = [np.concatenate(x) for x in zip(*below)]
        todo.extend((depth + 1, *(x[i : i + CHUNK] for x in below)) for i in range(0, len(below[0]), CHUNK))
    return forest.root


def _all_pairs(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (x, y) with x in a..b and y in c..d, for every row."""
    n, m = b - a, d - c
    size = n * m
    row = np.repeat(np.arange(len(a)), size)
    k = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    return a[row] + k // m[row], c[row] + k % m[row]


def _task_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    block, prints = (np.concatenate(x) for x in zip(*parts))
    prints = prints.view(np.uint64)
    for k in np.unique(block):
        shift = np.uint64(k * BLOCK_BITS)
        mine = prints[block == k]
        turned = np.unique(mine << shift | mine >> np.uint64((64 - k * BLOCK_BITS) % 64) if k else mine)
        root = trie_links(turned, BLOCK_BITS)
        linked = np.flatnonzero(root != np.arange(len(root)))
        back = (turned >> shift | turned << np.uint64((64 - k * BLOCK_BITS) % 64) if k else turned).view(np.int64)
        for i in range(0, len(linked), 100_000):
            at = linked[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(back[at]), pa.array(back[root[at]])], ["u", "v"])


def _block(k: int) -> Column:
    """The block that the k-th trie begins with."""
    return F.shiftrightunsigned("fp", 64 - (k + 1) * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def links(prints: DataFrame, n_prints: int) -> DataFrame:
    """(u, v) fingerprints within the budget, enough of them to connect whatever is connected."""
    spark = prints.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-BLOCKS * n_prints // TASK_ROWS))
    blocks = F.array(*[F.struct(F.lit(k).cast("int").alias("k"), _block(k).alias("value")) for k in range(BLOCKS)])
    dealt = prints.select("fp", F.explode(blocks).alias("b")).repartition(tasks, "b.k", "b.value")
    return dealt.select(F.col("b.k").alias("k"), "fp").mapInArrow(_task_links, "u long, v long")


# The least neighbours are staged so that the join deals both of its sides itself: a node with very many
# neighbours is then a skewed partition that Spark splits.


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stage(both.groupBy("u").agg(F.min("v").alias("m")), "simhash-least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = stage(down.groupBy("u").agg(F.min("v").alias("m")), "simhash-least")
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down, or only edges up: then its neighbour down is the smallest of its component."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("down")))
    nodes = ends.groupBy("x").agg(F.sum("down").alias("down"), F.min("down").alias("least"))
    return nodes.where((F.col("down") > 1) | (F.col("down") == 1) & (F.col("least") == 0)).limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node that has an edge, and the smallest node it is connected with, itself apart."""
    edges = stage(_small_star(edges), "simhash-edges")
    while not _are_stars(edges):
        before, edges = edges, stage(_small_star(_large_star(edges)), "simhash-edges")
        unstage(before)
    return edges


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id
    that links of at most BUDGET differing bits reach."""
    rows = stage(fingerprints(docs, text, doc_id), "simhash-prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")))
    groups = stage(rows.groupBy("fp").agg(first.alias("first")), "simhash-groups")
    edges = components(stage(links(groups, groups.count()), "simhash-links"))
    members = edges.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct()
    )
    least = members.join(groups, "fp").groupBy("root").agg(F.min("first").alias("component"))
    of_print = members.join(least, "root").select("fp", "component")
    of_print = groups.join(of_print, "fp", "left").select("fp", F.coalesce("component", "first").alias("component"))
    return rows.join(stage(of_print, "simhash-components"), "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component.id").alias("component_id"),
    )


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each component, the one with the smallest doc_id; where rows repeat a doc_id, or
    have none, the first by a row number."""
    columns = docs.columns
    docs, key = with_row_key(docs, doc_id)
    (kept,) = fresh(docs, "_kept")
    found = near_duplicates(docs, text, key).where(F.col("doc_id") == F.col("component_id"))
    return docs.join(found.select(F.col("doc_id").alias(kept)), F.col(key) == F.col(kept), "left_semi").select(*columns)
