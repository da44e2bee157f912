"""Near-duplicates of word shingles: SimHash links, verified by exact similarity and completed by a prefix filter.

Two documents are linked if their sets of word shingles have a Jaccard similarity of at least NUM / DEN; of every
connected group the smallest doc_id stays.

1. Documents of equal sets are collapsed.
2. The trie self-join over fingerprints of these shingles links what differs in few bits; these pairs are compared.
3. No number of differing bits holds all similar pairs (at 0.8, a tenth and more of the bits differ), so the rest comes
   from a prefix filter, which loses none. With the shingles of every set in one order, two sets of n and m shingles that
   are similar have at least a = ceil((n + m) * NUM / (NUM + DEN)) in common, so they share a shingle that stands among the
   first n - a + 1 of one and m - a + 1 of the other. The order puts shingles that are frequent in a bounded sample
   last; any order gives the same result, this one few candidates. Every document is compared with a few
   centres among those that share a shingle with it, before the candidates that are still in different groups are.
4. Before the sets of a candidate pair are brought together, their sketches are: two to four bits per shingle, each the
   parity of the shingles that fall on it. Common shingles cancel, so sets differ in at least as many shingles as sketches do
   in bits, and no similar pair is lost; only what that bound leaves open is compared as sets.

So a dense group costs comparisons with centres, not a comparison per pair of members.

Defined cases: texts without a word have equal sets; a text of fewer words than a shingle is one shingle;
rows that repeat a doc_id, or have none, are told apart by a row number; an empty table gives no rows;
other columns stay, whatever their names; a very long text is shingled whole, in its row's task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_shuffles, fresh, stage, text_of, unstage, with_row_key
from .simhash import SEED, components, links, majority, shingle_hashes

SHINGLE = 5
#: Least similarity, as a fraction of whole numbers.
NUM, DEN = 4, 5
#: Documents whose shingles are counted for the order, about, and the least count that matters.
SAMPLE, FREQUENT = 16_384, 8
#: Centres per shared shingle: of the documents with the fewest shingles of their own before it, which are the nearest to
#: what the others were copied from, those with the smallest hashes of their ids.
CENTRES = 4
#: Bits of a set's sketch at least, a power of two.
SKETCH = 256
#: Keys that are broadcast at most to pick rows; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def shingle_set(text: bytes, shingle: int = SHINGLE) -> tuple[np.ndarray, int]:
    """The sorted distinct 64-bit hashes of the text's word shingles, and its fingerprint."""
    chunks = list(shingle_hashes(text, shingle, SEED))
    found = np.concatenate(chunks) if chunks else np.zeros((0, 8), np.uint8)
    return np.unique(found.view(np.int64).ravel()), majority(chunks)


def similar(a: np.ndarray, b: np.ndarray, num: int = NUM, den: int = DEN) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return den * common >= num * (len(a) + len(b) - common)


def sketch(shingles: np.ndarray) -> bytes:
    """For each of the bits, a power of two of them, whether an odd number of the shingles falls on it."""
    bits = max(SKETCH, 2 << max(len(shingles) - 1, 0).bit_length())
    return np.packbits(np.bincount(shingles & (bits - 1), minlength=bits) & 1).tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded to the length of the other."""
    x, y = (np.frombuffer(s, np.uint64) for s in sorted((a, b), key=len))
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)))).sum())


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.int64) for x in column]


def _lists(found: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *found]), kind))


def _bytes(text: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() for x in text]


def set_prints(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, digest, fp, n, sketch) of rows (id, text as binary): of the set of shingles a digest, its size and sketch, and the
    fingerprint."""

    def prints(text: pa.Array) -> pa.Array:
        found = [shingle_set(x, shingle) for x in _bytes(text)]
        digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s, _ in found], pa.binary())
        fp = pa.array(np.array([f for _, f in found], np.uint64).view(np.int64))
        n = pa.array([len(s) for s, _ in found], pa.int32())
        sketches = pa.array([sketch(s) for s, _ in found], pa.binary())
        return pa.StructArray.from_arrays([digests, fp, n, sketches], ["digest", "fp", "n", "sketch"])

    found = F.arrow_udf(prints, "struct<digest:binary,fp:long,n:int,sketch:binary>")
    return rows.select("id", found("text").alias("s")).select("id", "s.*")


def _pick(rows: DataFrame, keys: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """The rows whose key is one of the staged keys, or with left_anti those whose key isn't."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, how)


def _needed(n: Column, m: Column, num: int, den: int) -> Column:
    """Shingles that two similar sets of n and m have in common at least."""
    return F.floor(((n + m) * num + (num + den - 1)) / (num + den))


def _meets(a: dict[str, Column], b: dict[str, Column], num: int, den: int) -> Column:
    """Whether sets with n shingles, whose i-th is shared, may be similar as far as that shingle tells."""
    least = _needed(a["n"], b["n"], num, den)
    return (den * F.least(a["n"], b["n"]) >= num * F.greatest(a["n"], b["n"])) & (a["i"] <= a["n"] - least) & (b["i"] <= b["n"] - least)


def _open_pairs(pairs: DataFrame, prints: DataFrame, num: int, den: int) -> DataFrame:
    """Those (u, v) whose sketches leave open that they are similar."""
    for c in "uv":
        pairs = pairs.join(prints.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")), c)
    n, m = F.col("n_u"), F.col("n_v")
    bits = F.arrow_udf(lambda a, b: pa.array([differing_bits(x, y) for x, y in zip(_bytes(a), _bytes(b))], pa.int32()), "int")
    apart = bits("s_u", "s_v")
    return pairs.where(apart <= n + m - 2 * _needed(n, m, num, den)).select("u", "v")


def similar_pairs(pairs: DataFrame, prints: DataFrame, rows: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Those (u, v) whose rows (id, text as binary) are similar."""
    pairs = stage(_open_pairs(pairs, prints, num, den), "near-open")
    both = stage(pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct(), "near-both")
    sets = F.arrow_udf(lambda t: pa.array([shingle_set(x, shingle)[0].tobytes() for x in _bytes(t)], pa.binary()), "binary")
    some = stage(_pick(rows, both, "id").select("id", sets("text").alias("h")), "near-compared")
    check = F.arrow_udf(lambda a, b: pa.array([similar(x, y, num, den) for x, y in zip(_arrays(a), _arrays(b))], pa.bool_()), "boolean")
    out = pairs.join(some.select(F.col("id").alias("u"), F.col("h").alias("a")), "u")
    out = out.join(some.select(F.col("id").alias("v"), F.col("h").alias("b")), "v")
    found = stage(out.withColumn("ok", check("a", "b")).where("ok").select("u", "v"), "near-links")
    unstage(pairs, both, some)
    return found


def frequent_shingles(rows: DataFrame, n_docs: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample of about SAMPLE have, in order, and their counts there."""
    every = -(-n_docs // SAMPLE) or 1
    lists = F.arrow_udf(lambda t: _lists([shingle_set(x, shingle)[0] for x in _bytes(t)], pa.int64()), "array<long>")
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select(F.explode(lists("text")).alias("h"))
    counted = sample.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).orderBy("h").toArrow()
    known, count = (c.to_numpy().astype(np.int64) for c in counted.columns)
    return known, count


def prefixes(rows: DataFrame, known: np.ndarray, count: np.ndarray, shingle: int, num: int, den: int) -> DataFrame:
    """(id, at, h): of every set of n shingles the first ones in the order, as far as a similar set of any size may need them;
    `at` holds n in its upper and the place, from 0, in its lower 32 bits."""
    sent = rows.sparkSession.sparkContext.broadcast((known, count))

    def first_ones(text: pa.Array) -> pa.Array:
        known, count = sent.value
        out, sizes = [], []
        for x in _bytes(text):
            s = shingle_set(x, shingle)[0]
            n = np.zeros(len(s), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                n = np.where(known[at] == s, count[at], 0)
            out.append(s[np.lexsort((s, n))][: len(s) + (-len(s) * num // den) + 1] if len(s) else s)
            sizes.append(len(s))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), _lists(out, pa.int64())], ["n", "h"])

    first = F.arrow_udf(first_ones, "struct<n:int,h:array<long>>")
    found = rows.select("id", first("text").alias("p")).select("id", "p.n", F.posexplode("p.h").alias("i", "h"))
    return found.select("id", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("i")).alias("at"), "h")


def _shared(found: DataFrame) -> DataFrame:
    """(id, n, i, h, c): the rows whose shingle another document has too, with the centres of that shingle."""
    several = stage(found.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), "near-several")
    n, i = F.shiftright("at", 32).cast("int"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    some = stage(found.join(several, "h", "left_semi").select("id", n.alias("n"), i.alias("i"), "h"), "near-some")
    order = [F.struct("i", F.xxhash64("id", F.lit(k))) for k in range(CENTRES)]
    centres = some.groupBy("h").agg(F.array(*[F.min_by(F.struct("id", "n", "i"), o) for o in order]).alias("c"))
    out = stage(some.join(stage(centres, "near-centres"), "h"), "near-shared")
    unstage(several, some)
    return out


def _centre_pairs(shared: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): documents and the centres that they share a shingle with."""
    shared = shared.select("id", "n", "i", F.explode(F.array_distinct("c")).alias("c"))
    mine, theirs = ({c: F.col(p + c) for c in ("n", "i")} for p in ("", "c."))
    near = shared.where((F.col("id") != F.col("c.id")) & _meets(mine, theirs, num, den))
    return near.select(F.greatest("id", "c.id").alias("u"), F.least("id", "c.id").alias("v"))


def _print_pairs(firsts: DataFrame) -> DataFrame:
    """(u, v): documents of one fingerprint with the first of them, and the firsts of linked fingerprints."""
    groups = stage(firsts.groupBy("fp").agg(F.min("id").alias("id")), "near-prints")
    same = firsts.join(groups.withColumnRenamed("id", "v"), "fp").where("id <> v").select(F.col("id").alias("u"), "v")
    linked = links(groups, groups.count())
    a, b = (groups.select(F.col("fp").alias(c), F.col("id").alias(f"id_{c}")) for c in ("u", "v"))
    linked = linked.join(a, "u").join(b, "v").select(F.greatest("id_u", "id_v").alias("u"), F.least("id_u", "id_v").alias("v"))
    return same.unionByName(linked)


def keep_first(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, num: int = NUM, den: int = DEN
) -> DataFrame:
    """One document of each connected group, the one with the smallest doc_id."""
    columns = docs.columns
    free_shuffles(docs.sparkSession)
    docs, key = with_row_key(docs, doc_id)
    (kept,) = fresh(docs, "_kept")
    rows = docs.select(F.col(key).alias("id"), text_of(docs, text).cast("binary").alias("text"))
    prints = stage(set_prints(rows, shingle), "near-prints")
    firsts = stage(prints.groupBy("digest", "fp").agg(F.min("id").alias("id")).select("id", "fp"), "near-firsts")
    again = stage(prints.select("id").join(firsts.select("id"), "id", "left_anti"), "near-again")
    rows = _pick(rows, again, "id", "left_anti")
    first_ones = stage(prefixes(rows, *frequent_shingles(rows, firsts.count(), shingle), shingle, num, den), "near-prefixes")
    shared = _shared(first_ones)
    unstage(first_ones)
    pairs = stage(_print_pairs(firsts).unionByName(_centre_pairs(shared, num, den)).distinct(), "near-pairs")
    linked = similar_pairs(pairs, prints, rows, shingle, num, den)

    roots = components(linked).select(F.col("u").alias("id"), F.col("v").alias("root"))
    found = shared.drop("c").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    found = stage(found.withColumn("low", F.col("i") <= F.col("n") - _needed(F.col("n"), F.col("n"), num, den)), "near-rooted")
    # Of a pair the set with fewer shingles, which may be either of equal ones, needs its shorter prefix only.
    sides = [{c: F.col(f"{c}_{s}") for c in ("id", "n", "i", "root")} for s in "ab"]
    a, b = (t.select("h", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "i", "root")]) for t, s in ((found, "a"), (found.where("low"), "b")))
    other = (sides[0]["root"] != sides[1]["root"]) & (sides[1]["n"] <= sides[0]["n"]) & _meets(*sides, num, den)
    rest = a.join(b, "h").where(other).select(F.greatest("id_a", "id_b").alias("u"), F.least("id_a", "id_b").alias("v")).distinct()
    rest = stage(rest.join(pairs, ["u", "v"], "left_anti"), "near-rest")
    linked = linked.unionByName(similar_pairs(rest, prints, rows, shingle, num, den))
    others = components(linked).select(F.col("u").alias(kept))
    out = docs.join(stage(firsts.select(F.col("id").alias(kept)).join(others, kept, "left_anti"), "near-kept"), F.col(key) == F.col(kept), "left_semi")
    unstage(prints, shared, found, pairs, rest)
    return out.select(*columns)
