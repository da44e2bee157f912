"""Decontamination, hard negatives and vector codes against plain versions, and their defined cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import decontamination, hard_negatives, vector_codes, vectors
from verdigris.llm.queries import ORACLES, QUERIES

DOC, ITEM = "doc_id long, text string", "item_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("name", ["op11_decontamination", "op12_hard_negatives", "op13_vector_codes"])
def test_query_agrees_with_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLES[name])


# Decontamination


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_scan(docs, items, window=10):
    """By testing every window at every place."""
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            b = words(body)
            m = min(window, len(b))
            for j in range(len(b) - m + 1 if m else 0):
                for i in range(len(w) - m + 1):
                    if w[i : i + m] == b[j : j + m]:
                        hit.update(range(i, i + m))
                        found.add(str(item))
        out.append((doc, len(w), len(hit), ",".join(sorted(found - {"None"}))))
    return sorted(out, key=repr)


def scanned(docs, items, **more):
    found = decontamination.scan(docs, items, **more).select("doc_id", "n_words", "n_hit", F.array_join("items", ",")).collect()
    return sorted((tuple(r) for r in found), key=repr)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    some = ["a", "b", "the", "é", "ñandú", "x9", "日本", "longwordlongword", "otherwordlongword"]
    text = lambda n: r.choice([" ", "-", "\n"]).join(r.choice(some) for _ in range(n))
    items = [(k, text(r.choice([1, 2, 3, 9, 10, 11, 14, 40]))) for k in range(40)] + [(3, text(12)), (None, text(10)), (98, None), (99, " ;; ")]
    docs = []
    for k in range(60):
        parts = [text(r.randrange(30))]
        for _ in range(r.randrange(3)):
            body = (r.choice(items)[1] or "").upper() if r.random() < 0.5 else r.choice(items)[1] or ""
            parts += [body[: r.randrange(len(body) + 1)] if r.random() < 0.3 else body, text(r.randrange(20))]
        docs.append((k, " ".join(parts)))
    return docs + [(7, docs[7][1]), (None, items[0][1]), (200, None), (201, ""), (202, "\0 A\x7f;")], items


def test_scan_is_a_plain_search(spark, corpus):
    docs, items = corpus
    items = [i for i in items if len(words(i[1])) not in (1, 2)]  # these hit nearly everything
    assert scanned(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)) == plain_scan(docs, items)


def test_short_items_and_several_passes(spark, corpus):
    docs, items = corpus
    told = plain_scan(docs, items)
    d, i = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    assert scanned(d, i) == told
    assert scanned(d, i, pattern_words=100) == told


def test_texts_in_pieces_and_cut_items(spark, corpus, monkeypatch):
    docs, items = corpus
    found_in, names = decontamination.tables([(str(i), " ".join(words(t))) for i, t in items]), [str(i) for i, _ in items]
    texts = [t and t.encode() for _, t in docs]
    whole = decontamination.search_texts(texts, found_in, names)
    for size in (1, 7, 60):
        assert decontamination.search_texts(texts, found_in, names, size=size) == whole
    monkeypatch.setattr(decontamination, "ITEM_WORDS", 12)
    cut = decontamination.item_pieces(spark.createDataFrame(items, ITEM)).collect()
    assert max(r.n_words for r in cut) == 12 and {r.item for r in cut} == {str(i) for i, t in items if words(t) and i is not None} | {None}
    assert scanned(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)) == plain_scan(docs, items)


def test_a_text_of_many_megabytes_is_read_in_pieces():
    item = " ".join(f"w{k}" for k in range(12))
    text = ("filler text " * 300_000 + item + " more " * 300_000 + item).encode()
    found = decontamination.search_texts([text], decontamination.tables([("1", item)]), ["1"])
    assert found == ([900_024], [[(600_000, 600_012), (900_012, 900_024)]], [{"1"}])


def test_positions_are_skipped():
    """In a text without the benchmark's blocks every ninth word is looked at."""
    (table,) = decontamination.tables([("1", " ".join(f"q{k}" for k in range(10)))])
    seen = []
    text = decontamination.Words([b" ".join(b"z%d" % k for k in range(5000))])
    blocks = text.blocks
    text.blocks = lambda at, size: (seen.append(len(at)), blocks(at, size))[1]
    decontamination.search(text, table)
    assert sum(seen) < 5000 / 8


def test_scan_empty_tables_clashing_names_and_removal(spark):
    docs = spark.createDataFrame([(1, "one two three", 5, "k"), (2, "clean words", 6, "l")], "doc_id long, text string, n_hit int, key string")
    items = spark.createDataFrame([(1, "TWO three")], ITEM)
    assert scanned(docs, items) == [(1, 3, 2, "1"), (2, 2, 0, "")]
    assert [tuple(r) for r in decontamination.decontaminate(docs, items).collect()] == [(2, "clean words", 6, "l")]
    assert scanned(docs.limit(0), items) == [] and scanned(docs, items.limit(0)) == [(1, 3, 0, ""), (2, 2, 0, "")]


# Hard negatives

VECTOR = "vec_id long, embedding array<float>, label int"


def plain_mine(rows, positives=5, negatives=10, scale=256):
    kept = []
    for n, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((i, n, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [int(np.floor(scale * x)) for x in np.float32(v).astype(float)]))
    score = lambda a, b: sum(x * y for x, y in zip(a[3], b[3]))
    last = lambda x: (x is None, x or 0)
    out = []
    for a in kept:
        if a[0] is None or a[0] % 100:
            continue
        rest = sorted(((-score(a, b), last(b[0]), b[2] == a[2], b[0]) for b in kept if b[1] != a[1]), key=lambda t: t[:2])
        for p in [t for t in rest if t[2]][:positives]:
            near = [t for t in rest if not t[2] and 30 * -p[0] <= 100 * -t[0] <= 90 * -p[0]][:negatives]
            out += [(a[0], p[3], k + 1, t[3], -p[0], -t[0]) for k, t in enumerate(near)]
    return sorted(out, key=repr)


def mined(df, **more):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return sorted((tuple(r) for r in hard_negatives.mine(df, F.col("id") % 100 == 0, moved, **more).collect()), key=repr)


def vectors_of(kind, n=420, d=12):
    r = np.random.default_rng(3)
    v = r.normal(size=(n, d)) / d**0.5 * (np.arange(d, 0, -1) if kind == "leading" else 1)
    v = v + (np.eye(d)[r.integers(0, 4, n)] if kind == "clusters" else 0)
    if kind == "copies":
        v[n // 3 :: 2] = v[0]
    ids = [int(x) for x in r.permutation(n)]
    return [(i, [float(x) for x in row], int(r.integers(0, 4))) for i, row in zip(ids, v.astype(np.float32))]


@pytest.mark.parametrize("kind", ["plain", "leading", "clusters", "copies"])
def test_mining_is_a_plain_search(spark, kind, monkeypatch):
    monkeypatch.setattr(vectors.blocks, "__defaults__", (None, 12 * 8 * 50))  # many small blocks
    rows = vectors_of(kind)
    assert mined(spark.createDataFrame(rows, VECTOR).repartition(5)) == plain_mine(rows)


def test_mining_defined_cases(spark):
    rows = vectors_of("clusters", 150) + [(300, None, 1), (400, [1.0] * 12, None), (500, [1.0, None], 2), (600, [float("nan")] * 12, 2), (None, [0.9] * 12, 1),
            (700, [1.0, 0.5], 3), (100, [1.0] * 12, 1), (100, [1.0] * 12, 1), (800, [], 1), (900, [float("inf")] * 12, 1)]
    df = spark.createDataFrame(rows, VECTOR).withColumns({"key": F.lit("x"), "score": F.lit(1), "_label": F.lit(7)})
    assert mined(df) == plain_mine(rows)
    assert mined(df.limit(0)) == []
    assert mined(df.where("label = 1 and vec_id % 7 <> 0")) == []
    with pytest.raises(Exception, match="2\\^53|bits"):
        mined(spark.createDataFrame([(k, [3e30] * 3, 1) for k in range(3)], VECTOR))


def test_bounds_discard_pairs_before_their_whole_product():
    r = np.random.default_rng(1)
    v = np.floor(256 * r.normal(size=(2000, 32)) * np.geomspace(1, 0.01, 32)).astype(np.int64)
    axes = np.linalg.eigh(v.T @ v.astype(float))[1][:, ::-1]
    import pyarrow as pa

    of = lambda x, at: hard_negatives.Turned(pa.array(range(at, at + len(x))), pa.array([0] * len(x)), pa.array(range(at, at + len(x))), x, axes)
    a, b = of(v[:20], 0), of(v[20:], 20)
    i, j, score = hard_negatives.candidates(a, b, np.ones((20, 1980), bool), np.full((20, 1), np.iinfo(np.int64).min), None, 5)
    whole = v[:20] @ v[20:].T
    assert (score == whole[i, j]).all() and len(i) < 20 * 200
    for k in range(20):
        assert set(np.argsort(-whole[k], kind="stable")[:5]) <= set(j[i == k])


# Vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, label, [int(np.floor(4096 * x)) for x in np.float32(v).astype(float)]) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    d = max(1, -(-max(len(v) for _, _, v in kept) // parts)) * parts
    kept = [(i, label, v + [0] * (d - len(v))) for i, label, v in kept]
    w = d // parts
    part = lambda v, p: v[p * w : (p + 1) * w]
    first = sorted(kept, key=lambda t: (t[0] is None, t[0] or 0, t[2]))[:entries]
    books = [[part(v, p) for _, _, v in first] for p in range(parts)]
    near = lambda v, p: min((sum((x - y) ** 2 for x, y in zip(part(v, p), e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            of = [near(v, p)[1] for _, _, v in kept]
            mine = [[part(v, p) for (_, _, v), k in zip(kept, of) if k == e] for e in range(len(first))]
            new.append([[sum(c) // len(m) for c in zip(*m)] if m else books[p][e] for e, m in enumerate(mine)])
        books = new
    out, per = [], {}
    for i, label, v in kept:
        found = [near(v, p) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found)))
        per[label] = per.get(label, 0) + out[-1][3]
    return sorted(((i, code, e, per[label]) for i, label, code, e in out), key=repr), ",".join(str(x) for p in books for e in p for x in e)


def compressed(df):
    found, books = vector_codes.compress(df)
    return sorted((tuple(r) for r in found.select("vec_id", "code", "error", "label_error").collect()), key=repr), books


@pytest.mark.parametrize("kind", ["plain", "clusters", "copies"])
def test_codes_are_plain_codes(spark, kind, monkeypatch):
    monkeypatch.setattr(vectors.blocks, "__defaults__", (None, 16 * 8 * 30))
    rows = vectors_of(kind, 250, 16)
    told, listed = plain_codes(rows)
    found, books = compressed(spark.createDataFrame(rows, VECTOR).repartition(3))
    assert found == told and books.sha256() == hashlib.sha256(listed.encode()).hexdigest()


def test_codes_defined_cases(spark):
    rows = vectors_of("clusters", 40, 10) + [(300, None, 1), (500, [1.0, None], 2), (600, [float("nan")] * 9, 2), (None, [0.9] * 10, None), (700, [1.0, 0.5], None),
            (3, [0.25] * 10, 1), (3, [0.25] * 10, 1), (800, [], 1), (900, [float("-inf")], 1)]
    df = spark.createDataFrame(rows, VECTOR).withColumns({"code": F.lit("x"), "error": F.lit(1), "_label": F.lit(7)})
    assert compressed(df)[0] == plain_codes(rows)[0]
    assert compressed(df.where("vec_id < 9"))[0] == plain_codes([r for r in rows if r[0] is not None and r[0] < 9])[0]
    assert compressed(df.limit(0))[0] == [] and compressed(df.where("vec_id = 600"))[0] == []
    with pytest.raises(Exception, match="2\\^53|62 bits"):
        compressed(spark.createDataFrame([(k, [3e30] * 3, 1) for k in range(3)], VECTOR))


def test_trees_find_the_nearest_entry_and_leave_entries_out():
    r = np.random.default_rng(2)
    for spread in (2, 40, 4000):
        entries = r.integers(-spread, spread, (16, 3))
        entries[5] = entries[2]
        parts = np.concatenate([r.integers(-spread, spread, (3000, 3)), entries])
        d2 = ((parts[:, None] - entries) ** 2).sum(2)
        code, best, made = vector_codes.nearest(vector_codes.tree(entries), parts)
        assert (code == d2.argmin(1)).all() and (best == d2.min(1)).all()
    assert made < 0.9 * d2.size
