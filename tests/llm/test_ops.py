"""Every text operator against its SQL or a brute-force version, on whole small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdigris.llm import common, exact_dedup, licenses, line_dedup, mixing, near_dedup, packing, quality_classifier, quality_rules, simhash, suffix_dedup, toxicity
from verdigris.llm.queries import ORACLES, QUERIES, tokenizer_path

SPACE = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

LINE = "The same long line stands here"
EDGE = [
    (5, None), (3, ""), (4, " \t\n\x0b\x0c\r "), (6, LINE), (1, f" {LINE.upper()} \nown line of one\n"), (2, f"{LINE}\r\n{LINE}"), (7, "a b c"),
    (8, "A  b\tC"), (None, f"{LINE}\nÄÖÜ straße naïve"), (9, "ÄÖÜ straße naïve"), (9, "ÄÖÜ straße naïve"), (10, "x " * 9000), (11, "one two three four five six " * 30),
    (12, "under the MIT-license, Apache License, Version 2.0 and CC-BY-NC"), (13, "�​ \U0001f600 <|endoftext|> it's ½ ΣΑΣ"), (14, "short\nshort"),
]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(d, t, None, None if k % 5 == 0 else f"s{k % 4}", None) for k, (d, t) in enumerate(EDGE)]
    clashing = "kept string, score string, did long, fp long, key string, size long, y int, count long"
    extra = (None, "x", 1, 2, "k", 3, 4, 5)
    return spark.createDataFrame([r + extra for r in rows], f"{DOCS}, {clashing}").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_agrees_with_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLES[name])


def test_hash_of_the_sql():
    """The SQL's XXH64 of strings of all lengths around its blocks."""
    import duckdb

    from verdigris.llm.queries import _xxh64_sql

    some = random.Random(1)
    words = ["".join(some.choice("abcé漢 z") for _ in range(n)) for n in range(140)] + ["x" * 1000]
    con = duckdb.connect()
    con.execute("CREATE TABLE words (s VARCHAR)")
    con.executemany("INSERT INTO words VALUES (?)", [(w,) for w in words])
    found = dict(con.execute(f"WITH {_xxh64_sql('words')} SELECT s, h FROM hashed").fetchall())
    assert found == {w: xxhash.xxh64_intdigest(w.encode(), 42) for w in words}


def norm(t):
    return "".join(c for c in t if c not in SPACE)


# Exact dedup


def brute_exact(rows):
    """One row of each group is kept, also where rows repeat a doc_id."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[norm(t or "")].append((-len(t or ""), d is None, d or 0, d))
    return sorted(((x[3], min(g)[3], len(g), k == 0) for g in groups.values() for k, x in enumerate(sorted(g))), key=repr)


def test_exact_dedup_edges(edge, empty):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(edge).collect()), key=repr)
    assert got == brute_exact(EDGE)
    assert exact_dedup.dedup(empty).count() == 0


def test_exact_dedup_heavy_split(spark):
    rows = [(k, "hot  text" if k % 3 else f"cold {k // 6}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert exact_dedup.frequent_digests(exact_dedup.fingerprints(df)).where("digest is not null").count() > 0
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(df).collect()), key=repr)
    assert got == brute_exact(rows)


# Line dedup


def brute_lines(rows):
    key = lambda x: (k := x.strip(SPACE)).translate({c: c + 32 for c in range(65, 91)})  # noqa: E731,F841
    owner = {}
    holders = defaultdict(set)
    big = 1 << 62
    for d, t in rows:
        d = big if d is None else d
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                owner[key(x)] = min(owner.get(key(x), big), d)
                holders[key(x)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        me = big if d is None else d
        kept = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or owner[key(x)] == me]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_line_dedup_edges(edge, empty):
    got = line_dedup.dedup_lines(edge)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=repr) == brute_lines(EDGE)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_against_earlier_runs(spark):
    first = spark.createDataFrame([(1, LINE), (2, f"{LINE}\nanother long line")], "doc_id long, text string")
    run = line_dedup.new_run(line_dedup.claims(first))
    later = spark.createDataFrame([(0, f"{LINE}\nbrand new long line"), (1, "Another long line")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(later, runs=run).collect()} == {0: "brand new long line", 1: ""}


def test_sorted_runs_compact():
    rng = np.random.default_rng(0)
    runs, owner, lost = line_dedup.SortedRuns(), {}, Counter()
    claims = Counter()
    for _ in range(40):
        keys = rng.integers(0, 300, 50).astype("S16")
        docs = rng.integers(0, 1000, 50)
        keys, docs = (np.array(x) for x in zip(*sorted(set(zip(keys.tolist(), docs.tolist())))))
        keys = keys.astype("S16")
        claims.update(zip(keys.tolist(), docs.tolist()))
        for k, d in zip(keys.tolist(), docs.tolist()):
            owner[k] = min(owner.get(k, d), d)
        gone = runs.claim(keys, docs)
        lost.update(zip(gone[0].tolist(), gone[1].tolist()))
    held = {k: d for ks, ds in runs.runs() for k, d in zip(ks.tolist(), ds.tolist())}
    assert held == owner
    assert set(lost) == {c for c in claims if owner[c[0]] != c[1]}
    assert all(len(level) < runs.fanout for level in runs.levels) and len(runs.levels) > 1


def test_owners_of_all_tasks_merge_as_a_stream():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    rows = sorted((bytes(f"{rng.integers(0, 30):016d}", "ascii"), int(rng.integers(0, 9)), k, 0) for k in range(500))
    told, owner, seen = [], {}, set()
    for key, doc, row, _ in rows:
        told.append((row, line_dedup.OWNS if key not in owner else line_dedup.LOST if doc != owner[key] and (key, doc) not in seen else line_dedup.FOLLOWS))
        owner.setdefault(key, doc)
        seen.add((key, doc))
    for size in (1, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + size])], ["key", "did", "row", "at"]) for k in range(0, 500, size)]
        held, got = [], []
        for batch in line_dedup._merged(iter(batches)):
            held.append(batch.num_rows)
            got += zip(batch.column(2).to_pylist(), batch.column(4).to_pylist())
        assert sorted(got) == sorted(told) and max(held) <= size  # a batch goes out before the next comes in


# Quality rules


def brute_measures(t):
    words = [w for w in "".join(" " if c in SPACE else c for c in t).split(" ") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if norm(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_edges(edge, empty, spark):
    ledger = quality_rules.build_ledger(edge)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in ledger.collect()), key=repr)
    assert got == sorted(((d, *brute_measures(t or "")) for d, t in EDGE), key=repr)
    assert quality_rules.build_ledger(empty).count() == 0
    kept = quality_rules.select_passing(edge, quality_rules.STRICT)
    assert kept.columns == edge.columns
    want = quality_rules.apply_policy(ledger, quality_rules.STRICT).where("kept").count()
    assert kept.count() == want


def test_ablations(spark, sf):
    ledger = quality_rules.build_ledger(spark.read.parquet(f"{sf}/documents.parquet"))
    bits = [r.failed_bits for r in ledger.collect()]
    for r in quality_rules.ablations(ledger).collect():
        policy = next(p for p in quality_rules.POLICIES if (p.name, p.version) == (r.policy, r.version))
        bit, mask = next(1 << x.bit for x in quality_rules.RULES if x.name == r.rule), policy.mask()
        assert (r.n_failed, r.n_failed_alone, r.n_kept) == (
            sum(b & bit > 0 for b in bits), sum(b & mask == bit for b in bits), sum(b & mask == 0 for b in bits)
        )


# Suffixes


def brute_repeats(rows, keep="none", size=200):
    rows = [(d, t.encode()) for d, t in rows]
    n, first = Counter(), {}
    for k, (d, b) in enumerate(rows):
        for i in range(len(b) - size + 1):
            n[b[i : i + size]] += 1
            first.setdefault(b[i : i + size], (k, i))
    out = []
    for k, (d, b) in enumerate(rows):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            if n[w] > 1 if keep == "none" else first[w] != (k, i):
                gone[i : i + size] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((d, len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def repeats(df, keep="none"):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.remove_repeats(df, keep=keep).collect()), key=repr)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_suffix_dedup(spark, sf, texts, keep):
    assert repeats(spark.read.parquet(f"{sf}/documents.parquet"), keep) == brute_repeats(sorted(texts.items()), keep)


def test_suffix_dedup_edges(edge, empty):
    assert repeats(edge) == brute_repeats([(d, t or "") for d, t in EDGE])
    assert repeats(empty) == []


def test_suffix_dedup_periods_and_partial_overlaps(spark):
    rng = np.random.default_rng(5)
    base = "".join(rng.choice(list("abcd"), 3000))
    rows = [(k, base[a : a + n] + str(k) * 3 + base[b : b + m]) for k, (a, n, b, m) in enumerate(rng.integers(0, 1500, (40, 4)).tolist())]
    rows += [(100, "ab" * 900), (101, "ab" * 150 + "c" * 400), (102, base[:199]), (103, base[:200]), (104, "é" * 300)]
    assert repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute_repeats(rows)


def test_long_documents_are_cut_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(6)
    long = "".join(rng.choice(list("abcdefgh"), 3 * suffix_dedup.SLICE))
    rows = [(1, long), (2, "x" + long[suffix_dedup.SLICE - 150 : suffix_dedup.SLICE + 150])]
    got = {r[0]: r[1:] for r in repeats(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got[1][1:3] == (300, 1) and got[2][1:3] == (300, 1)


def test_longest_previous_factors():
    for text in (b"abababxyabab", b"aaaa", b"", b"mississippi"):
        want = [max([k for j in range(i) for k in [next(n for n in range(len(text) - i, -1, -1) if text[j : j + n] == text[i : i + n])]], default=0) for i in range(len(text))]
        assert suffix_dedup.longest_previous_factors(text) == want


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "a"])
def test_previous_factors_and_their_matches(letters):
    rng = np.random.default_rng(9)
    for n, cut in ((1, 8), (60, 8), (300, 20), (300, 200), (400, 13)):
        text = "".join(rng.choice(list(letters), n)).encode()
        places = np.sort(rng.choice(n, rng.integers(1, n + 1), replace=False))
        lengths, earlier = suffix_dedup.previous_factors(np.frombuffer(text, np.uint8), places, cut)
        common = lambda i, j: next((k for k in range(cut) if max(i, j) + k >= n or text[i + k] != text[j + k]), cut)
        for x, (i, length, match) in enumerate(zip(places.tolist(), lengths.tolist(), earlier.tolist())):
            assert length == max((common(i, j) for j in places[:x].tolist()), default=0)
            assert match < x and (length == 0 or common(i, int(places[match])) == length)


def test_nearest_smaller_of_long_rising_runs():
    rng = np.random.default_rng(4)
    for values in (np.concatenate((np.arange(1, 4000), [0], np.arange(5000, 6000))), rng.permutation(3000), np.arange(50)[::-1]):
        common = rng.integers(1, 9, len(values))
        at, least = suffix_dedup.nearest_smaller(values, common)
        for i in range(0, len(values), 7):
            j = next((j for j in range(i - 1, -1, -1) if values[j] < values[i]), -1)
            assert at[i] == j and least[i] == (min(common[j + 1 : i + 1]) if j >= 0 else 0)


# Licenses

import re  # noqa: E402


def brute_base(t):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.translate({c: c + 32 for c in range(65, 91)}))
    places = sorted((i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


def test_licenses(spark, sf, texts, edge, empty):
    got = {r.doc_id: tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) for r in QUERIES["op6_license_scan"](spark, sf).collect()}
    assert got == {d: brute_base(t) for d, t in texts.items()}
    found = licenses.scan_licenses(edge.drop("score")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found), key=repr) == sorted(((d, *brute_base(t or "")) for d, t in EDGE), key=repr)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in found)
    assert licenses.scan_licenses(empty).count() == 0


@pytest.mark.parametrize("text, labels", [
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"), ("All rights reserved.", "all-rights-reserved"),
    ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3"), ("licensed under CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa"), ("mit der license und", ""),
    ("the MIT License; released under the MIT License", "mit"), ("Mozilla Public License Version 2.0", "mpl-2"),
])
def test_license_rules(text, labels):
    assert licenses.scan(text.encode())[5] == labels
    assert len(licenses.signatures()) > 300


@pytest.mark.parametrize("text, labels", [
    ("Released under CC BY 4.0.", "cc-by"), ("distributed under GPLv3", "gpl-3"), ("available under MPL 2.0", "mpl-2"),
    ("published under CC0", "cc0-1"), ("Provided under the terms of the Apache 2.0", "apache-2"),
])
def test_grants_without_the_word_license(text, labels):
    found = licenses.scan(text.encode())
    assert found[5] == labels and found[6] == 0.95


@pytest.mark.parametrize("text, labels", [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    ("This program is free software: you can redistribute it and/or modify it", "gpl"), ("GPLv3", "gpl-3"), ("GPL-3.0-or-later", "gpl-3-or-later"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
     "Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gpl-2-or-later"),
    ("Creative Commons Attribution 4.0 International License", "cc-by"), ("distributed under GPL 3.0", "gpl-3"), ("SPDX-License-Identifier: MIT", "mit"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2"), ("under the ISC License", "isc"),
    ("text is available under the Creative Commons Attribution-ShareAlike License", "cc-by-sa"), ("LGPL-2.1-or-later", "lgpl-2.1-or-later"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"), ("released under the PostgreSQL License", "postgresql"),
    ("https://creativecommons.org/licenses/by-nc-nd/4.0/", "cc-by-nc-nd"), ("Tous droits réservés", "all-rights-reserved"), ("for non-commercial use only", "non-commercial-use"),
    ("runs under the FreeBSD kernel", ""), ("works under the MIT Media Lab", ""), ("under the PostgreSQL server process", ""), ("he was granted permission to copy", ""),
    ("a mit of wool", ""), ("the Apache tribe", ""), ("under the terms of the treaty", ""), ("distributed under the Python tree", ""), ("the rights are reserved seats", ""),
    ("driving license", ""), ("available under the zlib headers", ""), ("see the gnu grazing", ""), ("by installing the pump you agree", ""),
])
def test_labelled_license_texts(text, labels):
    assert licenses.scan(text.encode())[5] == labels


@pytest.mark.parametrize("text, labels", [
    ("Licensed under MIT", "mit"), ("MIT-licensed code", "mit"), ("it is under the GPL", "gpl"), ("Eclipse Public License - v 2.0", "epl-2"),
    ("Mozilla Public License, v. 2.0", "mpl-2"), ("MIT OR Apache-2.0", "apache-2,mit"), ("dual licensed under MIT and Apache 2.0", "apache-2,mit"),
    ("GNU General Public License v3.0", "gpl-3"), ("GNU GPL v2 or later", "gpl-2-or-later"), ("GPL v3 or any later version", "gpl-3-or-later"),
    ("under the terms of the GPL v2", "gpl-2"), ("Eclipse Public License - v 1.0", "epl-1"), ("do not redistribute this file", "no-redistribution"),
    ("do not redistribute wealth", ""), ("no redistribution of seats in the commons", ""), ("may not be redistributed", "no-redistribution"),
])
def test_short_forms_and_versions(text, labels):
    assert licenses.scan(text.encode())[5] == labels


def test_scan_is_every_signature_with_plain_suppression(texts):
    """Without keywords, and with every pair of places compared."""
    some = [t for _, t in sorted(texts.items())] + [f"x {a} y {b}" for a in ("GPLv3", "Licensed under MIT", "CC BY-NC-SA 4.0") for b in ("or later", "License", "All rights reserved")]
    labels = 0
    for text in some:
        low = text.encode().lower()
        found = [licenses.Detection(*m.span(), r.label, r.priority, r.confidence, r.base) for r in licenses.signatures() for m in r.expression.finditer(low)]
        plain = [(i, d) for i, d in enumerate(found) if not d.base]
        inside = lambda d, o: o.start <= d.start and d.end <= o.end
        kept, gone = [d for d in found if d.base], set()
        for p in sorted({d.priority for _, d in plain}, reverse=True):
            level = [(i, d) for i, d in plain if d.priority == p]
            alive = [(i, d) for i, d in level if not any(inside(d, o) for o in kept if not o.base)]
            for i, d in alive:
                if any(inside(d, o) and ((o.end - o.start) > (d.end - d.start) or j < i) for j, o in alive if j != i and inside(d, o)):
                    gone.add(i)
            kept += [d for i, d in alive if i not in gone]
        assert licenses.scan(text.encode())[5] == ",".join(sorted({d.label for d in kept})), text
        labels += bool(kept)
    assert labels > 8


def test_signatures_are_written_by_hand():
    from verdigris.llm.license_rules import rules

    written = rules()
    assert len(written) > 300 and len({r[3] for r in written}) == len(written)
    assert all(re.search("<[^>]+>", r[3]) and 0 < r[2] <= 1 for r in written)


def a_match(parsed, rng):
    """A text that the parsed expression matches, by chance."""
    out = b""
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out += bytes([arg])
        elif op == "IN":
            out += b" " if str(arg[0][0]) == "NEGATE" else bytes([rng.choice(arg)[1]])
        elif op == "BRANCH":
            out += a_match(rng.choice(arg[1]), rng)
        elif op == "MAX_REPEAT":
            out += b"".join(a_match(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 1))))
        elif op == "SUBPATTERN":
            out += a_match(arg[-1], rng)
        else:
            assert op == "ASSERT_NOT"
    return out


def test_keywords_are_in_every_match():
    rng = random.Random(1)
    for rule in licenses.signatures():
        parsed = re._parser.parse(rule.expression.pattern)
        for _ in range(30):
            text = a_match(parsed, rng)
            assert rule.expression.fullmatch(text) and all(k in text for k in rule.keywords), (rule, text)
            assert any(d.label == rule.label and d.end == len(text) for d in licenses.detections(text))


def test_suppression_keeps_the_outer_place():
    d = lambda s, e, p: licenses.Detection(s, e, f"{s}-{e}", p, 0.5, False)
    found = [d(0, 10, 5), d(2, 4, 9), d(3, 4, 9), d(0, 3, 5), d(2, 4, 1), d(8, 12, 5)]
    assert {x.label for x in licenses.suppress(found)} == {"0-10", "2-4", "8-12"}


# Packing


def test_word_cache_gives_the_tokenizers_ids(texts):
    words = packing.WordIds(tokenizer_path(), cached=500)
    assert words.merges is not None
    odd = [t or "" for _, t in EDGE] + ["a\x7fb", "don't STOP 'S they'RE", "İ ΣΑΣ é é ﬁ", "\tx\x1cz y", "½x² µm a\xa0b\x85c\xadd", "ÿÿ \xff", "<|startoftext|>Hi", "日本語 テキスト"]
    for t in [*odd, *texts.values()]:
        assert words.of([t])[0] == words.encode(t)


def test_every_vocabulary_entry_is_merged_by_its_own_merge():
    """What makes the two ways of merging agree: each entry, alone, comes from the pair that is listed for it."""
    import json

    told = json.loads(packing.WordIds(tokenizer_path()).tokenizer.to_str())["model"]
    rank = {tuple(m): k for k, m in enumerate(told["merges"])}
    for a, b in told["merges"]:
        whole = a + b
        core, end = (whole[:-4], "</w>") if whole.endswith("</w>") else (whole, "")
        parts = list(core)
        parts[-1] += end
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 30))
            assert (parts[best], parts[best + 1]) in rank
            if len(parts) == 2:
                assert tuple(parts) == (a, b)
            parts[best : best + 2] = [parts[best] + parts[best + 1]]


def check_pieces(pieces, ids_of):
    """Pieces give every document's ids back, and sequences are gapless."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert {d: len(v) for d, v in docs.items()}.keys() == ids_of.keys()
    for d, parts in docs.items():
        ids, at = ids_of[d], 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) // 4
            assert zlib.crc32(ids[4 * at : 4 * (at + r.length)]) == r.ids_crc32
            at += r.length
        assert 4 * at == len(ids)
    padding = 0
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= packing.WINDOW
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    assert padding == 0


def test_packing(spark, sf, texts):
    words = packing.WordIds(tokenizer_path())
    ids = {d: words.encode(t) + b"\x02\0\0\0" for d, t in texts.items()}
    check_pieces(QUERIES["op7_packing"](spark, sf).collect(), ids)


def test_packing_edges(edge, empty):
    words = packing.WordIds(tokenizer_path())
    pieces = packing.pack(edge, tokenizer_path()).collect()
    rest = [r for r in pieces if r.doc_id not in (None, 9)]
    assert {r.doc_id for r in rest} == {d for d, _ in EDGE} - {None, 9}
    assert sum(r.length for r in pieces) == sum(len(words.encode(t or "")) // 4 + 1 for _, t in EDGE)
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_level_choice_is_the_sum_of_squares():
    rng = np.random.default_rng(1)
    packer = packing.Packer(window=24)
    for _ in range(300):
        size = int(rng.integers(1, 24))
        n = packer.counts.copy()
        def after(h):
            m = n.copy()
            m[h] -= h > 0
            m[h + size] += h + size < 24
            return int((m[1:24] ** 2).sum())
        choices = {h: after(h) for h in [0, *np.flatnonzero(n[: 25 - size])] if h + size <= 24}
        assert choices[packer.best_level(size)] == min(choices.values())
        list(packer.take((0, size), bytes(4 * size)))


def test_many_open_windows_are_drained():
    packer, out = packing.Packer(window=64, max_open=8), []
    sizes = [40] * 200
    for k, n in enumerate(sizes):
        out += list(packer.take((k, n), bytes(4 * n)))
        assert packer.open <= 9
    out += list(packer.finish())
    assert sum(len(p[2]) for _, pieces in out for p in pieces) == 4 * sum(sizes)
    assert len({n for n, _ in out}) == len(out)


# Mixing


def test_mixing_edges(edge, empty):
    rows = mixing.plan(edge).collect()
    assert len(rows) == len(EDGE)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    per = defaultdict(list)
    for r in rows:
        per[r.source].append(r)
    for rs in per.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 0.5 and rs[0].source_size == sum(r.size for r in rs)
    assert mixing.plan(empty).count() == 0
    assert mixing.mix(empty).count() == 0


def test_mix_orders_copies_by_the_schedule(spark):
    rows = [(k, "w " * (5 + k % 7), "en", f"s{k % 3}", 1) for k in range(600)]
    df = spark.createDataFrame(rows, DOCS)
    taken = mixing.copies(mixing.plan(df))
    assert taken.where("position < 0 or position > 1").count() == 0
    early = {r.schedule: r.m for r in taken.groupBy("schedule").agg(F.avg("position").alias("m")).collect()}
    assert early[1] < early[0] < early[2]
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    n = Counter(r.doc_id for r in mixed.collect())
    assert max(n.values()) <= 2
    assert [tuple(r) for r in mixing.mix(df).collect()] == [tuple(r) for r in mixed.collect()]


def brute_positions(docs):
    """Per doc_id the training positions of its copies, by walking the integrated schedules in small steps."""
    per, out = defaultdict(list), {}
    for r in docs:
        per[r.source].append(r)
    for rank, source in enumerate(sorted(per)):
        a, b = mixing.SCHEDULES[rank % 3]
        t = np.linspace(0, 1, 20001)
        demand = np.concatenate(([0], np.cumsum((a + (b - a) * (t[1:] + t[:-1]) / 2) / 20000))) / ((a + b) / 2)
        stream = sorted(per[source], key=lambda r: (hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id)) * 2
        asked, done = math.floor(stream[0].target + 0.5), 0
        for r in stream:
            words = min(r.size, asked - done)
            if words > 0:
                out.setdefault(r.doc_id, []).append(float(np.interp((done + words / 2) / asked, demand, t)))
            done += r.size
    return out


def test_op9_rows_stand_in_training_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_positions(mixing.plan(docs).collect())
    rows = mixing.curriculum(docs).collect()
    assert {r.doc_id: r.positions for r in rows if r.positions} == {d: pytest.approx(p, abs=1e-6) for d, p in want.items()}
    assert all((r.position is None) == (r.taken == 0) for r in rows) and {len(r.positions) for r in rows} >= {0, 2}
    first = [want.get(r.doc_id, [2.0])[0] for r in QUERIES["op9_mixing"](spark, sf).collect()]
    assert len(first) == docs.count() and np.all(np.diff(first) > -2e-6)
    assert mixing.curriculum(docs).where("position IS NULL").select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1000, 1, 1, 1], [1, 1, 1000, 5, 0, 7], [0, 0]])
def test_targets_are_filled_up(spark, sizes):
    rows = [(k, "w " * n, "en", f"s{k}", 1) for k, n in enumerate(sizes)]
    found = {r.source: r.target for r in mixing.targets(mixing.sizes(spark.createDataFrame(rows, DOCS))).collect()}
    weight = [mixing.WEIGHTS[k % 3] for k in range(len(sizes))]
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = 1.5 * sum(sizes) - sum(2 * sizes[k] for k in range(len(sizes)) if k not in open_)
        share = {k: left * weight[k] / sum(weight[j] for j in open_) for k in open_}
        above = {k for k in open_ if share[k] > 2 * sizes[k]}
        if not above:
            break
        open_ -= above
    target = [share[k] if k in open_ else 2 * sizes[k] for k in range(len(sizes))]
    assert [found[f"s{k}"] for k in range(len(sizes))] == pytest.approx(target)


# SimHash


def brute_print(t):
    words = t.encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Per position of (id, fingerprint) the smallest id that is reachable."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    v = np.array([p for _, p in prints], np.uint64)
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= 3):
            root[find(int(j))] = find(i)
    least = {}
    for i, (d, _) in enumerate(prints):
        least[find(i)] = min(least.get(find(i), 1 << 62), 1 << 62 if d is None else d)
    return [None if least[find(i)] == 1 << 62 else least[find(i)] for i in range(len(prints))]


def test_simhash(spark, sf, texts, edge, empty):
    for rows, df in ((list(texts.items()), spark.read.parquet(f"{sf}/documents.parquet")), ([(d, t or "") for d, t in EDGE], edge)):
        prints = [(d, brute_print(t)) for d, t in rows]
        want = sorted(((d, f"{p:016x}", c) for (d, p), c in zip(prints, brute_components(prints))), key=repr)
        assert sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=repr) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("dense", [False, True])
def test_trie_links_lose_nothing(dense):
    rng = np.random.default_rng(2)
    v = rng.integers(0, 1 << 64, 1500, dtype=np.uint64)
    for i in range(1, 700):
        flips = rng.choice(64, rng.integers(1, 6 if dense else 4), replace=False)
        v[i] = (v[0] if dense else v[i - 1 + i % 2]) ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64))
    v = np.unique(v)
    edges = []
    for k in range(simhash.BLOCKS):
        s, back = np.uint64(16 * k), np.uint64((64 - 16 * k) % 64)
        turned = np.unique(v << s | v >> back if k else v)
        root = simhash.trie_links(turned, 16)
        plain = turned >> s | turned << back if k else turned
        edges += [(int(plain[i]), int(plain[r])) for i, r in enumerate(root) if i != r]
    assert all((a ^ b).bit_count() < 64 for a, b in edges)
    ids = {int(x): i for i, x in enumerate(v)}
    forest = simhash.Forest(len(v))
    forest.link(np.array([ids[a] for a, _ in edges]), np.array([ids[b] for _, b in edges]))
    want = brute_components([(i, int(x)) for i, x in enumerate(v)])
    assert forest.root.tolist() == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(60)] + [(100, 101)], "u long, v long")
    found = {r.u: r.v for r in simhash.components(edges).collect()}
    assert found == {k: 0 for k in range(1, 61)} | {101: 100}


# Near-dedup of the pipeline


def brute_similar(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(a & b) >= 0.8 * len(a | b)


def test_near_dedup_finds_every_similar_pair(spark):
    import corpus_pipeline

    rng = random.Random(3)
    docs = []
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 200))]
        for _ in range(rng.randrange(1, 6)):
            docs.append(" ".join(words))
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = "edited"
    docs += ["one common line " * 3 + d for d in docs[:20]] + ["", " ", "a b"]
    want = [(d, x) for d, x in enumerate(docs)]
    rng.shuffle(want)
    root = list(range(len(docs)))
    pairs = [(i, j) for j in range(len(docs)) for i in range(j) if brute_similar(docs[i], docs[j])]
    for _ in docs:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    df = spark.createDataFrame([(d, x, "en", "s", 1) for d, x in want], DOCS)
    assert len(pairs) > 20 and sum((brute_print(docs[i]) ^ brute_print(docs[j])).bit_count() > 3 for i, j in pairs) > 10
    assert {r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, df, "").collect()} == set(root)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 3000), st.integers(0, 3000), st.integers(0, 3000), st.integers(0, 99))
def test_sketches_never_differ_more_than_sets(common, mine, theirs, seed):
    rng = np.random.default_rng(seed)
    x, y, z = (rng.integers(-(1 << 63), (1 << 63) - 1, n) for n in (common, mine, theirs))
    a, b = np.unique(np.concatenate((x, y))), np.unique(np.concatenate((x, z)))
    bits = near_dedup.differing_bits(near_dedup.sketch(a), near_dedup.sketch(b))
    assert bits == near_dedup.differing_bits(near_dedup.sketch(b), near_dedup.sketch(a)) <= len(np.setxor1d(a, b))
    assert common or min(mine, theirs) < 50 or bits > 0


# Classifiers


def held_out(spark, sf, name, label):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", label)
    return QUERIES[name](spark, sf).join(labels, "doc_id").where("held_out").select("predicted", label).collect()


def test_classifiers_on_held_out_rows(spark, sf):
    small = sf.replace("sf0.001", "sf0.01")
    rows = held_out(spark, small, "op1_quality_classifier", "quality")
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    rows = held_out(spark, small, "op8_toxicity", "toxic")
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.9


@pytest.mark.parametrize("module", [quality_classifier, toxicity])
def test_classifier_edges(spark, edge, empty, module):
    label = {quality_classifier: "quality", toxicity: "toxic"}[module]
    labels = spark.createDataFrame([(d, k % 2) for k, (d, _) in enumerate(EDGE)] + [(1, None)], f"doc_id long, {label} int")
    for given in (labels, labels.limit(0), labels.withColumn(label, F.lit(1))):
        scored = module.score(edge, module.fit(edge, given, label)).collect()
        assert len(scored) == len(EDGE) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in scored)
    assert module.score(empty, module.fit(empty, labels, label)).count() == 0


def test_ftrl_learns_a_word():
    rng = np.random.default_rng(0)
    ftrl = toxicity.Ftrl(alpha=2.0, l1=2.0, l2=0.02)
    draw = lambda y: np.unique(np.concatenate([[0], rng.integers(10, 5000, 30), [7] if y else []]).astype(np.int32))
    for k in range(600):
        ftrl.learn(draw(k % 5 == 0), int(k % 5 == 0))
    model = ftrl.model()
    assert len(model.coordinates) < 200 and model.dense()[7] > 1


def test_staged_tables_can_be_cleared(spark):
    from verdigris.llm.common import clear_staged, stage

    made = stage(spark.range(3), "test-staged")
    assert made.count() == 3 and made.inputFiles()
    assert clear_staged(spark) >= 1 and clear_staged(spark) == 0


# The pipeline


def test_pipeline(spark, sf, texts):
    import corpus_pipeline
    from verdigris.llm.common import read_table, stage

    docs = read_table(spark, sf, "documents")
    tables = [docs]
    for name, function in corpus_pipeline.STAGES:
        tables.append(stage(function(spark, tables[-1], sf), "test-pipeline"))
    start, rules, lines, near, mixed, packed = tables
    assert all(t.columns == start.columns for t in tables[:-1])
    kept = {r.doc_id for r in quality_rules.apply_policy(quality_rules.build_ledger(start), quality_rules.STRICT).where("kept").collect()}
    assert {r.doc_id for r in rules.collect()} == kept
    got = {r.doc_id: (r.text, r.n_chars) for r in lines.collect()}
    assert got == {d: (t, len(t)) for d, t, _, _ in brute_lines([(d, texts[d]) for d in kept])}
    prints = [(d, brute_print(t)) for d, (t, _) in got.items()]
    firsts = set(brute_components(prints))
    assert {r.doc_id for r in near.collect()} == firsts
    plan = {r.doc_id: r for r in mixing.plan(near).collect()}
    n = Counter(r.doc_id for r in mixed.collect())
    assert all(abs(n[d] * r.size - r.taken) <= r.size / 2 for d, r in plan.items())
    assert {r.text for r in mixed.collect()} <= {t for t, _ in got.values()}
    words = packing.WordIds(tokenizer_path())
    assert sum(r.length for r in packed.collect()) == sum(k * (len(words.encode(got[d][0])) // 4 + 1) for d, k in n.items())
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "start", "length").collect())) == sorted((r.doc_id, r.start, r.length) for r in packed.collect())


def test_pipeline_edges(spark, edge, empty):
    import corpus_pipeline
    from verdigris.llm.common import stage

    for docs in (edge, empty):
        rules = corpus_pipeline.STAGES[0][1](spark, docs, "")
        assert rules.columns == docs.columns and rules.count() <= docs.count()
        n = [docs.count()]  # go on with all of them
        for k, (_, function) in enumerate(corpus_pipeline.STAGES[1:]):
            columns, docs = docs.columns, stage(function(spark, docs, ""), "test-pipeline")
            assert k == 3 or docs.columns == columns
            n.append(docs.count())
        assert n[0] == n[1] >= n[2] and (n[0] == 0) == (n[4] == 0)


def test_repeated_ids_are_documents_of_their_own(spark):
    rows = [(1, f"{k} " + "word " * 20, "en", "s", 1) for k in range(4)] + [(None, "nobody knows the owner of this one", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    mixed = Counter(r.text for r in mixing.mix(df).collect())
    assert set(mixed) == {r[1] for r in rows} and max(mixed.values()) <= 2
    same = spark.createDataFrame([(1, "a b c d", "en", "s", 1), (1, "a b c d", "en", "s", 1), (2, "e f g h", "en", "s", 1)], DOCS)
    assert sorted(r.text for r in simhash.keep_first(same).collect()) == ["a b c d", "e f g h"]


def test_packed_sequences_follow_the_curriculum(spark, sf):
    import corpus_pipeline
    from verdigris.llm.common import read_table, stage

    docs = read_table(spark, sf, "documents")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = {r.doc_id: r for r in mixing.plan(docs).collect()}
    want = defaultdict(Counter)
    for d, positions in brute_positions(list(size.values())).items():
        words = size[d].taken
        for k, p in enumerate(positions):
            n = min(size[d].size, words - k * size[d].size)
            if 2 * n >= size[d].size:
                want[min(int(p * parts), parts - 1)][d] += 1
    mixed = stage(corpus_pipeline.STAGES[3][1](spark, docs, sf), "test-order")
    got = defaultdict(Counter)
    for r in corpus_pipeline.STAGES[4][1](spark, mixed, sf).collect():
        if r.start == 0:
            got[packing.file_of(r.sequence_id)][r.doc_id] += 1
    assert got == want and len(got) == parts


def test_order_is_never_lost_in_silence(spark, edge, tmp_path):
    assert packing.written_order(edge) is None  # no files: the order is that of the partitions
    rows = spark.createDataFrame([(k, f"text number {k}") for k in range(8)], "doc_id long, text string").repartition(2)
    rows.write.parquet(f"{tmp_path}/t")
    old = sorted(tmp_path.glob("t/part-*.parquet"))
    old[0].rename(tmp_path / "t/part-600000-x.c000.snappy.parquet")
    old[1].rename(tmp_path / "t/part-16777215-x.c000.snappy.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/t")
    assert {packing.file_of(r.sequence_id) for r in packing.pack(docs, tokenizer_path(), part=packing.written_order(docs)).collect()} == {600_000, 16_777_215}
    (tmp_path / "t/part-16777215-x.c000.snappy.parquet").rename(tmp_path / "t/part-16777216-x.c000.snappy.parquet")
    with pytest.raises(ValueError, match="can't be packed"):
        packing.written_order(spark.read.parquet(f"file://{tmp_path}/t"))
    (tmp_path / "t/part-16777216-x.c000.snappy.parquet").rename(tmp_path / "t/other.parquet")
    with pytest.raises(ValueError, match="names"):
        packing.written_order(spark.read.parquet(f"file://{tmp_path}/t"))


def test_sequences_rise_with_their_first_document():
    rng = np.random.default_rng(7)
    packer, first = packing.Packer(window=64), {}
    closed = []
    for k in range(400):
        n = int(rng.integers(1, 150))
        closed += packer.take((k, n), bytes(4 * n))
    kept = len(closed)
    closed += packer.finish()
    first = {number: pieces[0][0][0] for number, pieces in closed[:kept]}
    assert kept > 200 and [first[n] for n in sorted(first)] == sorted(first.values())
    assert min(n for n, _ in closed[kept:]) > max(first)


# Classifiers against plain versions


def test_word_vectors_of_all_documents(spark, sf, texts):
    q = quality_classifier
    index, total = q.index_vectors(), np.zeros((q.VOCABULARY, q.SIZE))
    rows = [*texts.items(), (10**6, " ".join(f"w{k % 97}" for k in range(2 * q.CHUNK + 7)))]
    for _, t in rows:
        words = [int(x) for x in q.coordinates(t.encode())[0]]
        if len(words) < 3000 or len(words) > q.CHUNK:
            vectors = index[words] if words else index[:0]
            around = np.zeros_like(vectors)
            for k in range(1, q.AROUND + 1):
                around[k:] += vectors[:-k]
                around[:-k] += vectors[k:]
            np.add.at(total, words, around)
        else:
            for i, w in enumerate(words):
                for j in (*range(max(0, i - q.AROUND), i), *range(i + 1, min(len(words), i + q.AROUND + 1))):
                    total[w] += index[words[j]]
    want = [v / max(1, math.sqrt(sum(x * x for x in v))) + i / 2 for v, i in zip(total, index)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert np.allclose(q.word_vectors(df), want, atol=1e-5)


def test_quality_scores_are_those_of_a_plain_network(spark, sf, texts):
    q = quality_classifier
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    m = q.fit(docs, labels)
    got = {r.doc_id: r.score for r in QUERIES["op1_quality_classifier"](spark, sf).collect()}
    for d, t in list(texts.items())[:60]:
        letters, extra, n = q.coordinates(t.encode())
        x = [0.0] * (2 * q.SIZE + 1)
        for k in range(q.SIZE if n else 0):
            x[k] = sum(float(m.vectors[w][k]) for w in letters) / n
            x[q.SIZE + k] = sum(float(m.vectors[w][k]) for w in extra) / n
        x[-1] = math.log(1 + n)
        x = [(a - b) / c for a, b, c in zip(x, m.mean, m.scale)]
        hidden = [math.tanh(sum(a * float(w) for a, w in zip(x, m.w1[:, j])) + float(m.b1[j])) for j in range(q.HIDDEN)]
        logit = sum(h * float(w) for h, w in zip(hidden, m.w2)) + m.b2
        assert got[d] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, logit / m.temperature)))), abs=1e-3)


def test_toxicity_weights_are_those_of_a_plain_ftrl(spark, sf, texts):
    t = toxicity
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic is not None}
    learnt = {d: y for d, y in labels.items() if zlib.crc32(str(d).encode()) % t.MODULUS != t.HELD_OUT and d in texts}
    order = spark.createDataFrame([(d,) for d in learnt], "doc_id long").orderBy(F.xxhash64("doc_id", F.lit("toxic")), "doc_id").collect()
    rows = [(sorted({int(x) for x in t.features(texts[r.doc_id].encode())}), learnt[r.doc_id]) for r in order]
    z, n, l1 = defaultdict(float), defaultdict(float), max(1.0, t.L1_ROOT * len(rows) ** 0.5)

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((t.BETA + math.sqrt(n[i])) / t.ALPHA + t.L2)

    for _ in range(t.EPOCHS):
        for at, y in rows:
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-max(-30, min(30, sum(w.values()))))) - y
            for i in at:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / t.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    scored = {r.doc_id: r.score for r in QUERIES["op8_toxicity"](spark, sf).collect()}
    for d, text in texts.items():
        logit = sum(weight(int(i)) for i in set(t.features(text.encode()).tolist()))
        assert scored[d] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, logit)))), abs=1e-4)


# Names and ids of the caller

OWN_NAMES = (
    "_row _row_ _kept _id _position _epoch _lost_at _lost_row _lost_keys _lost_did _lines _licenses _w _h _l _m _s _p _rest _body _gone _did _cut _copy _copies "
    "did row at fate key fp digest h n i c u v root low bucket offset inside words_before rank_key copy_words position epoch size taken target schedule sets "
    "component first block k turn y vectors part window kh sh pos failed words _metadata _ID _Position"
).split()


@pytest.fixture(scope="module")
def odd(spark):
    """Every name that operators use inside, ids at both ends of the range, null and repeated ids."""
    ids = [None, None, 5, 5, (1 << 63) - 1, -(1 << 63), 0]
    texts = [f"{LINE}\nhere is line number {k} of its own and it goes on\n" + " ".join(f"w{(7 * k + j) % 50}" for j in range(30)) for k in range(len(ids))]
    names = [c for k, c in enumerate(OWN_NAMES) if c.lower() not in {x.lower() for x in OWN_NAMES[:k]}]
    rows = [(d, t, "en", f"s{k % 2}", None, *[f"{c}{k}" for c in names]) for k, (d, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, f"{DOCS}, " + ", ".join(f"`{c}` string" for c in names)).repartition(2)


def kept_as_they_are(found, docs, but=("text", "n_chars")):
    """The rows of found are rows of docs in all columns but some."""
    columns = [c for c in docs.columns if c not in but]
    have = Counter(tuple(r) for r in docs.select(columns).collect())
    got = Counter(tuple(r) for r in found.select(columns).collect())
    return set(got) <= set(have) and got


def test_line_dedup_of_odd_names_and_ids(odd):
    got = line_dedup.dedup_lines(odd)
    assert got.columns == [*odd.columns, "n_lines", "n_dropped"] and sum(kept_as_they_are(got, odd).values()) == 7
    holders = {r.doc_id for r in got.collect() if LINE in r.text}
    assert holders == {-(1 << 63)}


@pytest.mark.parametrize("ids", [[None, 1], [None, None, (1 << 63) - 1], [(1 << 63) - 1, 7], [None, (1 << 63) - 1, -(1 << 63)]])
def test_null_ids_come_after_the_largest(spark, ids):
    df = spark.createDataFrame([(d, f"{LINE}\n{k}") for k, d in enumerate(ids)], "doc_id long, text string")
    least = min((d for d in ids if d is not None))
    assert {r.doc_id for r in line_dedup.dedup_lines(df).collect() if LINE in r.text} == {least}
    assert {r.keep_id for r in exact_dedup.dedup(df.withColumn("text", F.lit("same"))).collect()} == {least}
    assert {r.component_id for r in simhash.near_duplicates(df.withColumn("text", F.lit("same text here"))).collect()} == {least}


def test_only_null_ids_have_no_component(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), ((1 << 63) - 1, "x y z")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr) == [((1 << 63) - 1, (1 << 63) - 1), (None, None), (None, None)]


def test_one_of_equal_rows_is_kept(spark):
    df = spark.createDataFrame([(1, "same  text"), (1, "same  text"), (1, "same  text"), (2, "sametext")], "doc_id long, text string")
    rows = exact_dedup.dedup(df).collect()
    assert sum(r.kept for r in rows) == 1 and {r.keep_id for r in rows} == {1} and {r.group_size for r in rows} == {4}


def test_operators_on_odd_names_and_ids(odd):
    ledger = quality_rules.build_ledger(odd)
    assert ledger.count() == 7 and set(odd.columns) - {"text"} < set(ledger.columns)
    assert sum(kept_as_they_are(ledger, odd).values()) == 7
    assert kept_as_they_are(quality_rules.select_passing(odd, quality_rules.STRICT), odd, ())
    for frame in (near_dedup.keep_first(odd), simhash.keep_first(odd), mixing.mix(odd)):
        assert frame.columns == odd.columns and kept_as_they_are(frame, odd, ())
    scanned = licenses.scan_licenses(odd)
    assert scanned.columns[: len(odd.columns)] == odd.columns and kept_as_they_are(scanned, odd, ())
    for frame in (exact_dedup.dedup(odd), simhash.near_duplicates(odd), suffix_dedup.remove_repeats(odd), mixing.curriculum(odd)):
        assert Counter(r.doc_id for r in frame.collect()) == Counter(r.doc_id for r in odd.select("doc_id").collect())
    assert {r.doc_id for r in packing.pack(odd, tokenizer_path()).collect()} == {r.doc_id for r in odd.collect()}
    labels = odd.select("doc_id", F.lit(1).alias("toxic"), F.lit(0).alias("quality"))
    assert toxicity.score(odd, toxicity.fit(odd, labels)).count() == 7
    assert quality_classifier.score(odd, quality_classifier.fit(odd, labels)).count() == 7


def test_a_text_of_many_megabytes(spark):
    rng = random.Random(2)
    line = lambda: " ".join(f"w{rng.randrange(99999)}" for _ in range(8))
    shared = [line() for _ in range(60_000)]
    rows = [(1, "\n".join(shared)), (2, "\n".join(x for s in shared for x in (s, line()))), (3, "short one of a few words and no more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df).collect()} == {1: (60_000, 0), 2: (120_000, 60_000), 3: (1, 0)}
    assert near_dedup.keep_first(df).count() == 3 and quality_rules.build_ledger(df).count() == 3
    assert {r.doc_id: r.n_removed > 0 for r in suffix_dedup.remove_repeats(df).collect()} == {1: False, 2: False, 3: False}
    assert exact_dedup.dedup(df).count() == simhash.near_duplicates(df).count() == 3
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 4)], "doc_id long, quality int, toxic int")
    for module in (quality_classifier, toxicity):
        assert all(0 <= r.score <= 1 for r in module.score(df, module.fit(df, labels)).collect())
    sourced = df.withColumn("source", F.lit("web"))
    assert sorted(r["size"] for r in mixing.curriculum(sourced).collect()) == [9, 480_000, 960_000]
    assert licenses.scan_licenses(df).count() == 3 and packing.pack(df, tokenizer_path()).where("start = 0").count() == 3


def test_line_store_keeps_levels(spark):
    store = line_dedup.LineStore(spark, f"lines_{random.randrange(1 << 40)}", buckets=4, fanout=2)
    seen = set()
    for k in range(5):
        mine = [f"line number {k} that is new", f"line number {k // 2} that is new", LINE]
        df = spark.createDataFrame([(k, "\n".join(mine))], "doc_id long, text string")
        got = store.dedup(df).first()
        want = [x for x in mine if x not in seen]
        assert got.text == "\n".join(want) and got.n_dropped == len(mine) - len(want)
        seen |= set(mine)
    levels = store.levels()
    assert {level: len(tables) for level, tables in levels.items()} == {0: 1, 2: 1}
    assert sum(spark.table(t).count() for ts in levels.values() for t in ts) == len(seen)


def test_worker_memory_is_given_back():
    made = []
    one = common.kept("a", lambda: made.append(1) or object())
    assert common.kept("a", object) is one and made == [1]
    common.release()
    assert common.kept("a", object) is one  # stays for the operator's next task
    other = common.kept("b", object)
    assert other is not one and common.kept("a", object) is not one  # one thing at a time
    common.release(all_of_it=True)
    assert not common._KEPT
