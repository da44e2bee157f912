"""The operators over whole tables, by query name, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..context import shared_dir
from . import decontamination, exact_dedup, hard_negatives, licenses, line_dedup, mixing, packing, quality_classifier, quality_rules, simhash
from . import suffix_dedup, toxicity, vector_codes
from .common import read_table
from .labelled import remainder


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit(docs, read_table(spark, sf_dir, "labels"))
    held_out = F.coalesce(remainder(F.col("doc_id"), quality_classifier.MODULUS) == quality_classifier.HELD_OUT, F.lit(False))
    return quality_classifier.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality_rules.build_ledger(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ~quality_rules.passes(quality_rules.BASE)
    return quality_rules.apply_policy(ledger, quality_rules.STRICT).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed_bits"
    )


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every rule of every policy costs, from the stored ledger."""
    ledger = quality_rules.build_ledger(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    stored = quality_rules.store_ledger(ledger, f"{shared_dir(spark)}/quality-ledger-{uuid.uuid4().hex}")
    return quality_rules.ablations(stored.read())


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(read_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    held_out = F.coalesce(remainder(F.col("doc_id"), toxicity.MODULUS) == toxicity.HELD_OUT, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.curriculum(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, moved)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(read_table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_line_dedup": op2_line_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_simhash": op10_simhash,
    "op11_decontamination": op11_decontamination,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_vector_codes": op13_vector_codes,
    "quality_rule_ablations": quality_rule_ablations,
}

_SPACE = r"[\x20\x09-\x0D]"

_LEDGER = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM base WHERE len(ws) >= 5)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 5) AS r(k) GROUP BY doc_id
), m AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM base LEFT JOIN covered USING (doc_id)
), bits AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
          + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 10 * n_upper > 3 * word_chars THEN 8 ELSE 0 END)
          + (CASE WHEN 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END)
          + (CASE WHEN word_chars > 12 * n_words THEN 64 ELSE 0 END) AS failed_bits FROM m
)
"""


def _codes_sql(rounds: int = 6) -> str:
    """SQL with a step for each round."""
    nearest = """SELECT vec_id, label, p, v, min_by(struct_pack(e := e, d := d), (d, e)) AS best FROM (
    SELECT q.*, c.e, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i]))) AS BIGINT) AS d
    FROM parts q JOIN c{k} c USING (p)) GROUP BY vec_id, label, p, v"""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED ({nearest.format(k=k)})")
        steps.append(f"""m{k} AS (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
    SELECT p, best.e AS e, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{k}, range(1, (SELECT max(len(v)) FROM parts) + 1) AS t(i) GROUP BY 1, 2, 3) GROUP BY p, e)""")
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m USING (p, e))")
    steps = steps[:-2]
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, label, p, q[p * len(q) // 8 + 1:(p + 1) * len(q) // 8] AS v FROM kept, range(0, 8) AS t(p)
), c0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM parts QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 16
), {", ".join(steps)}, coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg('0' || substr('0123456789abcdef', CAST(best.e AS INT) + 1, 1), '' ORDER BY p) AS code,
         CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256
FROM coded"""

#: Fixed values of XXH64: its five primes.
_PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _xxh64_sql(words: str, seed: int = 42) -> str:
    """Steps that end in `hashed (s, h)`: the unsigned XXH64 of every s of a step, by its UTF-8 bytes."""
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in _PRIMES)
    space = "18446744073709551616::UHUGEINT"  # 2^64

    def low(x: str) -> str:
        return f"CAST(({x}) % {space} AS UBIGINT)"

    def rotated(x: str, by: int) -> str:
        shifted = f"(({x})::UHUGEINT * {1 << by}::UHUGEINT)"
        return f"({shifted} % {space} + {shifted} // {space})"

    def number(at: str, width: int) -> str:
        return f"CAST('0x' || {' || '.join(f'substr(x, 2 * ({at}) + {2 * k + 1}, 2)' for k in reversed(range(width)))} AS UBIGINT)"

    starts = (seed + _PRIMES[0] + _PRIMES[1], seed + _PRIMES[1], seed, seed - _PRIMES[0])
    lanes = [
        f"list_reduce(list_transform(range({j}, 4 * (n // 32), 4), lambda i: {low(f'e[i + 1]::UHUGEINT * {p2}')}), "
        f"lambda a, k: {low(rotated(low(f'a::UHUGEINT + k::UHUGEINT'), 31) + f' * {p1}')}, {start % (1 << 64)}::UBIGINT) AS v{j}"
        for j, start in enumerate(starts)
    ]
    joined = low(" + ".join(rotated(f"v{j}", by) for j, by in enumerate((1, 7, 12, 18))))
    merged = "joined"
    for j in range(4):
        merged = low(f"xor({merged}, {low(rotated(low(f'v{j}::UHUGEINT * {p2}'), 31) + f' * {p1}')})::UHUGEINT * {p1} + {p4}")
    rest = f"list_transform(e[4 * (n // 32) + 1:], lambda k: {low(rotated(low(f'k::UHUGEINT * {p2}'), 31) + f' * {p1}')})"
    by_eight = f"list_reduce({rest}, lambda a, k: {low(rotated('xor(a, k)', 27) + f' * {p1} + {p4}')}, {low('h::UHUGEINT + n::UHUGEINT')})"
    four = f"xor(h, {low(f'{number(chr(110) + ' // 8 * 8', 4)}::UHUGEINT * {p1}')})"
    by_one = f"list_reduce(list_transform(range(n // 4 * 4, n), lambda i: {number('i', 1)}), lambda a, k: {low(rotated(f'xor(a, {low(f"k::UHUGEINT * {p5}")})', 11) + f' * {p1}')}, h)"
    steps = (
        f"SELECT s, x, len(x) // 2 AS n, list_transform(range(0, len(x) // 16), lambda i: {number('8 * i', 8)}) AS e FROM (SELECT s, hex(encode(s)) AS x FROM {words})",
        f"SELECT *, {', '.join(lanes)} FROM x0",
        f"SELECT s, x, n, e, v0, v1, v2, v3, {joined} AS joined FROM x1",
        f"SELECT s, x, n, e, CASE WHEN n >= 32 THEN {merged} ELSE {seed + _PRIMES[4]}::UBIGINT END AS h FROM x2",
        f"SELECT s, x, n, {by_eight} AS h FROM x3",
        f"SELECT s, x, n, CASE WHEN n % 8 >= 4 THEN {low(rotated(four, 23) + f' * {p2} + {p3}')} ELSE h END AS h FROM x4",
        f"SELECT s, {by_one} AS h FROM x5",
        f"SELECT s, {low(f'xor(h, h >> 33)::UHUGEINT * {p2}')} AS h FROM x6",
        f"SELECT s, {low(f'xor(h, h >> 29)::UHUGEINT * {p3}')} AS h FROM x7",
    )
    return ", ".join(f"x{k} AS MATERIALIZED ({step})" for k, step in enumerate(steps)) + ", hashed AS (SELECT s, xor(h, h >> 32) AS h FROM x8)"


def _simhash_sql() -> str:
    """Fingerprints by words counted per bit; components as what a recursion reaches over links of all pairs of fingerprints."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}+'), lambda x: x <> '') AS ws FROM documents
), shingles AS MATERIALIZED (
  SELECT r, array_to_string(ws[i:i + 2], ' ') AS s FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM d WHERE len(ws) > 0)
), words AS MATERIALIZED (SELECT DISTINCT s FROM shingles), {_xxh64_sql("words")}, bits AS (
  SELECT r, b, sum(CASE WHEN (h >> b) % 2 = 1 THEN n ELSE 0 END) * 2 > sum(n) AS one
  FROM (SELECT r, s, count(*) AS n FROM shingles GROUP BY r, s) JOIN hashed USING (s), range(0, 64) AS t(b) GROUP BY r, b
), prints AS MATERIALIZED (
  SELECT r, doc_id, CAST(coalesce(f, 0) AS UBIGINT) AS f FROM d LEFT JOIN (SELECT r, bit_or(1::UBIGINT << b::UBIGINT) AS f FROM bits WHERE one GROUP BY r) USING (r)
), nodes AS MATERIALIZED (SELECT f, min(doc_id) AS first FROM prints GROUP BY f
), links AS MATERIALIZED (SELECT a.f, b.f AS g FROM nodes a JOIN nodes b ON bit_count(xor(a.f, b.f)) <= 3
), reached AS (SELECT f, f AS g FROM nodes UNION SELECT reached.f, links.g FROM reached JOIN links ON reached.g = links.f)
SELECT doc_id, printf('%016x', f) AS fingerprint, component_id
FROM prints JOIN (SELECT reached.f, min(first) AS component_id FROM reached JOIN nodes ON reached.g = nodes.f GROUP BY reached.f) USING (f)"""


ORACLES: dict[str, str] = {
    "quality_rule_ablations": _LEDGER
    + """, policies(policy, version, mask) AS (VALUES ('base', 1, 3), ('web', 1, 31), ('web', 2, 127)),
rules(rule, bit) AS (VALUES ('few_words', 1), ('repeated_windows', 2), ('many_symbols', 4), ('shouting', 8), ('repeated_lines', 16),
                            ('short_words', 32), ('long_words', 64))
SELECT policy, CAST(version AS INT) AS version, rule, COUNT(*) FILTER (WHERE failed_bits & mask & bit <> 0) AS n_failed,
       COUNT(*) FILTER (WHERE failed_bits & mask = bit) AS n_failed_alone, COUNT(*) FILTER (WHERE failed_bits & mask = 0) AS n_kept
FROM policies JOIN rules ON mask & bit <> 0 CROSS JOIN bits GROUP BY ALL""",
    "op2_line_dedup": rf"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^{_SPACE}+', ''), '{_SPACE}+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), owner AS (
  SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT keyed.*, owner IS NOT NULL AND owner <> doc_id AS gone FROM keyed LEFT JOIN owner USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op3_suffix_dedup": """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), starts AS (
  SELECT r, i, md5_number(substr(x, 2 * i + 1, 400)) AS k FROM (SELECT r, x, unnest(range(0, len(x) // 2 - 199)) AS i FROM d)
), twice AS (
  SELECT r, i FROM starts QUALIFY count(*) OVER (PARTITION BY k) > 1
), runs AS (
  SELECT r, min(i) AS a, max(i) + 200 AS b FROM (
    SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS g FROM (
      SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS opens FROM twice)) GROUP BY r, g
), cut AS (
  SELECT r, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, max(b) AS after,
         string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
  FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM runs) JOIN d USING (r) GROUP BY r
)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(from_hex(coalesce(kept, '') || substr(x, 2 * coalesce(after, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)""",
    "op4_quality_rules": _LEDGER + """SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, CAST(failed_bits AS BIGINT) AS failed_bits FROM bits""",
    "op5_exact_dedup": rf"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g')) AS text_sha256
  FROM documents
), w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w""",
    "op9_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '')) AS size,
         md5(CAST(doc_id AS VARCHAR)) AS rank_key FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source
), weighed AS (
  SELECT *, [3, 1, 2][CAST(r % 3 + 1 AS INT)] AS weight FROM per
), filled AS (
  SELECT *, row_number() OVER o AS k,
         3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spare,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM weighed WINDOW o AS (ORDER BY source_size / weight, r)
), level AS (
  SELECT min_by(spare, k) AS spare, min_by(rest, k) AS rest, min(k) AS first FROM filled WHERE spare * weight <= 4 * source_size * rest
), target AS (
  SELECT source, source_size, r % 3 AS schedule,
         CASE WHEN k < first THEN CAST(2 * source_size AS DOUBLE)
              ELSE CAST(level.spare * weight AS DOUBLE) / CAST(2 * level.rest AS DOUBLE) END AS target
  FROM filled, level
), placed AS (
  SELECT d.*, source_size, target, schedule, CAST(round(target) AS BIGINT) AS asked,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY rank_key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN target ON d.source IS NOT DISTINCT FROM target.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(greatest(0, least(size, asked - before)) + greatest(0, least(size, asked - before - source_size)) AS BIGINT) AS taken,
       CASE WHEN least(size, asked - before) <= 0 THEN NULL
            WHEN schedule = 0 THEN share
            WHEN schedule = 1 THEN (sqrt(2.25 + 2 * -1.0 * share) - 1.5) / -1.0
            ELSE (sqrt(0.25 + 2 * 1.0 * share) - 0.5) / 1.0 END AS position
FROM (SELECT *, least(1.0, (before + least(size, asked - before) / 2) / asked) AS share FROM placed)""",
    "op10_simhash": _simhash_sql(),
    "op11_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws, row_number() OVER () AS r FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)
), places AS (
  SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(ws) >= n)
), hits AS (
  SELECT r, i, n, item_id FROM places JOIN windows USING (n, win)
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n_hit FROM hits, range(0, 10) AS t(k) WHERE k < n GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10""",
    "op13_vector_codes": _codes_sql(),
}
