"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per
rule; a policy is a named, versioned mask over those bits. Applying another policy, or asking what
each rule costs, reads the ledger and never the texts. A stored ledger is a versioned table: documents that change replace their rows.

Defined cases: a null or empty text has no words and zero measurements, so it fails `few_words`; a null
doc_id, repeated rows and extra columns of any name are carried through as they are (one ledger row per input row),
but for columns named like a measurement or `failed_bits`, which are replaced; an empty table gives an empty ledger; a very long
text is measured whole, in its row's task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.versioned import VersionedTable
from .common import text_of, without_space, word_array

#: Words in a window whose repetition counts.
WINDOW = 5

MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_upper",
    "n_lines",
    "n_dup_lines",
    "n_repeat_words",
)


@dataclass(frozen=True)
class Rule:
    """A bit of the ledger, set where `fails` (SQL over the measurements) holds."""

    bit: int
    name: str
    fails: str


#: A rule keeps its bit for ever; new rules take new bits.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "many_symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "shouting", "10 * n_upper > 3 * word_chars"),
    Rule(4, "repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule(5, "short_words", "word_chars < 2 * n_words"),
    Rule(6, "long_words", "word_chars > 12 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        bits = {r.name: r.bit for r in rules}
        return reduce(lambda m, name: m | 1 << bits[name], self.rules, 0)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
WEB = Policy("web", 1, ("few_words", "repeated_windows", "many_symbols", "shouting", "repeated_lines"))
STRICT = Policy("web", 2, tuple(r.name for r in RULES))
POLICIES = (BASE, WEB, STRICT)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with the measurements as columns.

    Windows are compared by a 64-bit hash inside one document. Only documents in which a window
    repeats sort their windows, so the costly part follows the repetition and not the input.
    """
    plain = [c for c in docs.columns if c != text and c not in MEASURES]
    body = text_of(docs, text)
    rest = F.struct(*[docs[c] for c in plain] or [F.lit(0)]).alias("_rest")  # no name in it meets one of ours
    n_windows = F.size("_w") - (WINDOW - 1)
    hashes = F.transform(
        F.sequence(F.lit(0), n_windows - 1),
        lambda i: F.xxhash64(*[F.get(F.col("_w"), i + k) for k in range(WINDOW)]),
    )
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    squeezed = without_space(body)
    found = docs.select(
        rest,
        word_array(body).alias("_w"),
        F.length(squeezed).cast("long").alias("word_chars"),
        (F.length(squeezed) - F.length(F.regexp_replace(squeezed, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length(squeezed) - F.length(F.regexp_replace(squeezed, r"[A-Z]+", ""))).cast("long").alias("n_upper"),
        lines.alias("_l"),
    )
    found = found.select(
        "_rest",
        "word_chars",
        "n_symbols",
        "n_upper",
        F.size("_w").cast("long").alias("n_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(n_windows > 0, hashes).alias("_h"),
    )
    found = found.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )

    def repeated(e: Column, k: Column) -> Column:
        before = F.get(F.col("_s"), k - 1)["h"]
        after = F.get(F.col("_s"), k + 1)["h"]
        return F.coalesce(before == e["h"], F.lit(False)) | F.coalesce(after == e["h"], F.lit(False))

    found = found.withColumn("_p", F.sort_array(F.transform(F.filter("_s", repeated), lambda e: e["i"])))
    gaps = F.transform(
        "_p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_p"), k + 1) - p, F.lit(WINDOW)))
    )
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)
    found = found.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    # A generator of one row: filters on the measurements stay above it. On projected columns the optimizer would
    # write the measurements' expressions into the filter, and into each other's loops, again and again.
    once = F.explode(F.array(F.struct(*MEASURES))).alias("_m")
    return found.select("_rest", once).select(*[F.col("_rest").getField(c).alias(c) for c in plain], *[F.col(f"_m.{m}").alias(m) for m in MEASURES])


def build_ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """One row per document: its columns without the text, the measurements, and `failed_bits`."""
    bits = reduce(
        lambda a, r: a.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long")),
        rules,
        F.lit(0).cast("long"),
    )
    return measure(docs.drop("failed_bits"), text).withColumn("failed_bits", bits)


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def apply_policy(ledger: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with `kept`, true where no rule of the policy failed."""
    return ledger.withColumn("kept", passes(policy, rules))


def select_passing(docs: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The documents that the policy keeps, with their own columns."""
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[text].alias("_body"))
    return build_ledger(whole, rules, "_body").where(passes(policy, rules)).select("_row.*")


def store_ledger(ledger: DataFrame, path: str, doc_id: str = "doc_id") -> VersionedTable:
    """Put the ledger's rows into the versioned table at path, in place of those of the same documents."""
    table = VersionedTable(ledger.sparkSession, path)
    table.replace_by_key(ledger, {"rules": [r.name for r in RULES]}, keys=(doc_id,))
    return table


def ablations(ledger: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per policy and rule of it: documents that fail the rule, that fail it alone (they would stay
    without it), and that the policy keeps. One count per distinct bitmask, then bitwise sums over
    at most 2^rules rows."""
    counts = ledger.groupBy("failed_bits").agg(F.count("*").alias("n"))
    spark = ledger.sparkSession
    rows = [(p.name, p.version, r.name, p.mask(rules), 1 << r.bit) for p in policies for r in rules if r.name in p.rules]
    table = spark.createDataFrame(rows, "policy string, version int, rule string, mask long, bit long")
    hit = F.col("failed_bits").bitwiseAND(F.col("mask"))
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return (
        F.broadcast(table)
        .join(counts, F.lit(True), "left")
        .groupBy("policy", "version", "rule")
        .agg(
            n(hit.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
            n(hit == F.col("bit")).alias("n_failed_alone"),
            n(hit == 0).alias("n_kept"),
        )
    )
