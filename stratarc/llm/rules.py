"""Quality rules as a bitmask ledger, in DataFrame operations only.

Every rule is evaluated once: the ledger holds the measurements and one bit for each rule that the text fails.
Policies are versioned sets of rules (masks); applying one, or taking a rule out of it, reads the ledger's bits and
never the texts again.

Defined cases: a null text has no words; empty and blank texts fail ``few_words``; repeated rows and ties get a row
each; an empty table gives an empty ledger; other columns are kept, except ones named like the added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratarc.llm.common import SPACE

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Rules in bit order; each is a condition over the measurements.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 30 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 25 * n_words",
    "stutter": "100 * n_stutter > 30 * n_words",
}
#: The rules each version of the policy enforces.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols"),
    "v2": tuple(RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter")


def mask(policy: str) -> int:
    return sum(1 << i for i, rule in enumerate(RULES) if rule in POLICIES[policy])


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measurements (all long)."""
    names = {m.lower() for m in MEASURES}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = docs.select(
        "*",
        F.array_remove(F.split(body, "[ \\t\\n\\x0B\\f\\r]+"), "").alias("__words"),
        F.filter(F.split(body, "\\n"), lambda x: F.translate(x, SPACE, "") != "").alias("__lines"),
    )
    windows = words.select(
        "*",
        F.when(F.size("__words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("__words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__words", i, WINDOW))))
        .otherwise(F.array().cast("array<bigint>"))
        .alias("__windows"),
    )
    # only texts with an equal pair of windows go through the sort
    twice = F.size("__windows") > F.size(F.array_distinct("__windows"))
    sorted_ = windows.select("*", F.when(twice, F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("__sorted"))
    # a window repeats if the one before or after it in hash order is equal
    hits = sorted_.select(
        "*",
        F.when(
            F.col("__sorted").isNotNull(),
            F.array_sort(
                F.transform(
                    F.filter(
                        F.arrays_zip(
                            F.col("__sorted").alias("x"),
                            F.concat(F.array(F.lit(None).cast("bigint")), F.slice(F.col("__sorted.h"), F.lit(1), F.size("__sorted") - 1)).alias("b"),
                            F.concat(F.slice(F.col("__sorted.h"), F.lit(2), F.size("__sorted") - 1), F.array(F.lit(None).cast("bigint"))).alias("a"),
                        ),
                        lambda z: F.coalesce(z.x.h == z.b, F.lit(False)) | F.coalesce(z.x.h == z.a, F.lit(False)),
                    ),
                    lambda z: z.x.i,
                )
            ),
        )
        .otherwise(F.array().cast("array<int>"))
        .alias("__at"),
    )
    repeat = F.aggregate(
        F.zip_with("__at", F.slice("__at", F.lit(2), F.greatest(F.size("__at") - 1, F.lit(0))), lambda i, j: F.coalesce(F.least(F.lit(WINDOW), j - i), F.lit(WINDOW))),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    n = F.size("__words")
    stutter = F.size(F.filter(F.zip_with("__words", F.slice("__words", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: a == b), lambda same: F.coalesce(same, F.lit(False))))
    return hits.select(
        *kept,
        n.cast("long").alias("n_words"),
        F.length(F.translate(body, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        stutter.cast("long").alias("n_stutter"),
    )


def rule_ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The measurements and ``fail_bits``: bit i is set if the i-th of RULES fails."""
    bits = F.lit(0).cast("long")
    for i, condition in enumerate(RULES.values()):
        bits = bits + F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return measured(docs.drop("fail_bits"), text).withColumn("fail_bits", bits)


def apply_policy(ledger: DataFrame, policy: str, verdict: str = "kept") -> DataFrame:
    return ledger.withColumn(verdict, F.col("fail_bits").bitwiseAND(mask(policy)) == 0)


def ablations(ledger: DataFrame) -> DataFrame:
    """Per policy and rule: rows that fail it, rows that fail nothing else there (won back without it), rows kept by all.

    Distinct bit patterns are counted first (at most 2^rules rows), so that the ledger is read once for all of them.
    """
    patterns = ledger.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rules = [(p, r, mask(p), 1 << list(RULES).index(r)) for p in POLICIES for r in POLICIES[p]]
    cases = F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).alias("mask"), F.lit(b).alias("bit")) for p, r, m, b in rules)))
    failed = F.col("fail_bits").bitwiseAND(F.col("c.mask"))
    return (
        patterns.select("fail_bits", "n", cases.alias("c"))
        .groupBy(F.col("c.policy").alias("policy"), F.col("c.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("c.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(failed == F.col("c.bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(failed == 0, F.col("n")).otherwise(0)).alias("n_kept"),
        )
    )
