"""Quality rules as a bitmask ledger.

Each rule is evaluated once per text. The ledger keeps the measurements and one integer whose
bit i is set if rule i fails. A policy is a named set of rules, so that a verdict, the verdict
of another version and the effect of leaving a rule out are bitwise operations on the ledger;
no text is read again.

Null or empty text: no words, so all counts are 0 and the rule ``few_words`` fails. Repeated
rows and rows with a null id each get their own verdict. An empty table gives an empty result.
Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows
from .measures import COUNTS_DDL, count_batch


def rules() -> dict[str, Column]:
    """Name to "this text fails", in bit order. New rules go to the end."""
    c = F.col
    letters = c("n_upper") + c("n_lower")
    return {
        "few_words": c("n_words") < 50,
        "repeated_words": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbols": 100 * c("n_symbols") > 30 * c("n_words"),
        "shouting": (letters > 0) & (100 * c("n_upper") > 60 * letters),
        "word_length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 25 * c("n_words")),
        "repeated_lines": (c("n_lines") > 3) & (100 * c("n_dup_lines") > 50 * c("n_lines")),
        "same_next_word": 100 * c("n_same_next") > 25 * c("n_words"),
        "few_distinct_words": (c("n_words") >= 50) & (100 * c("n_distinct_words") < 5 * c("n_words")),
    }


#: Versions are never changed once used; a new policy gets a new version.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "shouting", "word_length"),
    "v2": ("few_words", "repeated_words", "symbols", "shouting", "word_length", "repeated_lines", "same_next_word"),
}


def policy_mask(version: str) -> int:
    bit = {name: 1 << i for i, name in enumerate(rules())}
    return sum(bit[name] for name in POLICIES[version])


def ledger(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, the measurements and ``failures`` (long)."""
    counted = map_rows(docs.select("doc_id", "text"), count_batch, ["doc_id"], COUNTS_DDL)
    failures = F.lit(0).cast("long")
    for i, failed in enumerate(rules().values()):
        failures = failures.bitwiseOR(F.when(failed, F.lit(1 << i)).otherwise(0).cast("long"))
    return counted.withColumn("failures", failures)


def apply_policy(entries: DataFrame, version: str, name: str = "kept") -> DataFrame:
    return entries.withColumn(name, F.col("failures").bitwiseAND(F.lit(policy_mask(version))) == 0)


def ablations(entries: DataFrame, version: str) -> DataFrame:
    """For each rule of the policy: texts that fail it, and texts that only it rejects.

    Masks are counted first (at most 2 ** rules rows), and the rules are then read off the masks.
    """
    mask = policy_mask(version)
    order = list(rules())
    bits = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(1 << order.index(n)).cast("long").alias("bit")) for n in POLICIES[version]))
    masks = entries.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("m")).agg(F.count("*").alias("n"))
    hit = F.col("m").bitwiseAND(F.col("r.bit")) != 0
    return (
        masks.withColumn("r", F.explode(bits))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("m") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_only_this"),
            F.expr("bit_or(CASE WHEN (m & r.bit) <> 0 THEN m ELSE 0L END)").alias("fails_with"),
        )
    )


def quality_rules(docs: DataFrame, version: str = "v2") -> DataFrame:
    """The ledger with ``base_failed`` and the verdict ``kept`` of a policy version."""
    entries = apply_policy(ledger(docs), version)
    base = F.col("failures").bitwiseAND(F.lit(policy_mask("base"))) != 0
    return entries.withColumn("base_failed", base).withColumn("kept", ~base & F.col("kept"))
