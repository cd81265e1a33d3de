"""The registered queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .common import read_table
from .decontaminate import find_leaks
from .divergence import source_divergence
from .line_dedup import dedup_lines
from .lm_scoring import score_lm
from .mixing import mix_sources
from .quality_classifier import score_quality
from .rule_ledger import ablations, ledger, quality_rules
from .secrets import scan_secrets
from .simhash import simhash_components
from .span_graph import dedup_spans
from .suffix_dedup import suffix_dedup
from .vector_codes import vector_codes
from .warc import salvage_trial, warc_round_trip


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("rest.doc_id").alias("doc_id"), "n_lines", "n_removed_lines", "n_removed_chunks", "kept_sha256")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(read_table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_lm(read_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"))


def op9_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(read_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures"
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(read_table(spark, sf_dir, "embeddings"))


def op13_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the repository's top, part of this subpackage

    return corpus_pipeline.run(spark, sf_dir)


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base findings of op1."""
    return op1_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact columns of op7; the base score in thousandths."""
    out = op7_lm_scoring(spark, sf_dir)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round(F.col("base_score") * 1000).cast("long").alias("base_milli"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of op8."""
    return op8_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target")


def warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reader of op5 recovers from an archive of all pages with damage at fixed ids."""
    return salvage_trial(read_table(spark, sf_dir, "pages"))


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rule of the policy of op9, the texts that fail it and those that only it rejects."""
    return ablations(ledger(read_table(spark, sf_dir, "documents")), "v2").select("rule", "n_failed", "n_only_this")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secrets,
        op2_decontaminate,
        op3_line_dedup,
        op4_suffix_dedup,
        op5_warc,
        op6_simhash,
        op7_lm_scoring,
        op8_mixing,
        op9_rule_ledger,
        op10_quality_classifier,
        op11_source_divergence,
        op12_vector_codes,
        op13_span_dedup,
        pipeline,
        secret_base,
        lm_base,
        mix_targets,
        warc_salvage,
        rule_ablations,
    )
}
#: Training, alignment, hashing by XXH64 and seeded draws have no SQL; tests/llm holds those queries against brute force.
ORACLES: dict[str, str] = {
    "op4_suffix_dedup": oracles.SUFFIX,
    "op5_warc": oracles.WARC,
    "op9_rule_ledger": oracles.LEDGER,
    "op11_source_divergence": oracles.DIVERGENCE,
    "op12_vector_codes": oracles.VECTOR_CODES,
    "op13_span_dedup": oracles.SPANS,
    "secret_base": oracles.SECRET_BASE,
    "lm_base": oracles.LM_BASE,
    "mix_targets": oracles.MIX_TARGETS,
    "warc_salvage": oracles.SALVAGE,
    "rule_ablations": oracles.ABLATIONS,
}
