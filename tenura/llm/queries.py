"""The ``opN_`` queries: thin calls of the operators on the driver's tables."""

from __future__ import annotations

from tenura.llm import (conversations, decontaminate, divergence, langid, linededup, minhash, mixing, quality, rules,
                        simhash, substring, suffix, urlcascade)
from tenura.llm.frames import read_table
from tenura.llm.oracles import ORACLES  # noqa: F401


def op1_decontamination(spark, sf_dir):
    return decontaminate.contamination_report(read_table(spark, sf_dir, "documents"),
                                              read_table(spark, sf_dir, "benchmark"))


def op2_quality_classifier(spark, sf_dir):
    return quality.quality_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_line_dedup(spark, sf_dir):
    return linededup.line_report(read_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark, sf_dir):
    return suffix.suffix_report(read_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    return rules.quality_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_mixing(spark, sf_dir):
    return mixing.mix_report(read_table(spark, sf_dir, "documents"))


def op7_minhash(spark, sf_dir):
    return minhash.near_duplicate_report(read_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark, sf_dir):
    return substring.substring_report(read_table(spark, sf_dir, "documents"))


def op9_language_id(spark, sf_dir):
    return langid.language_report(read_table(spark, sf_dir, "documents"))


def op10_url_filter(spark, sf_dir):
    return urlcascade.url_report(spark, read_table(spark, sf_dir, "pages"))


def op11_source_divergence(spark, sf_dir):
    return divergence.divergence(read_table(spark, sf_dir, "documents"))


def op12_simhash(spark, sf_dir):
    return simhash.simhash_report(read_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark, sf_dir):
    return conversations.repair_report(read_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_quality_classifier, op3_line_dedup, op4_suffix_dedup, op5_quality_rules, op6_mixing,
    op7_minhash, op8_substring_dedup, op9_language_id, op10_url_filter,
    op11_source_divergence, op12_simhash, op13_conversation_repair)}
