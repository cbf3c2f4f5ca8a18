"""Registered queries of the training-data operators, over whole tables with production parameters.

Each keeps one row for each row of its table, repeated ones too, and none for an empty table; texts are read whole,
and columns beside those that the operator names aren't read. The operators' modules say the rest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from valuegrain.llm import decontaminate, jaccard, language, pii, prefix_trie, quality, resample, scoring, simhash, subwords, suffixes, units, url_filter
from valuegrain.llm.common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages`` by the rules, else by the model; null urls and those without ``://`` have empty parts."""
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.fit(url_filter.labelled_urls(spark)))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of repeated lines of ``RUN_WORDS`` words or more; null texts stay null."""
    return units.judge(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document; null and blank texts fail the base rule."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of benchmark windows in every document; null texts and items have none."""
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subword ids of every document and whether they decode to its text; null ids for null texts."""
    return subwords.judge(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; ``und`` for null texts and those without a letter."""
    return language.judge(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document; null texts have none."""
    return pii.judge(table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and lattice score of every document; null is the empty text."""
    return scoring.judge(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeated strings cover; null is the empty text."""
    return suffixes.judge(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null and blank texts share fingerprint zero."""
    return simhash.judge(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations; a row for each node, none without conversations."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document against the benchmark's texts; null texts weigh 0 and are not drawn."""
    return resample.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document; null and blank texts have no shingles and are linked with nothing."""
    return jaccard.judge(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filter, op2_line_dedup, op3_quality_rules, op4_sentencepiece, op5_decontaminate, op6_language_id, op7_pii, op8_lm_score, op9_suffix_dedup, op10_simhash, op11_prefix_trie, op12_resample, op13_jaccard_join)}

#: Only where SQL can express the whole result.
ORACLES: dict[str, str] = {"op2_line_dedup": units.ORACLE, "op5_decontaminate": decontaminate.ORACLE, "op11_prefix_trie": prefix_trie.ORACLE, "op12_resample": resample.ORACLE}
