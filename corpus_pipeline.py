"""The corpus pipeline: quality rules, near-duplicates, decontamination, PII, subword ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; stages between
are written as Parquet to the shared folder and read again.

Defined cases, for every stage: extra columns are kept whatever their names, but the last stage's
``ids``, ``decoded_chars`` and ``decoded_sha256`` replace columns of these names; an empty table gives an
empty result; texts of any length are taken whole; nulls in other columns than text and doc_id mean nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuegrain.llm import common, decontaminate, pii, quality, simhash, subwords


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and blank texts go; repeated rows stay or go together."""
    return quality.keep(docs, common.table(spark, sf_dir, "labels"))


def one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group, one row of it; null ids come last, ties go by text and then by place."""
    return simhash.first_of_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated. Null texts are clean; repeated rows stay or go together; null items mean nothing."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def masked_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; ``n_chars`` follows the text. Null texts stay null; repeated rows are masked alike."""
    done = pii.redact(docs)
    return done.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else done


def subword_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their subword ids, and the length and digest of the text decoded from them; all null for a null text."""
    return subwords.encode(docs, check=True)


STAGES = [
    ("quality rules", keep_quality),
    ("near-duplicates", one_of_group),
    ("decontamination", without_benchmark),
    ("pii", masked_pii),
    ("subword ids", subword_ids),
]

#: The forest, the field and the ball links have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.stage(docs, f"pipeline{i}")
    return docs
