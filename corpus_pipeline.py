"""The corpus pipeline: documents → good, distinct, uncontaminated, redacted documents → token digests.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the
columns of ``documents`` (the last one returns its own). ``run`` writes each stage's rows as
Parquet under the shared folder and reads them back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.llm import decontaminate, pii, quality, simhash, subwords
from cairnspark.llm.queries import QUALITY_LEAST, piece_model, table
from cairnspark.llm.text import part_of
from cairnspark.sources.tables import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3."""
    labels = table(spark, sf_dir, "labels").where(part_of("doc_id", 5) != 0)
    model = quality.fit(docs, labels)
    return quality.score(docs, model, to="__score").where(f"__score >= {QUALITY_LEAST}").select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    return simhash.keep_one(docs).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; personal data in the text gives way to its kind in brackets, ``n_chars`` follows."""
    found = pii.find(docs, pii.fit(docs), to="__pii")
    clean = found.withColumns({"text": F.col("__pii.text"), "n_chars": F.length("__pii.text").cast("long")})
    return clean.select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    return subwords.token_digests(docs, piece_model(), to="__tokens").select("doc_id", "__tokens.*")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_redaction", pii_redaction),
    ("sentencepiece", sentencepiece),
]

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: a row for each document that stays."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
