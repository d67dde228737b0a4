"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes what its predecessor kept, as a table; all but the last return
the columns of ``documents`` (and any others that it has). Null and empty texts
go with the first stage; repeated rows stay or go together up to the third,
which leaves one row per key of a group; rows with a null key are documents
like others and never stand for a group; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wiremill.llm import decontamination, language_id, line_templates, packing, simhash_dedup
from wiremill.session import written


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that the model is sure of go, those without a letter too (null and empty texts)."""
    return language_id.keep_identified(docs)


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; ``n_chars`` follows the text. Every document stays, if with an empty text."""
    out = line_templates.drop_template_lines(docs).drop("n_lines", "n_dropped")
    return out.selectExpr(*["cast(length(text) as bigint) as n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns])


def stage_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document (by key) of each group of near copies stays, of texts without words one; rows with a null key stay."""
    return simhash_dedup.drop_near_copies(docs)


def stage_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go; null and empty texts stay."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's length bucket, batch and place; a document without words is padded to one."""
    return packing.pack(docs)


STAGES = [
    ("language_id", stage_language),
    ("line_dedup", stage_lines),
    ("simhash_dedup", stage_near_copies),
    ("decontamination", stage_benchmark),
    ("packing", stage_packing),
]

#: The stages learn models and align texts, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
