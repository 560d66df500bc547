"""The corpus pipeline: quality rules, exact dedup, SimHash near-dedup, secret redaction, best-fit packing.

Every stage takes any further columns, whatever their names, and all but the last return them; an empty table gives no
rows. Each works on the table that its predecessor left, and ties are decided by columns, not by the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradewright.llm.common import new_path
from gradewright.llm.exact_dedup import drop_exact
from gradewright.llm.packing import pack_documents
from gradewright.llm.quality import keep_good
from gradewright.llm.secrets import redact
from gradewright.llm.simhash import drop_near


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null, empty and short texts among them. Repeated rows are judged alike."""
    return keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty) the document with the largest doc_id stays, a null one last; of repeated rows one."""
    return drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document with the least doc_id stays, a null one last; null and empty texts are one component."""
    return drop_near(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays, repeated rows too. Null texts stay null; n_chars follows the text."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences; null and empty texts are one end mark. Only doc_id is kept of a document."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("secrets", secrets), ("packing", packing)]

#: XXH64 and the tokenizer are beyond SQL: tests/llm/test_pipeline.py holds run() against a plain re-implementation of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
