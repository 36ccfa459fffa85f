"""The corpus pipeline: documents through quality rules, line dedup, near-dedup, source mixing and byte-level BPE.

Each stage reads what its predecessor kept, written as Parquet in the shared folder, and returns the
columns of documents; the last returns token ids. Texts may be null or empty in any stage: the quality
rules reject them. Very long texts are taken whole in each stage. Repeated rows are one group of copies, of which
near-dedup keeps the row of smallest id, or all rows of that id; ties in the mix go by id, size and text. Further
columns, whatever their names, pass through all stages but the last. An empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import bpe, line_dedup, mixing, near_dups, quality
from larkspur.storage import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rejected documents and the failing lines of kept ones."""
    return quality.clean_documents(docs)


def line_dedup_by_site(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops each source's boilerplate lines, a document's source standing for its host."""
    return line_dedup.clean_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return near_dups.deduplicate(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each served copy, in mixing order; the copies that the budget cuts are shortened."""
    return mixing.mixed_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and exact: token ids of each copy, decoded again to check them."""
    return bpe.encoded(docs, public_tokenizers.path(bpe.VOCABULARY))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_by_site),
    ("near-dedup", near_dedup),
    ("source mixing", source_mixing),
    ("byte-level BPE", byte_bpe),
]

#: Near-duplicate links and byte-pair merges have no SQL form: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
