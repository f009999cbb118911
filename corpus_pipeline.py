"""Training-text pipeline: quality rules, near duplicates, benchmark passages, personal data, token ids.

Each stage works on all that the stage before kept; its result is written as Parquet to the shared
checkpoint folder and read again as the next stage's documents, so a lost executor costs the
current stage only.  All stages but the last return the columns of the documents they get.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm import bpe, decontaminate, pii, quality, simhash
from sylvan.llm.common import read, written_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and every certified cutoff."""
    return quality.judged(docs, read(spark, sf_dir, "labels")).filter("q.kept").select("doc.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of linked fingerprints."""
    return simhash.without_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind; a column n_chars, if there, counts the new text."""
    # the helper columns sit beside a struct of the row, so no column of the documents can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text").alias("text"))
    found = pii.found(rows, pii.fitted(docs), mask=True)
    text = F.when(F.col("doc.text").isNotNull(), F.col("pii.masked"))
    new = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return found.select(*[new[c].alias(c) if c in new else F.col("doc").getField(c).alias(c) for c in docs.columns])


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token ids, and the digests that show the ids decode to the text."""
    rows = docs.select("doc_id", "lang", "source", "text")
    return bpe.digests(rows, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("doc_id", "lang", "source"), with_ids=True)


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", personal_data_stage),
    ("byte-level BPE encoding and decoding", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Linked groups, the span model and token ids are beyond SQL: tests hold every stage against brute force.
ORACLE_SQL = None
