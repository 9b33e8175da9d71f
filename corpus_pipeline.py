"""A training corpus from raw documents, in five stages. Part of the subpackage polisgrid.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from polisgrid.llm import bpe, decontaminate, minhash, quality, secrets
from polisgrid.llm.queries import pattern, vocabulary
from polisgrid.llm.shared import Table, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps. Each row is judged by itself: null and empty texts as texts of no word, repeated
    rows each, a null doc_id like any other; a table without labels of both kinds, or without rows, stays as it is."""
    return quality.good(docs, read(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id. Documents go by doc_id, so rows that
    repeat a kept doc_id stay; null and empty texts and rows without doc_id are like no other and stay."""
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. Each row is judged by its own text; null and empty texts hold none."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind in square brackets; a null text stays null."""
    return secrets.redact(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, hashes of ids and of the decoded text, ids (little-endian, 32 bits each). Null and
    empty texts have no token."""
    return bpe.bpe(docs, vocabulary("byte_bpe_50k.tiktoken"), pattern(), with_ids=True, keep=("lang", "source"))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("byte-level BPE", tokens_stage),
]

#: SQL can express neither the classifier nor the tokens; tests/llm/test_pipeline.py compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again. The table before the
    last stage stays there, as the result is read from it."""
    docs = read(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            table = Table(docs, f"stage{k}")
            if before is not None:
                before.drop()
            docs, before = table.df, table
    return docs
