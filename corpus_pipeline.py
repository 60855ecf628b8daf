"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, BPE tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the
shared folder and reread as the next stage's docs. All but the last return documents' columns. Stages
that exchange nothing write as few files as their input fills.

Edge cases, in every stage. Null texts are texts without words, lines or tokens: quality scores them,
line dedup and decontamination leave them null, they are no near-duplicates of others, and they have
no tokens. Null ids stay. Repeated rows pass quality and line dedup, and near-dedup keeps one. Very
long texts are whole. Empty tables give empty results. Columns beyond doc_id, text, source and n_chars
are carried along, whatever their names; n_chars is renewed where there is one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm import _shared as sh
from meridia.llm import bpe, decontamination, line_dedup, minhash_dedup, quality


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return sh.few_files(quality.accepted(docs, sh.documents(spark, sf_dir, "labels")), docs)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site lines; those left without any line go, n_chars is renewed."""
    del spark, sf_dir
    out = line_dedup.line_dedup(docs)
    n_lines, n_removed = line_dedup.counts_of(docs)
    emptied = (F.col(n_removed) > 0) & (F.col(n_removed) == F.col(n_lines))
    return renewed(out.where(~emptied).drop(n_lines, n_removed))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    del spark, sf_dir
    return minhash_dedup.deduplicate(docs)


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly passages go, n_chars is renewed."""
    return sh.few_files(renewed(decontamination.clean(docs, sh.documents(spark, sf_dir, "benchmark"))), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids and digests of ids and decoded text."""
    del sf_dir
    sh.small_batches(spark)
    out = bpe.encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    out = sh.few_files(out, docs)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def renewed(docs: DataFrame) -> DataFrame:
    """docs with n_chars as its text has it."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("quality", keep_quality),
    ("line dedup", cut_lines),
    ("near-dedup", keep_one_of_each),
    ("decontamination", cut_benchmarks),
    ("bpe", tokenize),
]

#: The classifier and the near-duplicate classes aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = sh.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = sh.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
