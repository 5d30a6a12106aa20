"""A training corpus in five stages: quality, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's ``docs``.  All but the last return the columns of ``documents``.

A filter judges each row by its own text: rows without an id, and different texts under one id, are
rows of their own.  Line dedup orders rows by id, then by a hash of the text, null ids first.  Of
rows that repeat one id and text near-dedup keeps one.  ``run`` deletes what a stage wrote on the way
once the stage's own table is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, copies, decontam, lines, quality
from siltstone.llm.common import delete, materialize, read, scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier accepts."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated runs of lines from the texts; all documents stay."""
    out = lines.dedup_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in docs.columns else out


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the smallest id
    stays."""
    return copies.near_dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the benchmark contaminates."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode the texts."""
    return bpe.round_trip(docs, bpe.default_vocab()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            own = made.pop()  # the stage's table is the last that was written
        if last:
            delete(spark, last)
        last = own
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier and BPE are beyond SQL; tests/llm/test_pipeline.py compares run() with
#: brute-force versions of its filters on a small fixture.
ORACLE_SQL = None
