"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and hands a DataFrame on, written as Parquet and read again.

The classifiers decide each row by its text, so rows that repeat a doc_id are decided apart. Each stage lowers the rows
that the session's tasks hold at once; as its frame may run after it returns, that stays so until run() has ended.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import lines, minhash, packing, quality, toxicity
from blockloom.llm._common import cut, put_back, shared_path, small_batches, table, tokenizer_path


def _stage(f):
    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(spark, docs, sf_dir)

    return run_stage


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that op1's classifier, learned from ``documents`` and ``labels``, predicts 1 for, with their columns as they
    are. Null texts are scored as empty ones, rows that repeat are decided alike, an empty table stays empty."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


@_stage
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that op3's classifier predicts 0 for; otherwise as quality_stage."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


@_stage
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, later copies of repeated line runs deleted from their texts and ``n_chars``, where there is one, counted
    anew. Null texts stay null, texts that lose every line become empty, rows that repeat id and text are one document."""
    out = lines.line_dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@_stage
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that near_dedup keeps, as they are: each row is dropped or kept by its own number, so rows that repeat an
    id, or have none, are decided apart. Texts without words all stay; an empty table stays empty."""
    number = "__row"
    while number.lower() in map(str.lower, docs.columns):
        number += "_"
    numbered = cut(docs.withColumn(number, F.monotonically_increasing_id()))
    gone = minhash.near_dedup(numbered, words=5, percent=80, row_col=number).filter("NOT stays").select(F.col("row").alias(number))
    return numbered.join(gone, number, "left_anti").drop(number)


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences, as best_fit_packing returns them."""
    return packing.best_fit_packing(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can express neither the classifiers nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    before = small_batches(spark)
    try:
        for i, (_, stage) in enumerate(STAGES):
            path = shared_path(spark, f"pipeline-{i}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        put_back(spark, before)
    return docs
