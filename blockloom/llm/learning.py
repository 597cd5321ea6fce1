"""A bounded sample of labelled texts, for classifiers that are trained on the driver, and filters by what they say."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import held_out, tidy


def label_of(labels: DataFrame, column: str, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of the labelled rows outside the held-out fifth. Null ids and labels are left out; where a document is
    labelled twice, the larger label counts."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(column).isNotNull() & ~held_out(id_col))
    return known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(column).cast("double")).alias("label"))


def sample_ids(labels: DataFrame, column: str, rows: int, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of at most ``rows`` rows of label_of, those with the smallest hashes."""
    known = label_of(labels, column, id_col)
    return known.orderBy(F.xxhash64("id"), "id").limit(rows)


def sample_texts(docs: DataFrame, labels: DataFrame, column: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, text) of the sample. Its size has a bound, so it is broadcast. Of rows that repeat an id the text with
    the smallest hash counts, so that the same tables give the same model."""
    ids = sample_ids(labels, column, rows, id_col)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))
    return texts.join(F.broadcast(ids), "id").groupBy("id", "label").agg(one.alias("one")).select("id", "label", "one.text")


def keep_rows(docs: DataFrame, model, scores: Callable, kept: Callable[[np.ndarray], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is one to keep: each is decided where it lies, without a shuffle.

    A null text is scored as an empty one. Rows that repeat are decided alike; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            texts = [t or b"" for t in b.column(text_col).cast(pa.binary()).to_pylist()]
            yield b.filter(pa.array(kept(scores(shared.value, texts)), pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
