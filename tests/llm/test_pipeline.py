"""Stages of the corpus pipeline on small tables."""

import os
import subprocess
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

pytest.importorskip("blockloom.llm")
import corpus_pipeline  # noqa: E402
from blockloom.llm import toxicity  # noqa: E402
from blockloom.llm._common import BATCHES, put_back  # noqa: E402

WORDS = [f"w{i}" for i in range(60)]
LONG, NEAR, OTHER = " ".join(WORDS), " ".join([*WORDS[:-1], "x"]), " ".join(f"o{i}" for i in range(60))
SCHEMA = "doc_id long, text string, source string, __row int"


def test_near_stage_decides_each_row(spark):
    rows = [(3, LONG), (5, OTHER), (5, OTHER), (5, NEAR), (None, LONG), (None, NEAR), (None, OTHER), (None, "solo text"), (None, "solo text"), (7, None), (7, None), (None, ""), (8, " \n")]
    docs = spark.createDataFrame([(i, t, f"s{k}", k) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)
    got = corpus_pipeline.near_stage(spark, docs, "")
    assert got.columns == docs.columns
    # One row of each group of near copies, and every text without words.
    want = Counter([(3, LONG), (5, OTHER), (None, "solo text"), (7, None), (7, None), (None, ""), (8, " \n")])
    kept = got.collect()
    assert Counter((r.doc_id, r.text) for r in kept) == want
    assert all(rows[r["__row"]] == (r.doc_id, r.text) and r.source == f"s{r['__row']}" for r in kept)
    assert corpus_pipeline.near_stage(spark, docs.limit(0), "").count() == 0


SMALL_HEAP = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.driver.memory", "512m").config("spark.ui.enabled", "false").getOrCreate()
import corpus_pipeline
docs = spark.read.parquet(sys.argv[1] + "/documents.parquet")
print("kept", corpus_pipeline.quality_stage(spark, docs, sys.argv[1]).count())
"""


def test_a_stage_needs_little_memory_for_long_texts(tmp_path):
    # Four tasks at once, each with a row group of 3,000 texts of 16 KB: 192 MB of text in a heap of 512 MB.
    os.mkdir(tmp_path / "documents.parquet")
    for k in range(4):
        texts = pa.table({"doc_id": range(3000 * k, 3000 * (k + 1)), "text": [f"{i} " + "some words of a line. " * 727 for i in range(3000)]})
        pq.write_table(texts, tmp_path / "documents.parquet" / f"{k}.parquet", use_dictionary=False, row_group_size=3000)
    pq.write_table(pa.table({"doc_id": range(40), "quality": [1] * 40, "toxic": [0] * 40}), tmp_path / "labels.parquet")
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    got = subprocess.run([sys.executable, "-c", SMALL_HEAP, str(tmp_path)], env=os.environ | {"PYTHONPATH": root}, cwd=tmp_path, capture_output=True, text=True)
    assert "kept 12000" in got.stdout, got.stderr[-2000:]


def test_run_gives_the_settings_back(spark, tmp_path, monkeypatch):
    def stage(spark, docs, sf_dir):
        assert all(int(spark.conf.get(k)) <= v for k, v in BATCHES.items())
        return docs

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("nothing", stage)])
    spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = {k: spark.conf.get(k, None) for k in BATCHES}
    first = next(iter(BATCHES))
    spark.conf.set(first, "100")  # lower already: left as it is
    try:
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == 2
        assert {k: spark.conf.get(k, None) for k in BATCHES} == before | {first: "100"}
    finally:
        put_back(spark, before)


def test_each_language_has_a_threshold_of_its_own(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    # With 300 rows to learn from, the sample's fifth has too few toxic rows of any language; the other labels calibrate.
    model = toxicity.train(docs, labels, rows=300)
    assert set(model.thresholds) == {-2, 0, 1, 2, 3}


def test_few_rows_move_a_threshold_less():
    def shift(n):
        margin, toxic = np.r_[np.full(n, 2.0), np.full(n, 4.0), np.full(1000, -4.0), np.full(1000, -2.0)], np.r_[np.zeros(n), np.ones(n), np.zeros(1000), np.ones(1000)].astype(int)
        t = toxicity.thresholds_of(np.r_[np.ones(2 * n), np.zeros(2000)].astype(int), margin, margin, toxic, 1 - toxic)
        return (t[1] - t[-2]) / (3 - t[-2])

    assert abs(shift(12) - 0.5) < 1e-9 and 0 < shift(1) < shift(12) < shift(100) < 1
    assert toxicity.thresholds_of(np.array([0, 0]), np.array([1.0, 2.0]), np.array([1.0, 2.0]), np.array([0, 0]), np.array([1, 1])) == {}
    # Counts of two languages in one bin are not parted.
    overlap = toxicity._threshold(np.array([0.0, 1.0, 1.1, 3.0]), np.array([0.5, 1.4, 1.3, 3.5]), np.array([0, 2, 0, 5]), np.array([9, 0, 1, 0]))
    assert overlap == 0.75
