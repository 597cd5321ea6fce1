"""Exact dedup: tree-merge of sorted digest runs.

Each input partition sorts the digests of its texts and folds equal neighbours into one record, its run. The
partitions then meet in binomial rounds: in round r the partitions whose numbers differ in bit r exchange runs, one
taking the digests with that bit 0 and the other those with bit 1, merge what they hold and fold again. After log2(P)
rounds each digest is in one partition. A group of copies of any size is one record a partition from the first run on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import checkpoint, power_of_two, shuffle_partitions, table

KEY = ["sha", "size", "check"]


def _fold(batches):
    """Fold equal neighbours of a sorted run; the first row of a key has the id that stays. Holds one batch at a time."""
    last = None  # the open record: one row, its count still growing
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if last is not None:
            rows = pa.concat_tables([last, rows])
        rows = rows.combine_chunks()
        n = rows.num_rows
        sha = np.frombuffer(b"".join(rows["sha"].to_pylist()), dtype=np.uint64).reshape(n, 4)
        same = (sha[1:] == sha[:-1]).all(axis=1)
        for c in KEY[1:]:
            v = rows[c].to_numpy()
            same &= v[1:] == v[:-1]
        starts = np.flatnonzero(np.r_[True, ~same])
        total = np.add.reduceat(rows["n"].to_numpy(), starts)
        out = rows.take(pa.array(starts))
        out = out.set_column(out.schema.get_field_index("n"), "n", pa.array(total, pa.int64()))
        last = out.slice(out.num_rows - 1)
        yield from out.slice(0, out.num_rows - 1).to_batches()
    if last is not None:
        yield from last.to_batches()


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", partitions: int | None = None
) -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a record is merged only when SHA-256, length and a second hash of the whole
    text all agree. ``keep`` says which id of a group stays. Null texts count as empty and so form a group with empty
    ones. Null ids come after all others, so they stay only where a group has no other; of rows that repeat an id in a
    group just one is kept. An empty table gives an empty result, and other columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep}")
    spark = docs.sparkSession
    p = power_of_two(partitions or shuffle_partitions(spark))
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = checkpoint(
        docs.select(
            F.col(id_col).alias("id"),
            F.monotonically_increasing_id().alias("uid"),
            F.unhex(F.sha2(text, 256)).alias("sha"),
            F.octet_length(text).cast("long").alias("size"),
            F.xxhash64(text).alias("check"),
            F.spark_partition_id().alias("home"),
        )
    )
    order = [F.asc_nulls_last("id") if keep == "smallest" else F.desc_nulls_last("id"), F.asc("uid")]
    slot = F.conv(F.substring(F.hex("sha"), 1, 7), 16, 10).cast("int") % p
    run = slim.select(*KEY, "id", "uid", F.lit(1).cast("long").alias("n"), (F.col("home") % p).alias("at"), slot.alias("slot"), "home")
    runs = run.sortWithinPartitions(*KEY, *order).mapInArrow(_fold, run.schema)
    merged = runs
    for bit in (1 << r for r in range(p.bit_length() - 1)):
        to = F.col("at").bitwiseAND(~bit).bitwiseOR(F.col("slot").bitwiseAND(bit))
        merged = merged.withColumn("at", to).repartitionById(p, F.col("at")).sortWithinPartitions(*KEY, *order).mapInArrow(_fold, run.schema)
    kept = merged.select(*KEY, F.col("id").alias("keep_id"), F.col("uid").alias("keep_uid"), F.col("n").alias("group_size"))
    # The answers go back the way the records came: one for each run that holds the digest, then one for each row.
    answers = runs.select(*KEY, "home").join(kept, KEY)
    return slim.join(answers, [*KEY, "home"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
