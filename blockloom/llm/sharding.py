"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered in the order of their ids; the permuted number of a row says its shard (remainder) and its slot
(quotient), so both can be computed from the number alone and back, without a table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import checkpoint, shuffle_partitions, table

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser with good avalanche (multiply and xor-shift)."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Feistel:
    """A keyed permutation of 0..n-1: balanced Feistel rounds over the least even number of bits that holds n, walked
    along its cycle until it comes back below n (fewer than four steps on average)."""

    def __init__(self, n: int, seed: int = 0):
        self.n = n
        self.half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = [int(k) for k in _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 % (1 << 60)), seed & (2**64 - 1))]

    def _once(self, x: np.ndarray, keys: list[int], inverse: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            if inverse:
                left, right = right ^ (_mix(left, k) & self.mask), left
            else:
                left, right = right, left ^ (_mix(right, k) & self.mask)
        return (left << self.half) | right

    def _walk(self, x, keys, inverse) -> np.ndarray:
        y = self._once(np.asarray(x, dtype=np.uint64), keys, inverse)
        out = np.flatnonzero(y >= np.uint64(self.n))
        while out.size:
            y[out] = self._once(y[out], keys, inverse)
            out = out[y[out] >= np.uint64(self.n)]
        return y.astype(np.int64)

    def forward(self, x) -> np.ndarray:
        return self._walk(x, self.keys, False)

    def backward(self, y) -> np.ndarray:
        return self._walk(y, self.keys[::-1], True)


def place(row: np.ndarray, n: int, shards: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of global row numbers."""
    at = Feistel(n, seed).forward(row)
    return at % shards, at // shards


def row_at(shard, slot, n: int, shards: int, seed: int = 0) -> np.ndarray:
    """The global row number that is in this slot of this shard."""
    return Feistel(n, seed).backward(np.asarray(slot) * shards + np.asarray(shard))


def shard(docs: DataFrame, shards: int = 8, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, size, text_crc32, law, shard, slot, grown_shard, row_number.

    The law is ``rows``: shards differ by one row at most, and slots in a shard are gapless from 0. Global row numbers
    follow id, then checksum and size of the text; rows alike in all of these can change places with no effect. Null ids
    are numbered first, null texts have size 1 and checksum 0. An empty table gives an empty result, other columns are
    ignored.
    """
    spark = docs.sparkSession
    slim = checkpoint(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("crc"),
            F.monotonically_increasing_id().alias("uid"),
        )
    )
    order = ["id", "crc", "size", "uid"]
    ranged = checkpoint(slim.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    counts = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}  # one number for each partition
    first, n = {}, 0
    for part in sorted(counts):
        first[part], n = n, n + counts[part]

    def number(batches):
        seen = 0
        for b in batches:
            if not b.num_rows:
                continue
            rows = first[b.column("part")[0].as_py()] + seen + np.arange(b.num_rows, dtype=np.int64)
            seen += b.num_rows
            s, t = place(rows, n, shards, seed)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("size"), b.column("crc"), pa.array(["rows"] * b.num_rows), pa.array(s, pa.int32()), pa.array(t, pa.int64()), pa.nulls(b.num_rows, pa.int32()), pa.array(rows)],
                names=[id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard", "row_number"],
            )

    kind = ranged.schema["id"].dataType.simpleString()
    return ranged.mapInArrow(number, f"`{id_col}` {kind}, size long, text_crc32 long, law string, shard int, slot long, grown_shard int, row_number long")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), shards=8, seed=20240)
