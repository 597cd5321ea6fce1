"""Images that arrive in a folder, encoded as they come. Every step up to the pairs is narrow and keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.images import encode, tile
from ..sources.images import read_pgm


def encoded_stream(spark: SparkSession, path: str, arithmetic: str = "cpu", scan: str = "rank", strict: bool = True) -> DataFrame:
    return encode(tile(read_pgm(spark, path, strict=strict, stream=True)), arithmetic, scan)


def start(encoded: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet all that is there now; started again with the same checkpoint, go on where it ended."""
    return encoded.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
