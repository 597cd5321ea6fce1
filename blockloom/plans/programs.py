"""Whole jobs over folders: compress, decompress, compare. A bad file is a row with an error, and the others go on."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import images
from ..sources import images as files
from ..sources import sinks


def _found(rows: DataFrame | None, path: str, what: str) -> DataFrame:
    if rows is None or rows.select("image").isEmpty():
        raise FileNotFoundError(f"no {what} in {path}")
    return rows


def _read(make, *args, **named) -> DataFrame | None:
    try:
        return make(*args, **named)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def _stem(column: str):
    return F.regexp_replace(column, r"(?<=.)\.[^.]*$", "")


def compress(spark: SparkSession, path: str, out: str, arithmetic: str = "cpu", suffix: str = ".gsc", strict: bool = True, size: tuple[int, int] | None = None) -> DataFrame:
    """Write one codec file an image to ``out``: the second format for ``fourk``, else the first. Returns (image,
    raw_bytes, compressed_bytes, compression_ratio, status, error); images with a bad file or a fault in a block aren't
    written. A missing folder, or one without images, is a FileNotFoundError."""
    read = _found(_read(files.read_pgm, spark, path, strict=strict, size=size), path, "images")
    tiles = images.tile(read)
    if arithmetic == "fourk":
        packed = images.pack(images.encode(tiles, arithmetic, "zigzag"))
        made, faults = sinks.gsc2_files(images.without_faults(packed)), images.image_status(packed).filter("status <> 0").selectExpr("image", "concat('status ', status) AS fault")
    else:
        made, faults = sinks.gsc1_files(images.encode(tiles, arithmetic)), None
    sinks.write_files(spark, made.select(F.concat(_stem("image"), F.lit(suffix)).alias("image"), "content"), out)
    sizes = spark.read.format("binaryFile").load(out).select(F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B"))).alias("file"), F.col("length").alias("compressed_bytes"))
    result = read.select("image", (F.col("width") * F.col("height")).alias("raw_bytes"), "error", F.concat(_stem("image"), F.lit(suffix)).alias("file")).join(sizes, "file", "left")
    if faults is not None:
        result = result.join(faults, "image", "left").withColumn("error", F.coalesce("error", "fault"))
    result = result.withColumn("error", F.coalesce("error", F.when(F.col("compressed_bytes").isNull(), "not written")))
    ok = F.col("error").isNull()
    return result.select(
        "image", F.when(ok, F.col("raw_bytes")).alias("raw_bytes"), F.when(ok, F.col("compressed_bytes")).alias("compressed_bytes"),
        F.when(ok, F.when(F.col("compressed_bytes") > 0, F.col("raw_bytes") / F.col("compressed_bytes")).otherwise(0.0)).alias("compression_ratio"), F.when(ok, "ok").otherwise("error").alias("status"), "error",
    )


def decompress(spark: SparkSession, path: str, out: str, version: int = 1, scan: str = "rank") -> DataFrame:
    """Write one image a codec file to ``out``, named by its stem. Returns (image, reconstructed_bytes, status, error). A
    missing folder is a FileNotFoundError; one without codec files gives no rows."""
    read = _read(files.read_gsc, spark, path, version)
    if read is None:
        raise FileNotFoundError(f"no folder {path}")
    blocks = read if version == 1 else images.unpack(read.filter("error IS NULL")).withColumn("error", F.lit(None).cast("string"))
    rec = images.assemble(images.decode(blocks, scan))
    sinks.write_files(spark, sinks.pgm_files(rec.filter("pixels IS NOT NULL").select(F.concat(_stem("image"), F.lit(".pgm")).alias("image"), "width", "height", "pixels")), out)
    head = F.octet_length(F.format_string("P5\n%d %d\n255\n", "width", "height"))
    good = rec.select("image", (head + F.octet_length("pixels")).cast("long").alias("reconstructed_bytes"), F.when(F.col("pixels").isNull(), "a block can't be read").alias("error"))
    every = good.unionByName(read.filter("error IS NOT NULL").select("image", F.lit(None).cast("long").alias("reconstructed_bytes"), "error"))
    return every.select("image", "reconstructed_bytes", F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), "error")


def compare(spark: SparkSession, originals: str, decompressed: str, out: str, suffix: str = "_stream.pgm") -> DataFrame:
    """Write the report as CSV to ``out`` and return its summary, whose exit_code is 1 if any image failed. A missing folder
    of originals, or one without ``.pgm`` files (this case only), is a FileNotFoundError, as is a missing other folder."""
    left = _found(_read(files.read_pgm, spark, originals, any_case=False), originals, "originals")
    right = _read(files.read_pgm, spark, decompressed)
    if right is None:
        raise FileNotFoundError(f"no folder {decompressed}")
    sums = images.compare(left, right, suffix)
    # The figures are computed once: written, and summed up from what was written.
    sinks.write_report(images.formatted(images.report(sums)), out)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in images.report(sums).schema)
    text = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("positiveInf", "inf").option("negativeInf", "-inf").option("nanValue", "nan").schema(kinds).csv(out)
    return images.comparison_summary(text)
