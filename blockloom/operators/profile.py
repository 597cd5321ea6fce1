"""Summaries of measured times: rows of (image, stage, ms), one a stage and timed run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_profile(times: DataFrame, totals: DataFrame) -> DataFrame:
    """(stage, total_ms, ms_per_image, percent, us_per_block) with a row ``other`` for what no stage took, never below zero.

    ``totals``: (image, ms, blocks), one row an image."""
    all_ = totals.agg(F.sum("ms").alias("all_ms"), F.count("*").alias("images"), F.sum("blocks").alias("blocks"))
    stages = times.groupBy("stage").agg(F.sum("ms").alias("total_ms"))
    # One row from an aggregate without keys, so its size is known.
    other = F.broadcast(all_).join(stages.agg(F.coalesce(F.sum("total_ms"), F.lit(0.0)).alias("used"))).selectExpr("'other' AS stage", "greatest(0D, all_ms - used) AS total_ms")
    share = "CASE WHEN {0} > 0 THEN {1} / {0} END"
    return stages.unionByName(other).join(F.broadcast(all_)).selectExpr(
        "stage", "total_ms", f"{share.format('images', 'total_ms')} AS ms_per_image", f"{share.format('all_ms', '100D * total_ms')} AS percent", f"{share.format('blocks', '1000D * total_ms')} AS us_per_block"
    )


def sample_stats(runs: DataFrame, warm_up: int = 1) -> DataFrame:
    """(image, stage, runs, avg_ms, min_ms, max_ms) over the timed runs, numbered by ``run`` from 0, after the warm-up; without
    any, an error."""
    timed = runs.filter(F.col("run") >= warm_up)
    if timed.isEmpty():
        raise ValueError("no timed run")
    return timed.groupBy("image", "stage").agg(F.count("*").alias("runs"), F.avg("ms").alias("avg_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"))


def throughput(totals: DataFrame) -> DataFrame:
    """(images, pixels, megapixels_per_s, images_per_s) from (image, pixels, ms); null where no time passed."""
    s = totals.agg(F.count("*").alias("images"), F.sum("pixels").alias("pixels"), F.sum("ms").alias("ms"))
    return s.selectExpr("images", "pixels", "CASE WHEN ms > 0 THEN pixels / 1e6D / (ms / 1e3D) END AS megapixels_per_s", "CASE WHEN ms > 0 THEN images / (ms / 1e3D) END AS images_per_s")


def _figures(runs: DataFrame, kernels: list[str], warm_up: int) -> tuple[DataFrame, dict]:
    """Sums by image and run, and columns over an image's runs: ``once`` for what is measured in the first run only, avg,
    min and max of a kernel over the timed runs, all kernels together as ``total_kernel``."""
    stages = [r for r in ONCE if r not in kernels]
    by_run = runs.groupBy("image", "run").agg(
        *[F.sum(F.when(F.col("stage") == s, F.col("ms"))).alias(s) for s in [*stages, *kernels]], F.sum(F.when(F.col("stage").isin(kernels), F.col("ms"))).alias("total_kernel")
    )
    timed = F.col("run") >= warm_up
    columns = {f"{s}_ms": F.coalesce(F.sum(F.when(F.col("run") == 0, F.col(s))), F.lit(0.0)) for s in stages}
    for k in [*kernels, "total_kernel"]:
        columns |= {f"{k}_{n}_ms": f(F.when(timed, F.col(k))) for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))}
    columns["timed_runs"] = F.count(F.when(timed, F.col("total_kernel")))
    return by_run, columns


ONCE = ["pgm_load", "host_copy", "h2d", "d2h", "file_write", "end_to_end"]


def _ratio():
    return F.when(F.col("compressed_bytes") > 0, F.col("raw_bytes") / F.col("compressed_bytes")).otherwise(0.0).alias("compression_ratio")


def _speed(ms: str):
    return F.when(F.col(ms) > 0, F.col("raw_bytes") / 1e6 / (F.col(ms) / 1e3)).otherwise(0.0).alias("kernel_mpix_per_s")


def stream_profile(runs: DataFrame, sizes: DataFrame, warm_up: int = 1) -> DataFrame:
    """The profile of one streamed kernel, 16 columns, a row an image. runs: (image, stage, run, ms), with the stages
    ``pgm_load host_copy h2d kernel d2h file_write``; sizes: (image, raw_bytes, compressed_bytes), a byte a pixel."""
    by_run, columns = _figures(runs, ["kernel"], warm_up)
    out = by_run.groupBy("image").agg(*[c.alias(n) for n, c in columns.items()]).join(sizes, "image")
    out = out.withColumn("pipeline_with_transfer_avg_ms", F.col("h2d_ms") + F.col("kernel_avg_ms") + F.col("d2h_ms"))
    out = out.withColumn("estimated_end_to_end_avg_ms", F.col("pgm_load_ms") + F.col("host_copy_ms") + F.col("pipeline_with_transfer_avg_ms") + F.col("file_write_ms"))
    return out.select(
        "image", "raw_bytes", "compressed_bytes", _ratio(), "timed_runs", "pgm_load_ms", "host_copy_ms", "h2d_ms", "kernel_avg_ms", "kernel_min_ms", "kernel_max_ms",
        "d2h_ms", "file_write_ms", "pipeline_with_transfer_avg_ms", "estimated_end_to_end_avg_ms", _speed("kernel_avg_ms"),
    )


KERNELS = ["load_shift", "dct", "quantise", "encode"]


def hardware_profile(runs: DataFrame, sizes: DataFrame, warm_up: int = 1) -> DataFrame:
    """The profile of four kernels, 28 columns, a row an image. runs as in stream_profile, with the stages of KERNELS in
    place of ``kernel``, and ``end_to_end``; sizes: (image, raw_bytes, compressed_bytes, status)."""
    by_run, columns = _figures(runs, KERNELS, warm_up)
    out = by_run.groupBy("image").agg(*[c.alias(n) for n, c in columns.items()]).join(sizes, "image")
    spread = [f"{k}_{n}_ms" for k in [*KERNELS, "total_kernel"] for n in ("avg", "min", "max")]
    return out.select(
        "image", "raw_bytes", "compressed_bytes", _ratio(), "status", "timed_runs", "pgm_load_ms", "host_copy_ms", "h2d_ms", *spread, "d2h_ms", "file_write_ms", "end_to_end_ms", _speed("total_kernel_avg_ms")
    )
