"""The registered queries of the block codec.

Embeddings serve as blocks: a vector of 64 numbers, none null or NaN, is one 8x8 block, and a label is an image of many
blocks; other vectors are no blocks and give no rows. Documents serve as images: the bytes of each whole text, 64 wide,
filled with zero bytes to whole rows of blocks; null and empty texts are no images. A block is worked on where it lies, in
numpy over Arrow batches, and only sums by image are shuffled, aggregated before. Repeated and null ids are blocks apart.
``oracle`` has the SQL, written as array expressions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables
from ..operators import batches as numeric
from ..operators import images, profile
from ..sources import images as files
from ..sources import sinks
from . import oracle

RANK, ZIGZAG = np.array(tables.rank()), np.array(tables.zigzag())
Query = Callable[[SparkSession, str], DataFrame]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, embedding) of the vectors that are blocks."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    return rows.filter((F.size("embedding") == 64) & fine)


def _by_block(key: str, fields: str, make: Callable[[np.ndarray], dict]) -> Query:
    """Columns that ``make`` gives for the pixels of a batch, beside the block's vec_id or its image; ``rows``, if it gives
    that, is how many rows each block has."""
    column = {"vec_id": "vec_id", "image": "label"}[key]

    def run(parts):
        for b in parts:
            if not b.num_rows:
                continue
            made = make(numeric.pixels(b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, 64)))
            ids = b.column(column)
            if (rows := made.pop("rows", None)) is not None:
                ids = ids.take(pa.array(np.repeat(np.arange(b.num_rows), rows)))
            yield pa.RecordBatch.from_arrays([ids, *(x if isinstance(x, pa.Array) else pa.array(x) for x in made.values())], names=[key, *made])

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = vectors(spark, sf_dir)
        return found.select(column, "embedding").mapInArrow(run, f"{key} {found.schema[column].dataType.simpleString()}, {fields}")

    return query


def _elements(values: Callable[[np.ndarray], np.ndarray]) -> Query:
    def make(px):
        v = values(px)
        return {"rows": np.full(len(v), 64), "pos": np.tile(np.arange(64, dtype=np.int32), len(v)), "v": v.reshape(-1).astype(np.int64)}

    return _by_block("vec_id", "pos int, v bigint", make)


def _scan(order: np.ndarray, arithmetic: str = "cpu") -> Callable[[np.ndarray], np.ndarray]:
    return lambda px: numeric.quantised(px, arithmetic)[:, order]


def _pairs(fields: str, columns: Callable[[numeric.Pairs], dict], order: np.ndarray = RANK) -> Query:
    """A row for each run-length pair."""

    def make(px):
        p = numeric.Pairs.of_scan(_scan(order)(px))
        return {"rows": p.count, **columns(p)}

    return _by_block("vec_id", fields, make)


def _index(p: numeric.Pairs) -> dict:
    return {"pair_idx": p.index.astype(np.int32)}


def _pair_columns(p: numeric.Pairs) -> dict:
    return _index(p) | {"zero_run": p.run.astype(np.int32), "value": p.value.astype(np.int32)}


PAIRS = "pair_idx int, zero_run int, value int"


def _bit_strings(p: numeric.Pairs) -> dict:
    code, length, *_ = p.codes()
    return _index(p) | {"bits": pa.array([f"{c:0{n}b}" for c, n in zip(code.tolist(), length.tolist())], pa.string())}


def _packed(px: np.ndarray) -> dict:
    bits, data, _ = numeric.Pairs.of_scan(_scan(ZIGZAG)(px)).packed()
    return {"bit_count": bits.astype(np.int32), "ac": pa.array([x.hex().upper() for x in data.to_pylist()], pa.string())}


def _unpacked(px: np.ndarray) -> dict:
    bits, data, _ = numeric.Pairs.of_scan(_scan(ZIGZAG)(px)).packed()
    p, fine = numeric.Pairs.unpacked(bits, data.to_pylist())
    if not fine.all():
        raise ValueError("bits that were just packed can't be read")
    return {"rows": p.count, **_pair_columns(p)}


def _decoded(px: np.ndarray) -> np.ndarray:
    s = _scan(RANK)(px)
    q = np.empty_like(s)
    q[:, RANK] = numeric.Pairs.of_scan(s).scan(s[:, 0])
    return numeric.restored(q)


def _slots(px: np.ndarray) -> dict:
    run, value = numeric.Pairs.of_scan(_scan(RANK)(px)).slots()
    n = len(run)
    return {"rows": np.full(n, 63), "slot": np.tile(np.arange(63, dtype=np.int32), n), "zero_run": run.reshape(-1).astype(np.int32), "value": value.reshape(-1).astype(np.int32)}


def _valid_slots(px: np.ndarray) -> dict:
    p = numeric.Pairs.of_scan(_scan(RANK)(px))
    p = numeric.Pairs.of_slots(p.count, *p.slots())
    return {"rows": p.count, **_pair_columns(p)}


def _totals(fields: str, make: Callable[[np.ndarray], dict], *columns: str) -> Query:
    """Aggregates over the blocks of each image."""
    blocks = _by_block("image", fields, make)
    return lambda spark, sf_dir: blocks(spark, sf_dir).groupBy("image").agg(*map(F.expr, columns))


def _count(px: np.ndarray) -> dict:
    return {"n": np.count_nonzero(_scan(RANK)(px)[:, 1:], axis=1)}


_SIZE = "CAST(152 + 3 * count(*) + 3 * sum(n) AS BIGINT)"


def _differs(arithmetic: str) -> Query:
    blocks = _by_block("image", "d boolean", lambda px: {"d": (numeric.quantised(px, "cpu") != numeric.quantised(px, arithmetic)).any(axis=1)})
    return lambda spark, sf_dir: blocks(spark, sf_dir).filter("d").groupBy("image").agg(F.count("*").alias("blocks"))


def _rec(px: np.ndarray) -> np.ndarray:
    return numeric.restored(numeric.quantised(px, "cpu"))


SUMS = ["pixels", "signed_error", "absolute_error", "squared_error", "signal", "exact_pixels", "within_1", "within_2"]
_errors = _by_block("image", ", ".join(f"{c} bigint" for c in ["pixels", "signed_error", "absolute_error", "squared_error", "signal", "max_absolute_error", "exact_pixels", "within_1", "within_2"]), lambda px: numeric.errors(px, _rec(px)))


def _summed() -> list:
    return [*[F.sum(c).alias(c) for c in SUMS], F.max("max_absolute_error").cast("int").alias("max_absolute_error")]


_FIGURES = ["mse", "rmse", "mae", "mean_error", "psnr_db", "snr_db", "exact_percent", "within_1_percent", "within_2_percent"]


def _rounded(sums: DataFrame) -> DataFrame:
    blank = {"width": "bigint", "height": "bigint", "mean_ssim_8x8": "double", "metric_time_ms": "double", "error": "string"}
    figures = images.derived(sums.withColumns({c: F.lit(None).cast(t) for c, t in blank.items()}))
    return figures.withColumns({c: F.when(F.abs(F.col(c)) < float("inf"), F.round(c, 6)).otherwise(F.col(c)) for c in _FIGURES})


def _metrics(*columns: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(_errors(spark, sf_dir).groupBy("image").agg(*_summed())).selectExpr(*columns)

    return query


def pooled_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_errors(spark, sf_dir).agg(*_summed()).withColumn("image", F.lit("AGGREGATE"))).select("pixels", "max_absolute_error", *_FIGURES)


def psnr_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of the lowest and the highest finite ratio, the first by name on a tie; one row if it is the same."""
    found = images.finite_psnr(_metrics("image", "psnr_db", "status")(spark, sf_dir))
    both = found.select(F.explode(F.array(*[F.struct(F.col(f"{w}_image").alias("image"), F.col(f"{w}_psnr_db").alias("psnr_db"), F.lit(w).alias("which")) for w in ("lowest", "highest")])).alias("x"), "lowest_image")
    return both.filter("x.psnr_db IS NOT NULL AND (x.which = 'lowest' OR NOT x.image <=> lowest_image)").select("x.*")


def mean_finite_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = F.col("mean_finite_psnr_db")
    return images.finite_psnr(_metrics("image", "psnr_db", "status")(spark, sf_dir)).select(F.when(mean < float("inf"), F.round(mean, 6)).otherwise(mean).alias("psnr_db"))


def aggregate_report_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _errors(spark, sf_dir).groupBy("image").agg(*_summed())
    each = _rounded(sums).selectExpr("CAST(image AS STRING) AS image", "pixels", "mse", "status")
    return each.unionByName(sums.agg(F.sum("pixels").alias("pixels"), F.sum("squared_error").alias("e")).selectExpr("'AGGREGATE' AS image", "pixels", "round(e / pixels, 6) AS mse", "'aggregate' AS status"))


def missing_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label as an original beside its reconstruction; a label without blocks has none."""
    originals = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("label IS NOT NULL").select(F.col("label").alias("image")).distinct()
    found = _metrics("image", "mse", "'ok' AS status")(spark, sf_dir)
    return originals.join(found, "image", "left").select("image", "mse", F.coalesce("status", F.lit("error")).alias("status"))


def _rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole text as an image, named by its doc_id, filled with zero bytes to whole rows of blocks."""
    px = F.encode("text", "UTF-8")
    rows = F.ceil(F.octet_length(px) / 512) * 8
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").filter("text <> ''")
    return docs.select(F.col("doc_id").cast("string").alias("image"), F.lit(64).cast("long").alias("width"), rows.cast("long").alias("height"), F.rpad(px, (rows * 64).cast("int"), F.lit(b"\x00")).alias("pixels"))


_DOC = "CAST(image AS BIGINT) AS doc_id"


def tile_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(parts):
        for b in parts:
            px = b.column("px").flatten().to_numpy(zero_copy_only=False).reshape(-1, 64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("image", "block_id", "bx", "by")), pa.array(px.sum(axis=1)), pa.array(px @ np.arange(1, 65))], names=["image", "block_id", "bx", "block_row", "total", "weighted"])

    summed = images.tile(_rasters(spark, sf_dir)).mapInArrow(run, "image string, block_id bigint, bx int, block_row int, total bigint, weighted bigint")
    return summed.select(F.expr(_DOC), "block_id", "bx", "block_row", "total", "weighted")


def _encoded(spark: SparkSession, sf_dir: str, arithmetic: str = "cpu", scan: str = "rank") -> DataFrame:
    return images.encode(images.tile(_rasters(spark, sf_dir)), arithmetic, scan)


def document_pairs(arithmetic: str, scan: str) -> Query:
    """Whole encoder over the documents: number of pairs and bytes of each block, without a shuffle."""
    return lambda spark, sf_dir: _encoded(spark, sf_dir, arithmetic, scan).select(F.expr(_DOC), "block_id", "dc", F.size("pairs").alias("pairs"), (3 + 3 * F.size("pairs")).alias("bytes"))


def _digest(made: DataFrame) -> DataFrame:
    return made.select(F.expr(_DOC), F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def gsc1_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(sinks.gsc1_files(_encoded(spark, sf_dir)))


def gsc2_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(sinks.gsc2_files(images.without_faults(images.pack(_encoded(spark, sf_dir, "cpu", "zigzag")))))


def gsc1_read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the files' bytes, read again."""
    read = files.parse_codec_files(sinks.gsc1_files(_encoded(spark, sf_dir)))
    runs, weighted = "aggregate(pairs, 0L, (s, p) -> s + p.zero_run)", "aggregate(transform(pairs, (p, k) -> CAST(p.value * (k + 1) AS BIGINT)), 0L, (s, x) -> s + x)"
    return read.select(F.expr(_DOC), "block_id", "dc", F.size("pairs").cast("long").alias("pairs"), F.expr(runs).alias("runs"), F.expr(weighted).alias("weighted"))


def pgm_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(sinks.pgm_files(_rasters(spark, sf_dir)))


def pgm_read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = files.parse_images(sinks.pgm_files(_rasters(spark, sf_dir)))
    return read.select(F.expr(_DOC), "width", "height", F.sha2("pixels", 256).alias("sha256"), "error")


def compression_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sinks.gsc1_files(_encoded(spark, sf_dir)).select("image", F.octet_length("content").cast("long").alias("compressed_bytes"))
    raw = _rasters(spark, sf_dir).select("image", (F.col("width") * F.col("height")).alias("raw_bytes"))
    return images.size_summary(raw.join(made, "image")).withColumn("compression_ratio", F.round("compression_ratio", 6))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on documents: encoded, written, read, decoded and compared."""
    named = lambda df, end: df.withColumn("image", F.concat("image", F.lit(end)))
    made = sinks.gsc1_files(_encoded(spark, sf_dir))
    rec = images.assemble(images.decode(files.parse_codec_files(made)))
    return images.report(images.compare(named(_rasters(spark, sf_dir), ".pgm"), named(rec, "_stream.pgm")))


def comparison_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as text; without the times, which differ from run to run."""
    return images.formatted(_compared(spark, sf_dir)).drop("metric_time_ms")


def comparison_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = images.comparison_summary(_compared(spark, sf_dir))
    shown = lambda f: F.when(F.abs(F.col(f.name)) < float("inf"), F.round(f.name, 6)).otherwise(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
    return out.select(*[shown(f) for f in out.schema])


def _times(spark: SparkSession, sf_dir: str, stages: list[str]) -> DataFrame:
    """Events as measured times: the stage, image and run of each are made from its number."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("user_id IS NOT NULL")
    stage = F.element_at(F.array(*map(F.lit, stages)), (F.col("event_id") % len(stages) + 1).cast("int"))
    run = F.floor(F.col("event_id") / len(stages)) % 3
    return events.select(F.concat(F.lit("i"), F.col("user_id").cast("string")).alias("image"), stage.alias("stage"), run.cast("int").alias("run"), F.col("value").alias("ms"))


def _profile(make: Callable, stages: list[str]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        runs = _times(spark, sf_dir, stages)
        sizes = runs.select("image").distinct().selectExpr("image", "262144 AS raw_bytes", "65536 AS compressed_bytes", "0 AS status")
        out = make(runs, sizes)
        return out.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in out.schema])

    return query


def sample_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.sample_stats(_times(spark, sf_dir, oracle.STREAM_STAGES)).withColumn("avg_ms", F.round("avg_ms", 6))


def _image_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _times(spark, sf_dir, oracle.STREAM_STAGES).groupBy("image").agg(F.sum("ms").alias("ms")).selectExpr("image", "ms", "262144 AS pixels", "4096 AS blocks")


def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.throughput(_image_times(spark, sf_dir)).selectExpr("images", "pixels", "round(megapixels_per_s, 6) AS megapixels_per_s", "round(images_per_s, 6) AS images_per_s")


def stage_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by stage; an image's own time is taken as a quarter more than its stages'."""
    totals = _image_times(spark, sf_dir).withColumn("ms", F.col("ms") * 1.25)
    out = profile.stage_profile(_times(spark, sf_dir, oracle.STREAM_STAGES), totals)
    return out.select("stage", *[F.round(c, 4).alias(c) for c in ("total_ms", "ms_per_image", "percent", "us_per_block")])


def queries() -> dict[str, Query]:
    band = "CASE WHEN psnr_db >= 40 THEN 'very high' WHEN psnr_db >= 30 THEN 'good' WHEN psnr_db >= 25 THEN 'acceptable' ELSE 'degraded' END AS band"
    return {
        "level_shift": _elements(lambda px: px - 128),
        "dct_cpu_rounded": _elements(lambda px: numeric.away(numeric.dct(px) * 1000)),
        "quantise_cpu": _elements(lambda px: numeric.quantised(px, "cpu")),
        "scan_rank": _elements(_scan(RANK)),
        "scan_zigzag": _elements(_scan(ZIGZAG)),
        "dequantise": _elements(lambda px: numeric.quantised(px, "cpu") * np.array(tables.QUANT)),
        "idct_pixels": _elements(_rec),
        "decode_pairs": _elements(_decoded),
        "dct_stream_fixed": _elements(lambda px: numeric.dct(px, "stream")),
        "quantise_stream": _elements(lambda px: numeric.quantised(px, "stream")),
        "dct_fourk_fixed": _elements(lambda px: numeric.dct(px, "fourk")),
        "quantise_fourk": _elements(lambda px: numeric.quantised(px, "fourk")),
        "rle_pairs": _pairs(PAIRS, _pair_columns),
        "rle_decode": _pairs("pos bigint, value int", lambda p: {"pos": p.position, "value": p.value.astype(np.int32)}),
        "rle_pair_counts": _by_block("vec_id", "pairs bigint", lambda px: {"pairs": _count(px)["n"]}),
        "magnitude_category": _pairs("pair_idx int, category int", lambda p: _index(p) | {"category": p.codes()[2].astype(np.int32)}, ZIGZAG),
        "amplitude_code": _pairs("pair_idx int, amplitude bigint", lambda p: _index(p) | {"amplitude": p.codes()[3]}, ZIGZAG),
        "ac_bit_string": _pairs("pair_idx int, bits string", _bit_strings, ZIGZAG),
        "pack_bits": _by_block("vec_id", "bit_count int, ac string", _packed),
        "unpack_bits": _by_block("vec_id", PAIRS, _unpacked),
        "fixed_slots": _by_block("vec_id", "slot int, zero_run int, value int", _slots),
        "valid_slots": _by_block("vec_id", PAIRS, _valid_slots),
        "compressed_size_gsc1": _totals("n bigint", _count, f"{_SIZE} AS bytes"),
        "compression_ratio": _totals("n bigint", _count, f"round(64 * count(*) / {_SIZE}, 6) AS ratio"),
        "payload_size": _totals("n bigint", _count, f"{_SIZE} - 152 AS bytes"),
        "avg_pairs_per_block": _totals("n bigint", _count, "round(avg(n), 6) AS pairs"),
        "zero_coeff_pct": _totals("z bigint", lambda px: {"z": (numeric.quantised(px, "cpu") == 0).sum(axis=1)}, "round(100 * sum(z) / (64 * count(*)), 6) AS zero_percent"),
        "gsc2_size": _totals("b bigint", lambda px: {"b": 4 + (numeric.Pairs.of_scan(_scan(ZIGZAG)(px)).packed()[0] + 7) // 8}, "CAST(152 + sum(b) AS BIGINT) AS bytes"),
        "ssim_8x8": _totals("s double", lambda px: {"s": numeric.similarity(px, _rec(px))}, "count(*) AS windows", "round(avg(s), 6) AS mean_ssim_8x8"),
        "cpu_vs_stream_diff": _differs("stream"),
        "cpu_vs_fourk_diff": _differs("fourk"),
        "pixel_error_metrics": _metrics("image", "pixels", "mse", "rmse", "mae", "mean_error", "max_absolute_error", "exact_percent", "within_1_percent", "within_2_percent"),
        "psnr_snr": _metrics("image", "psnr_db", "snr_db"),
        "psnr_band": _metrics("image", band),
        "pooled_metrics": pooled_metrics,
        "mean_finite_psnr": mean_finite_psnr,
        "psnr_extremes": psnr_extremes,
        "aggregate_report_union": aggregate_report_union,
        "missing_reconstruction": missing_reconstruction,
        "tile_documents": tile_documents,
        "encode_documents_cpu": document_pairs("cpu", "rank"),
        "encode_documents_stream": document_pairs("stream", "rank"),
        "gsc1_documents": gsc1_documents,
        "gsc1_read_documents": gsc1_read_documents,
        "gsc2_documents": gsc2_documents,
        "pgm_documents": pgm_documents,
        "pgm_read_documents": pgm_read_documents,
        "compression_summary": compression_summary,
        "comparison_report": comparison_report,
        "comparison_summary": comparison_summary,
        "sample_stats": sample_stats,
        "throughput": throughput,
        "stage_profile": stage_profile,
        "stream_profile": _profile(profile.stream_profile, oracle.STREAM_STAGES),
        "hardware_profile": _profile(profile.hardware_profile, oracle.WIDE_STAGES),
    }


oracle_sql = oracle.sql
