"""Images as tables: tiling, the whole encoder and decoder, and the comparison report."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.dialect import Spark
from . import batches as numeric
from . import codec

D = Spark()
#: Rows of blocks in a batch that is handed on.
STRIP = 64
KEYS = ["image", "width", "height", "block_id"]
SCANS = {"rank": tables.rank, "zigzag": tables.zigzag}


def tile(images: DataFrame, tiled_size: bool = False) -> DataFrame:
    """(image, width, height, block_id, bx, by, px) for each whole 8x8 block; what is left at the edges goes. The size stays
    that of the image, so a file of an image whose sides aren't multiples of 8 can be written but not read again, as the
    format has it; with ``tiled_size`` it is that of the blocks. Rows without pixels give nothing."""

    def run(batches):
        for b in batches:
            for name, w, h, px in zip(b.column("image").to_pylist(), b.column("width").to_pylist(), b.column("height").to_pylist(), b.column("pixels")):
                if px.as_py() is None:
                    continue
                grid = np.frombuffer(px.as_buffer(), np.uint8, w * h).reshape(h, w)
                across, down = w // 8, h // 8
                for start in range(0, down if across else 0, STRIP):
                    rows = min(STRIP, down - start)
                    part = grid[start * 8 : (start + rows) * 8, : across * 8].reshape(rows, 8, across, 8).transpose(0, 2, 1, 3).astype(np.int32)
                    n = rows * across
                    ids = np.arange(start * across, start * across + n)
                    values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 64), pa.array(part.reshape(-1)))
                    size = [pa.array(np.full(n, v, dtype=np.int64)) for v in ((8 * across, 8 * down) if tiled_size else (w, h))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * n, pa.string()), *size, pa.array(ids), pa.array((ids % across).astype(np.int32)), pa.array((ids // across).astype(np.int32)), values],
                        names=["image", "width", "height", "block_id", "bx", "by", "px"],
                    )

    return images.select("image", "width", "height", "pixels").mapInArrow(run, "image string, width bigint, height bigint, block_id bigint, bx int, by int, px array<int>")


def encode(blocks: DataFrame, arithmetic: str = "cpu", scan: str = "rank") -> DataFrame:
    """(image, width, height, block_id, dc, pairs), by batches in numpy: nested lambdas are interpreted and far slower.
    Narrow, so that it runs on streams as well. Rows that hold no 64 pixels give nothing."""
    order = SCANS[scan]()

    def run(parts):
        for b in parts:
            s = numeric.quantised(b.column("px").flatten().to_numpy(zero_copy_only=False).reshape(-1, 64), arithmetic)[:, order]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("image", "width", "height", "block_id")), pa.array(s[:, 0].astype(np.int32)), numeric.pairs_of(s)], names=["image", "width", "height", "block_id", "dc", "pairs"])

    full = blocks.filter("size(px) = 64").select("image", "width", "height", "block_id", "px")
    return full.mapInArrow(run, "image string, width bigint, height bigint, block_id bigint, dc int, pairs array<struct<zero_run: int, value: int>>")


def encode_sql(blocks: DataFrame, arithmetic: str = "cpu", scan: str = "rank") -> DataFrame:
    """As ``encode``, in expressions only."""
    steps = {
        "cpu": lambda x: codec.quantise(D, codec.dct(D, x)),
        "stream": lambda x: codec.quantise_stream(D, codec.dct_stream(D, x)),
        "fourk": lambda x: codec.quantise_fourk(D, codec.dct_fourk(D, x)),
    }
    q = codec.permute(D, SCANS[scan](), steps[arithmetic](codec.level_shift(D)))
    pair = "struct(CAST(p - IF(k = 0, 0, at[k - 1]) - 1 AS INT) AS zero_run, CAST(s[p] AS INT) AS value)"
    pairs = f"transform(array(filter(sequence(1, 63), p -> s[p] <> 0)), at -> transform(at, (p, k) -> {pair}))[0]"
    both = D.let(q, "s", f"struct(CAST(s[0] AS INT) AS dc, {pairs} AS pairs)")
    return blocks.select("image", "width", "height", "block_id", F.expr(both).alias("e")).select("image", "width", "height", "block_id", "e.dc", "e.pairs")


def pack(encoded: DataFrame) -> DataFrame:
    """(image, width, height, block_id, dc, bit_count, ac, status): symbols of 8 bits and amplitudes, highest bit first, the
    last byte filled with zeros; Pairs.packed() has the meaning of the status. A null list of pairs has none."""

    def run(batches):
        for b in batches:
            bits, data, status = numeric.Pairs.of_arrow(b.column("pairs")).packed()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in KEYS), b.column("dc"), pa.array(bits.astype(np.int32)), data, pa.array(status.astype(np.int32))], names=[*KEYS, "dc", "bit_count", "ac", "status"])

    return encoded.select(*KEYS, "dc", "pairs").mapInArrow(run, "image string, width bigint, height bigint, block_id bigint, dc int, bit_count int, ac binary, status int")


def image_status(packed: DataFrame) -> DataFrame:
    """(image, status, bytes): the faults of all its blocks together, and the size of its file."""
    return packed.groupBy("image").agg(F.bit_or("status").alias("status"), (F.lit(152) + F.sum(4 + F.ceil(F.col("bit_count") / 8))).cast("long").alias("bytes"))


def without_faults(packed: DataFrame) -> DataFrame:
    """Blocks of the images none of whose blocks has a fault: the others are not written."""
    faulty = packed.filter("status <> 0").select("image").distinct()
    return packed.join(faulty, "image", "left_anti").select(*packed.columns)


def unpack(packed: DataFrame) -> DataFrame:
    """Pairs of packed blocks again; the other columns stay. Blocks whose bits aren't whole have null pairs."""

    def run(batches):
        for b in batches:
            pairs, fine = numeric.Pairs.unpacked(b.column("bit_count").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), [x or b"" for x in b.column("ac").to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pairs.arrow(fine)], names=[*b.schema.names, "pairs"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema.fields)
    return packed.mapInArrow(run, f"{fields}, pairs array<struct<zero_run: int, value: int>>")


def to_slots(encoded: DataFrame) -> DataFrame:
    """(image, width, height, block_id, dc, pair_count, zero_runs, values): lists of 63, zeros behind the block's pairs."""

    def run(batches):
        for b in batches:
            pairs = numeric.Pairs.of_arrow(b.column("pairs"))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * numeric.SLOTS), pa.array(x.reshape(-1).astype(np.int32))) for x in pairs.slots()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in KEYS), b.column("dc"), pa.array(pairs.count.astype(np.int32)), *lists], names=[*KEYS, "dc", "pair_count", "zero_runs", "values"])

    return encoded.select(*KEYS, "dc", "pairs").mapInArrow(run, "image string, width bigint, height bigint, block_id bigint, dc int, pair_count int, zero_runs array<int>, values array<int>")


def from_slots(slots: DataFrame) -> DataFrame:
    """The pairs in the valid slots; what stands behind them is not looked at."""

    def run(batches):
        for b in batches:
            run_, value = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, numeric.SLOTS) for c in ("zero_runs", "values"))
            pairs = numeric.Pairs.of_slots(b.column("pair_count").to_numpy(zero_copy_only=False).astype(np.int64), run_, value)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in KEYS), b.column("dc"), pairs.arrow()], names=[*KEYS, "dc", "pairs"])

    return slots.mapInArrow(run, "image string, width bigint, height bigint, block_id bigint, dc int, pairs array<struct<zero_run: int, value: int>>")


def pair_total(encoded: DataFrame) -> DataFrame:
    """(image, blocks, pairs); a block of over 63 pairs ends the query."""
    n = F.coalesce(F.size("pairs"), F.lit(0))
    checked = F.when(n <= numeric.SLOTS, n).otherwise(F.raise_error(F.lit("a block has over 63 pairs")).cast("int"))
    return encoded.groupBy("image").agg(F.count("*").alias("blocks"), F.sum(checked).cast("long").alias("pairs"))


def decode(encoded: DataFrame, scan: str = "rank") -> DataFrame:
    """(image, width, height, padded_width, block_id, rec): pixels of each block, by the quantisation matrix of its file.
    A block without pairs to read, or whose pairs leave it, has null pixels."""
    order = np.array(SCANS[scan]())

    def run(batches):
        for b in batches:
            pairs = numeric.Pairs.of_arrow(b.column("pairs"))
            scanned = pairs.scan(b.column("dc").to_numpy(zero_copy_only=False))
            q = np.empty_like(scanned)
            q[:, order] = scanned
            steps = b.column("qmatrix").flatten().to_numpy(zero_copy_only=False).reshape(-1, 64)
            rec = numeric.restored(q, steps).astype(np.int32)
            fine = pairs.fits & b.column("pairs").is_valid().to_numpy(zero_copy_only=False)
            values = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * 64), pa.array(rec.reshape(-1)), mask=pa.array(~fine))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*KEYS[:3], "padded_width", "block_id")), values], names=[*KEYS[:3], "padded_width", "block_id", "rec"])

    good = encoded.filter("error IS NULL") if "error" in encoded.columns else encoded
    return good.select(*KEYS[:3], "padded_width", "block_id", "dc", "pairs", "qmatrix").mapInArrow(run, "image string, width bigint, height bigint, padded_width bigint, block_id bigint, rec array<int>")


def assemble(decoded: DataFrame) -> DataFrame:
    """(image, width, height, pixels), cropped to the size of the image; null pixels where a block has none or is missing.
    The blocks of one image meet in one task."""
    schema = "image string, width bigint, height bigint, pixels binary"

    def whole(w, h, wide, blocks):
        down, across = -(-h // 8), wide // 8
        if len(blocks) != down * across or blocks.values.field("rec").null_count:
            return None
        px = np.asarray(blocks.values.field("rec").flatten(), dtype=np.uint8).reshape(-1, across, 8, 8)
        return px.transpose(0, 2, 1, 3).reshape(-1, wide)[:h, :w].tobytes()

    def run(batches):
        for b in batches:
            rasters = [whole(*x) for x in zip(*(b.column(c).to_pylist() for c in ("width", "height", "padded_width")), b.column("b"))]
            yield pa.RecordBatch.from_arrays([b.column("image"), b.column("width"), b.column("height"), pa.array(rasters, pa.binary())], names=["image", "width", "height", "pixels"])

    grouped = decoded.groupBy("image", "width", "height", "padded_width").agg(F.array_sort(F.collect_list(F.struct("block_id", "rec"))).alias("b"))
    return grouped.mapInArrow(run, schema)


def mean_ssim(a: np.ndarray, b: np.ndarray) -> float:
    """Over 8x8 windows side by side; those at the edges count with the pixels they have."""
    rows, cols = np.arange(0, a.shape[0], 8), np.arange(0, a.shape[1], 8)
    a, b = a.astype(np.float64), b.astype(np.float64)
    over = lambda x: np.add.reduceat(np.add.reduceat(x, rows, axis=0), cols, axis=1)
    n = over(np.ones_like(a))
    ma, mb = over(a) / n, over(b) / n
    va, vb, c = over(a * a) / n - ma * ma, over(b * b) / n - mb * mb, over(a * b) / n - ma * mb
    k1, k2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float(np.mean((2 * ma * mb + k1) * (2 * c + k2) / ((ma * ma + mb * mb + k1) * (va + vb + k2))))


SUMS_SCHEMA = "image string, width bigint, height bigint, pixels bigint, signed_error bigint, absolute_error bigint, squared_error bigint, signal bigint, max_absolute_error int, exact_pixels bigint, within_1 bigint, within_2 bigint, mean_ssim_8x8 double, metric_time_ms double, error string"


def compare(originals: DataFrame, reconstructed: DataFrame, suffix: str = "_stream.pgm") -> DataFrame:
    """SUMS_SCHEMA, one row an original. Its reconstruction is named by its stem and the suffix; where there is none, or one
    of another size, or a file could not be read, ``error`` says so and the figures are null."""
    stem = F.regexp_replace("image", r"(?<=.)\.[^.]*$", "")
    left = originals.select("image", "width", "height", "pixels", (F.col("error") if "error" in originals.columns else F.lit(None).cast("string")).alias("error"), F.concat(stem, F.lit(suffix)).alias("want"))
    right = reconstructed.select(F.col("image").alias("want"), F.col("width").alias("w"), F.col("height").alias("h"), F.col("pixels").alias("px"), (F.col("error") if "error" in reconstructed.columns else F.lit(None).cast("string")).alias("e"))
    fault = F.coalesce("error", "e", F.when(F.col("px").isNull(), "no reconstruction"), F.when((F.col("width") != F.col("w")) | (F.col("height") != F.col("h")), "sizes differ"))
    joined = left.join(right, "want", "left").select("image", "width", "height", "pixels", "px", fault.alias("error"))
    names = [f.split()[0] for f in SUMS_SCHEMA.split(", ")]
    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    kinds = [types[f.split()[1]] for f in SUMS_SCHEMA.split(", ")]

    def run(batches):
        for b in batches:
            rows = []
            for name, w, h, x, y, error in zip(*(b.column(c).to_pylist() for c in ("image", "width", "height", "pixels", "px", "error"))):
                row = [name, *[None] * (len(names) - 2), error]
                if error is None:
                    start = time.perf_counter()
                    o, r = (np.frombuffer(v, np.uint8, w * h).reshape(h, w).astype(np.int64) for v in (x, y))
                    d = r - o
                    a = np.abs(d)
                    row = [name, w, h, w * h, int(d.sum()), int(a.sum()), int((d * d).sum()), int((o * o).sum()), int(a.max()), *(int((a <= k).sum()) for k in range(3)), mean_ssim(o, r), (time.perf_counter() - start) * 1e3, None]
                rows.append(row)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return joined.mapInArrow(run, SUMS_SCHEMA)


_DERIVED = """squared_error / pixels AS mse, sqrt(squared_error / pixels) AS rmse, absolute_error / pixels AS mae, signed_error / pixels AS mean_error, max_absolute_error,
CASE WHEN squared_error = 0 THEN double('inf') ELSE 10 * log10(65025D * pixels / squared_error) END AS psnr_db,
CASE WHEN squared_error = 0 THEN double('inf') WHEN signal = 0 THEN double('-inf') ELSE 10 * log10(signal / squared_error) END AS snr_db,
mean_ssim_8x8, exact_pixels, 100D * exact_pixels / pixels AS exact_percent, 100D * within_1 / pixels AS within_1_percent, 100D * within_2 / pixels AS within_2_percent, metric_time_ms,
IF(error IS NULL, 'ok', 'error') AS status, error""".replace("\n", " ")


def derived(sums: DataFrame) -> DataFrame:
    """The 19 columns of a report from sums of SUMS_SCHEMA's columns."""
    return sums.selectExpr("image", "width", "height", "pixels", *[x for x in _split(_DERIVED)])


def _split(text: str) -> list[str]:
    """At commas outside brackets."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def report(sums: DataFrame) -> DataFrame:
    """The 19 columns: a row an image and one AGGREGATE row, whose figures come from pooled sums but for the similarity, a
    plain mean over images. Without any good image there is no such row."""
    pooled = sums.filter("error IS NULL").agg(
        *[F.sum(c).alias(c) for c in ("pixels", "signed_error", "absolute_error", "squared_error", "signal", "exact_pixels", "within_1", "within_2", "metric_time_ms")],
        F.max("max_absolute_error").alias("max_absolute_error"), F.avg("mean_ssim_8x8").alias("mean_ssim_8x8"),
    ).filter("pixels > 0").selectExpr("'AGGREGATE' AS image", "CAST(NULL AS BIGINT) AS width", "CAST(NULL AS BIGINT) AS height", "*", "CAST(NULL AS STRING) AS error")
    return derived(sums).unionByName(derived(pooled))


def finite_psnr(metrics: DataFrame) -> DataFrame:
    """One row for the images of a report, without its AGGREGATE: mean_finite_psnr_db (infinite where none is finite), and
    the images of the lowest and highest finite one, on a tie the first by name."""
    of_image = (F.col("status") == "ok") & (F.col("psnr_db") < float("inf"))
    low, high = F.min(F.when(of_image, F.struct("psnr_db", "image"))), F.min(F.when(of_image, F.struct((-F.col("psnr_db")).alias("psnr_db"), "image")))
    found = metrics.agg(F.coalesce(F.avg(F.when(of_image, F.col("psnr_db"))), F.lit(float("inf"))).alias("mean_finite_psnr_db"), low.alias("low"), high.alias("high"))
    return found.select("mean_finite_psnr_db", F.col("low.image").alias("lowest_image"), F.col("low.psnr_db").alias("lowest_psnr_db"), F.col("high.image").alias("highest_image"), (-F.col("high.psnr_db")).alias("highest_psnr_db"))


def comparison_summary(metrics: DataFrame) -> DataFrame:
    """One row for a report: images found, succeeded and failed, the exit code (1 if any failed), the pooled figures, and
    those of finite_psnr. Pooled figures are null if no image succeeded."""
    of_image = metrics.filter("image <> 'AGGREGATE' OR width IS NOT NULL OR error IS NOT NULL")
    ok = F.sum((F.col("status") == "ok").cast("long"))
    counts = of_image.agg(F.count("*").alias("images_found"), F.coalesce(ok, F.lit(0)).alias("succeeded")).withColumn("failed", F.col("images_found") - F.col("succeeded"))
    pooled = metrics.filter("image = 'AGGREGATE' AND width IS NULL AND error IS NULL").select("pixels", "mse", "rmse", "mae", "mean_error", "psnr_db", "mean_ssim_8x8", "exact_percent", "within_1_percent", "within_2_percent", "max_absolute_error")
    # Each side is one row.
    out = counts.withColumn("exit_code", (F.col("failed") > 0).cast("int")).join(F.broadcast(finite_psnr(of_image)))
    return out.join(F.broadcast(pooled), F.lit(True), "left")


def size_summary(sizes: DataFrame) -> DataFrame:
    """One row from (image, raw_bytes, compressed_bytes): images, totals, and the ratio of the totals, 0 without any bytes."""
    total = sizes.agg(F.count("*").alias("images"), F.sum("raw_bytes").alias("raw_bytes"), F.sum("compressed_bytes").alias("compressed_bytes"))
    return total.withColumn("compression_ratio", F.when(F.col("compressed_bytes") > 0, F.col("raw_bytes") / F.col("compressed_bytes")).otherwise(F.lit(0.0)))


def formatted(metrics: DataFrame) -> DataFrame:
    """As text for a file: ten digits, six for times, infinities spelled out; images by name and the AGGREGATE row last.
    Digits are rounded on the exact binary value, so the rounding is Python's and not the JVM's."""
    doubles = {f.name for f in metrics.schema.fields if f.dataType.simpleString() == "double"}

    def run(batches):
        for b in batches:
            out = []
            for name, column in zip(b.schema.names, b.columns):
                digits = 6 if name == "metric_time_ms" else 10
                out.append(pa.array([None if v is None else f"{v:.{digits}f}" for v in column.to_pylist()], pa.string()) if name in doubles else column.cast(pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=b.schema.names)

    text = metrics.mapInArrow(run, ", ".join(f"`{c}` string" for c in metrics.columns))
    return text.orderBy(F.col("width").isNull() & F.col("error").isNull(), "image")
