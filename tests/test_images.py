"""Files, whole images, the report and streams."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.functions import tables
from blockloom.operators import images, profile
from blockloom.plans import catalog, programs
from blockloom.sources import sinks
from blockloom.sources.images import parse_gsc, parse_pgm, read_gsc, read_pgm
from blockloom.streaming import ingest

HEAD = struct.pack("<5I64H", 8, 8, 8, 8, 1, *tables.QUANT)


def raster(w, h, seed=1):
    y, x = np.mgrid[0:h, 0:w]
    return np.clip(128 + 90 * np.sin(x / 5) * np.cos(y / 7) + np.random.default_rng(seed).normal(0, 6, (h, w)), 0, 255).astype(np.uint8)


@pytest.fixture
def folder(tmp_path):
    top = tmp_path / "in"
    top.mkdir()
    for name, w, h in (("a.pgm", 24, 16), ("b c+d.PGM", 16, 40)):
        (top / name).write_bytes(b"P5\n%d %d\n255\n" % (w, h) + raster(w, h).tobytes())
    (top / "bad.pgm").write_bytes(b"P5\n8 8\n255\n123")
    (top / "note.txt").write_bytes(b"no image")
    return top


def test_pgm_headers():
    px = bytes([32, *range(63)])
    assert parse_pgm(b"P5 # c\n# more\n8\t8\r\n255\r\n" + px) == (8, 8, px)
    for data in (b"P2\n8 8\n255\n" + px, b"P5\n0 8\n255\n" + px, b"P5\n8 8\n254\n" + px, b"P5\n8 8\n255\n" + px[1:], b"P5\n8x 8\n255\n" + px, b"P5\n8 8", b"", b"P5\n8 8\n255"):
        with pytest.raises(ValueError):
            parse_pgm(data)
    assert parse_pgm(b"P2\n8 8\n254\n" + px[:5], strict=False) == (8, 8, px[:5] + bytes(59))


def test_gsc_rejections():
    good = b"GSC1" + HEAD + struct.pack("<hB", 3, 1) + struct.pack("<Bh", 62, -5)
    head, blocks = parse_gsc(good + b"more")
    assert (blocks.dc.tolist(), blocks.pairs.run.tolist(), blocks.pairs.value.tolist()) == ([3], [62], [-5]) and head["qmatrix"] == tables.QUANT
    bad = [b"GSC9" + good[4:], good[:100], good[:-1], good[:153], b"GSC1" + HEAD + struct.pack("<hB", 0, 64) + bytes(192), b"GSC1" + HEAD + struct.pack("<hB", 0, 1) + struct.pack("<Bh", 63, 1)]
    bad += [b"GSC1" + struct.pack("<5I64H", *size, *tables.QUANT) + good[152:] for size in ((0, 8, 8, 8, 1), (8, 8, 12, 8, 1), (16, 8, 8, 8, 1), (8, 8, 8, 8, 2))]
    bad.append(b"GSC1" + struct.pack("<5I64H", 8, 8, 8, 8, 1, 0, *tables.QUANT[1:]) + good[152:])
    for data in bad:
        with pytest.raises(ValueError):
            parse_gsc(data)


@pytest.mark.parametrize("arithmetic", ["cpu", "stream", "fourk"])
def test_files_round_trip(spark, folder, tmp_path, arithmetic):
    originals = read_pgm(spark, str(folder))
    got = {r.image: r for r in originals.collect()}
    assert sorted(got) == ["a.pgm", "b c+d.PGM", "bad.pgm"] and got["bad.pgm"].error and got["a.pgm"].pixels == raster(24, 16).tobytes()
    scan, version = ("zigzag", 2) if arithmetic == "fourk" else ("rank", 1)
    encoded = images.encode(images.tile(originals), arithmetic, scan)
    named = encoded.selectExpr("regexp_replace(image, '[.][^.]*$', '_stream.gsc') AS image", "* EXCEPT (image)")
    out = str(tmp_path / "gsc")
    files = sinks.gsc1_files(named) if version == 1 else sinks.gsc2_files(images.pack(named))
    sinks.write_files(spark, files, out)
    read = read_gsc(spark, out, version)
    key = lambda df: {(r.image, r.block_id): (r.dc, [tuple(p) for p in r.pairs]) for r in df.select("image", "block_id", "dc", "pairs").collect()}
    back = read if version == 1 else images.unpack(read)
    want = key(named)
    assert key(back) == want and len(want) == 6 + 10
    pairs = sum(len(p) for (n, _), (_, p) in want.items() if n == "a_stream.gsc")
    if version == 1:
        assert len((tmp_path / "gsc" / "a_stream.gsc").read_bytes()) == 152 + 3 * 6 + 3 * pairs
    rec = images.assemble(images.decode(back, scan)).selectExpr("replace(image, '.gsc', '.pgm') AS image", "width", "height", "pixels")
    sinks.write_files(spark, sinks.pgm_files(rec), str(tmp_path / "pgm"))
    sums = images.compare(originals, read_pgm(spark, str(tmp_path / "pgm")))
    rows = {r.image: r for r in images.report(sums).collect()}
    assert rows["bad.pgm"].status == "error" and rows["bad.pgm"].mse is None
    assert rows["a.pgm"].psnr_db > 28 and rows["a.pgm"].mean_ssim_8x8 > 0.85
    mse = (rows["a.pgm"].mse * 384 + rows["b c+d.PGM"].mse * 640) / 1024
    assert rows["AGGREGATE"].pixels == 1024 and abs(rows["AGGREGATE"].mse - mse) < 1e-9 and len(rows["AGGREGATE"]) == 19


def test_report_cases(spark, tmp_path):
    schema = "image string, width bigint, height bigint, pixels binary"
    a, dark = raster(12, 10).tobytes(), bytes(120)
    left = spark.createDataFrame([('x,"1".pgm', 12, 10, a), ("dark.pgm", 12, 10, dark), ("gone.pgm", 12, 10, a), ("odd.pgm", 12, 10, a)], schema)
    right = spark.createDataFrame([('x,"1"_stream.pgm', 12, 10, a), ("dark_stream.pgm", 12, 10, bytes([1]) * 120), ("odd_stream.pgm", 10, 12, a)], schema)
    metrics = images.report(images.compare(left, right))
    rows = {r.image: r for r in metrics.collect()}
    same = rows['x,"1".pgm']
    assert (same.mse, same.psnr_db, same.snr_db, same.exact_percent) == (0, float("inf"), float("inf"), 100) and abs(same.mean_ssim_8x8 - 1) < 1e-12
    assert rows["dark.pgm"].snr_db == float("-inf") and rows["dark.pgm"].within_1_percent == 100
    assert rows["gone.pgm"].error == "no reconstruction" and rows["odd.pgm"].error == "sizes differ"
    sinks.write_report(images.formatted(metrics), str(tmp_path / "csv"))
    lines = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert lines[0].startswith("image,width,height,pixels,mse") and lines[-1].startswith("AGGREGATE,,,240,0.5")
    assert any(x.startswith('"x,""1"".pgm",12,10,120,0.0000000000') and ",inf,inf," in x for x in lines) and "gone.pgm" + "," * 17 + "error,no reconstruction" in lines


def test_stream_equals_batch(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    ingest.start(ingest.encoded_stream(spark, str(folder)), out, str(tmp_path / "cp")).awaitTermination()
    batch = images.encode(images.tile(read_pgm(spark, str(folder))))
    assert sorted(map(str, spark.read.parquet(out).collect())) == sorted(map(str, batch.collect()))


def test_profiles(spark):
    times = spark.createDataFrame([("a", "dct", 0, 9.0), ("a", "dct", 1, 2.0), ("a", "dct", 2, 4.0)], "image string, stage string, run int, ms double")
    s = profile.sample_stats(times).first()
    assert (s.runs, s.avg_ms, s.min_ms, s.max_ms) == (2, 3, 2, 4)
    totals = spark.createDataFrame([("a", 10.0, 5, 320), ("b", 10.0, 5, 320)], "image string, ms double, blocks int, pixels int")
    rows = {r.stage: r for r in profile.stage_profile(times, totals).collect()}
    assert rows["other"].total_ms == 5 and rows["dct"].percent == 75 and rows["dct"].us_per_block == 1500
    assert profile.throughput(totals).first().images_per_s == 100


@pytest.mark.parametrize("arithmetic, scan", [("cpu", "rank"), ("stream", "rank"), ("fourk", "zigzag")])
def test_batches_equal_expressions(spark, arithmetic, scan):
    noise = np.random.default_rng(3).integers(0, 256, (64, 64)).astype(np.uint8)
    noise[:8, :8], noise[:8, 8:16], noise[:8, 16:24] = 0, 255, 128
    df = spark.createDataFrame([("n", 64, 64, noise.tobytes()), ("s", 72, 40, raster(72, 40).tobytes())], "image string, width bigint, height bigint, pixels binary")
    blocks = images.tile(df).cache()
    a, b = (sorted(map(str, f(blocks, arithmetic, scan).collect())) for f in (images.encode, images.encode_sql))
    assert a == b and len(a) == 64 + 45


def test_documents_are_encoded_to_their_last_byte(spark, tmp_path):
    texts = [None, "", "a", "é" * 40, "b" * 511, "c" * 512, "d" * 513, "e" * 1500]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = [catalog.document_pairs(a, "rank")(spark, str(tmp_path)).collect() for a in ("cpu", "stream")]
    for rows in got:
        count = {i: sum(r.doc_id == i for r in rows) for i in range(len(texts))}
        assert count == {i: 8 * -(-len((t or "").encode()) // 512) for i, t in enumerate(texts)}
    px = [b"".join(r.pixels for r in catalog._rasters(spark, str(tmp_path)).filter(f"image = '{i}'").collect()) for i in range(2, len(texts))]
    assert all(p.rstrip(b"\0") == t.encode() and len(p) % 512 == 0 for p, t in zip(px, texts[2:]))


def pairs_frame(spark, blocks):
    """blocks: (dc, [(zero_run, value)])."""
    rows = [("i", 8, 8, k, dc, pairs) for k, (dc, pairs) in enumerate(blocks)]
    return spark.createDataFrame(rows, "image string, width bigint, height bigint, block_id bigint, dc int, pairs array<struct<zero_run: int, value: int>>")


def bits_one_by_one(pairs):
    """The bits of a block, written out; None after a value that has no code."""
    out, last = "", 0
    for run, value in pairs:
        out += "11110000" * min(3, run // 16)
        size = abs(value).bit_length()
        if not 0 < size <= 15:
            return out, 1
        low = value if value >= 0 else value + (1 << size) - 1
        out += f"{run % 16:04b}{size:04b}{low:0{size}b}"
        last += run + 1
    return out + ("00000000" if last < 63 else ""), 0


def test_bits_against_writing_them_out(spark):
    r = np.random.default_rng(6)
    blocks = [(0, []), (-5, [(62, -1)]), (7, [(0, 32767)] * 63), (1, [(17, -32767), (40, 2)]), (2, [(3, 5), (1, -32768), (0, 4)]), (3, [(0, 0)])]
    for _ in range(60):
        scanned = np.where(r.random(64) < r.random(), r.integers(-400, 400, 64), 0)
        at = np.flatnonzero(scanned[1:]) + 1
        blocks.append((int(scanned[0]), [(int(k - p - 1), int(scanned[k])) for p, k in zip([0, *at], at)]))
    packed = images.pack(pairs_frame(spark, blocks)).orderBy("block_id").collect()
    for row, (_, pairs) in zip(packed, blocks):
        bits, status = bits_one_by_one(pairs)
        assert (row.bit_count, row.status) == (len(bits), status)
        assert "".join(f"{x:08b}" for x in row.ac) == bits.ljust(-(-len(bits) // 8) * 8, "0")
    good = images.unpack(images.pack(pairs_frame(spark, blocks)).filter("status = 0")).collect()
    assert all([tuple(p) for p in g.pairs] == blocks[g.block_id][1] for g in good) and len(good) == len(blocks) - 2
    status = images.image_status(images.pack(pairs_frame(spark, blocks))).first()
    assert status.status == 1 and status.bytes == 152 + sum(4 + len(p.ac) for p in packed)
    assert images.without_faults(images.pack(pairs_frame(spark, blocks))).count() == 0


def test_pairs_that_leave_their_block(spark):
    blocks = [(1, [(63, 1)]), (2, [(0, 1)] * 64), (3, [(60, 1), (5, 1)]), (4, [(2, 9)])]
    frame = pairs_frame(spark, blocks).withColumn("padded_width", F.lit(8).cast("long")).withColumn("qmatrix", F.array(*map(F.lit, tables.QUANT)))
    assert [r.status for r in images.pack(frame).orderBy("block_id").collect()] == [4, 4, 4, 0]
    assert [r.rec is None for r in images.decode(frame).orderBy("block_id").collect()] == [True, True, True, False]
    with pytest.raises(Exception, match="63 pairs"):
        images.pair_total(frame).collect()
    with pytest.raises(Exception, match="63 pairs"):
        sinks.gsc1_files(frame).collect()
    cut = spark.createDataFrame([("i", 8, 8, 0, 0, 12, bytes([0x0F, 0xF0]))], "image string, width bigint, height bigint, block_id bigint, dc int, bit_count int, ac binary")
    assert images.unpack(cut).first().pairs is None


def test_sizes_of_images_that_are_no_multiples_of_8(spark):
    df = spark.createDataFrame([("a", 12, 10, raster(12, 10).tobytes())], "image string, width bigint, height bigint, pixels binary")
    sizes = [struct.unpack_from("<5I", sinks.gsc1_files(images.encode(images.tile(df, t))).first().content, 4) for t in (False, True)]
    assert sizes == [(12, 10, 12, 10, 1), (8, 8, 8, 8, 1)]


def test_a_header_of_blanks_takes_no_time():
    import time

    for bad in (b"P5" + b" " * 1_000_000, b"P5" + b"#\n" * 300_000, b"P5 " + b"# \t" * 300_000):
        start = time.perf_counter()
        with pytest.raises(ValueError):
            parse_pgm(bad)
        assert time.perf_counter() - start < 1


def test_one_size_only(spark, folder):
    rows = {r.image: r.error for r in read_pgm(spark, str(folder), size=(24, 16)).collect()}
    assert rows["a.pgm"] is None and "24 by 16" in rows["b c+d.PGM"]


def test_programs(spark, folder, tmp_path):
    gsc, pgm, csv = (str(tmp_path / x) for x in ("gsc", "pgm", "csv"))
    made = {r.image: r for r in programs.compress(spark, str(folder), gsc, suffix="_stream.gsc").collect()}
    assert made["bad.pgm"].status == "error" and made["a.pgm"].raw_bytes == 384 and made["a.pgm"].compressed_bytes == (tmp_path / "gsc" / "a_stream.gsc").stat().st_size
    back = {r.image: r for r in programs.decompress(spark, gsc, pgm).collect()}
    assert back["a_stream.gsc"].reconstructed_bytes == (tmp_path / "pgm" / "a_stream.pgm").stat().st_size
    done = programs.compare(spark, str(folder), pgm, csv).first()
    assert (done.images_found, done.succeeded, done.failed, done.exit_code) == (2, 1, 1, 1) and done.lowest_image == done.highest_image == "a.pgm" and done.pixels == 384
    assert len(next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()) == 4
    four = {r.image: r.status for r in programs.compress(spark, str(folder), str(tmp_path / "four"), "fourk", "_four_kernel.gsc").collect()}
    assert four["a.pgm"] == "ok" and (tmp_path / "four" / "a_four_kernel.gsc").read_bytes()[:4] == b"GSC2"


def test_empty_and_missing_folders(spark, tmp_path):
    (tmp_path / "none").mkdir()
    empty, missing = str(tmp_path / "none"), str(tmp_path / "gone")
    for path in (empty, missing):
        with pytest.raises(FileNotFoundError):
            programs.compress(spark, path, str(tmp_path / "out"))
        with pytest.raises(FileNotFoundError):
            programs.compare(spark, path, empty, str(tmp_path / "csv"))
    with pytest.raises(FileNotFoundError):
        programs.decompress(spark, missing, str(tmp_path / "out"))
    assert programs.decompress(spark, empty, str(tmp_path / "out")).count() == 0


def test_summary_without_a_finite_ratio(spark):
    schema = "image string, width bigint, height bigint, pixels binary"
    a = raster(8, 8).tobytes()
    one = images.report(images.compare(spark.createDataFrame([("a.pgm", 8, 8, a)], schema), spark.createDataFrame([("a_stream.pgm", 8, 8, a)], schema)))
    s = images.comparison_summary(one).first()
    assert (s.mean_finite_psnr_db, s.lowest_image, s.exit_code, s.succeeded) == (float("inf"), None, 0, 1)
    none = images.comparison_summary(images.report(images.compare(spark.createDataFrame([("a.pgm", 8, 8, a)], schema), spark.createDataFrame([], schema)))).first()
    assert (none.failed, none.exit_code, none.pixels) == (1, 1, None)


def test_profiles_without_timed_runs(spark):
    runs = spark.createDataFrame([("a", "dct", 0, 9.0)], "image string, stage string, run int, ms double")
    with pytest.raises(ValueError):
        profile.sample_stats(runs)
    sizes = spark.createDataFrame([("a", 64, 0, 0)], "image string, raw_bytes long, compressed_bytes long, status int")
    wide, narrow = profile.hardware_profile(runs, sizes), profile.stream_profile(runs, sizes)
    assert len(wide.columns) == 28 and len(narrow.columns) == 16 and wide.first().compression_ratio == 0 and narrow.first().kernel_mpix_per_s == 0
