"""Image and codec files, read by Spark's own binary reader, so from any file system it knows.

A file is one task's work, as blocks have no fixed length. A file that can't be read is one row with ``error`` set.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.batches import PAIR, ROOM, Pairs

IMAGE_SCHEMA = "image string, width bigint, height bigint, pixels binary, error string"
ENCODED_SCHEMA = "image string, width bigint, height bigint, padded_width bigint, padded_height bigint, qmatrix array<int>, block_id bigint, dc int, pairs array<struct<zero_run: int, value: int>>, error string"
PACKED_SCHEMA = "image string, width bigint, height bigint, padded_width bigint, padded_height bigint, qmatrix array<int>, block_id bigint, dc int, bit_count int, ac binary, error string"
#: Blocks in a batch that is handed on.
BATCH_BLOCKS = 8192
#: Images in a batch that is handed on.
BATCH_FILES = 16

# Never goes back over what it read, so a header of any make takes linear time.
_TOKEN = re.compile(rb"(?:\s++|#[^\n]*+\n)*+([^\s#]++)")
_HEAD = struct.Struct("<5I64H")


def parse_pgm(data: bytes, strict: bool = True) -> tuple[int, int, bytes]:
    """(width, height, raster). Strict: P5, greatest value 255, whole raster. Otherwise magic and greatest value are read
    but not looked at, and a short raster is filled with zeros."""
    at, tokens = 0, []
    for _ in range(4):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("header ends early")
        tokens.append(m.group(1))
        at = m.end()
    if strict and tokens[0] != b"P5":
        raise ValueError("not a P5 file")
    if not all(t.isdigit() and int(t) < 1 << 32 for t in tokens[1:]):
        raise ValueError("header holds no whole number where one is due")
    width, height, most = map(int, tokens[1:])
    if not width or not height:
        raise ValueError("width or height is zero")
    if strict and most != 255:
        raise ValueError("greatest value is not 255")
    if not data[at : at + 1].isspace():
        raise ValueError("no white space after the header")
    at += 2 if data[at : at + 2] == b"\r\n" else 1
    raster = data[at : at + width * height]
    if len(raster) < width * height:
        if strict:
            raise ValueError("raster ends early")
        raster += bytes(width * height - len(raster))
    return width, height, raster


@dataclass
class Blocks:
    """Blocks of a file: dc of each, and pairs in the first format, bits and their bytes in the second."""

    dc: np.ndarray
    pairs: Pairs | None = None
    bits: np.ndarray | None = None
    data: list[bytes] | None = None


def parse_gsc(data: bytes) -> tuple[dict, Blocks]:
    """The header and the blocks of a file. What follows the last block is not looked at."""
    magic = data[:4]
    if magic not in (b"GSC1", b"GSC2"):
        raise ValueError("unknown magic")
    if len(data) < 4 + _HEAD.size:
        raise ValueError("header ends early")
    width, height, wide, high, count, *q = _HEAD.unpack_from(data, 4)
    if not width or not height:
        raise ValueError("width or height is zero")
    if wide < width or high < height or wide % 8 or high % 8:
        raise ValueError("padded size does not fit")
    if count != (wide // 8) * (high // 8):
        raise ValueError("block count does not fit the size")
    if not all(q):
        raise ValueError("a quantisation step is zero")
    start = 4 + _HEAD.size
    if start + 3 * count > len(data):
        raise ValueError("blocks end early")
    head = {"magic": magic, "width": width, "height": height, "padded_width": wide, "padded_height": high, "qmatrix": list(q)}
    raw = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    low, high_byte = (lambda at: raw[at]), (lambda at: raw[at + 1] << 8)
    signed = lambda at: (low(at) | high_byte(at)) - ((low(at + 1) & 128) << 9)
    starts, n, at = np.empty(count, dtype=np.int64), len(data), start
    if magic == b"GSC1":
        for i in range(count):
            if at + 3 > n:
                raise ValueError("blocks end early")
            starts[i] = at
            at += 3 + 3 * data[at + 2]
        if at > n:
            raise ValueError("blocks end early")
        counts = raw[starts + 2]
        if (counts > 63).any():
            raise ValueError("a block has over 63 pairs")
        offsets = np.r_[0, np.cumsum(counts)]
        place = np.repeat(starts + 3 - 3 * offsets[:-1], counts) + 3 * np.arange(offsets[-1])
        pairs = Pairs(offsets, raw[place], signed(place + 1))
        if not pairs.fits.all():
            raise ValueError("a run leaves its block")
        return head, Blocks(signed(starts), pairs)
    for i in range(count):
        if at + 4 > n:
            raise ValueError("blocks end early")
        starts[i] = at
        size = (data[at + 2] + 256 * data[at + 3] + 7) // 8
        at += 4 + size
        if size > ROOM or at > n:
            raise ValueError("a block's bits end early")
    bits = raw[starts + 2] | raw[starts + 3] << 8
    ends = starts + 4 + (bits + 7) // 8
    return head, Blocks(signed(starts), None, bits, [data[a:b] for a, b in zip((starts + 4).tolist(), ends.tolist())])


def _files(spark: SparkSession, path: str, suffix: str | None, any_case: bool, stream: bool) -> DataFrame:
    """(image, content). Not recursive. Streams need the schema stated."""
    if stream:
        reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    else:
        reader = spark.read.format("binaryFile")
    name = F.element_at(F.split("path", "/"), -1)
    files = reader.load(path)
    if suffix:
        files = files.filter((F.lower(name) if any_case else name).endswith(suffix))
    return files.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("image"), "content")


def read_pgm(spark: SparkSession, path: str, strict: bool = True, suffix: str | None = ".pgm", any_case: bool = True, stream: bool = False, size: tuple[int, int] | None = None) -> DataFrame:
    """One row a file: IMAGE_SCHEMA. ``suffix=None`` takes every file of the folder; ``size`` allows one size only."""
    return parse_images(_files(spark, path, suffix, any_case, stream), strict, size)


def parse_images(files: DataFrame, strict: bool = True, size: tuple[int, int] | None = None) -> DataFrame:
    """(image, content) rows to IMAGE_SCHEMA. Null contents and bad ones are rows with an error."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]

    def parsed(data):
        try:
            if not data.is_valid:
                raise ValueError("no content")
            width, height, raster = parse_pgm(data.as_buffer().to_pybytes(), strict)
            if size and (width, height) != tuple(size):
                raise ValueError(f"not {size[0]} by {size[1]} pixels")
            return width, height, raster, None
        except ValueError as e:
            return None, None, None, str(e)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, BATCH_FILES):
                part = b.slice(at, BATCH_FILES)
                rows = [parsed(x) for x in part.column("content")]
                yield pa.RecordBatch.from_arrays([part.column("image"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds[1:]))], names=["image", "width", "height", "pixels", "error"])

    return files.select("image", "content").mapInArrow(run, IMAGE_SCHEMA)


def read_gsc(spark: SparkSession, path: str, version: int = 1, stream: bool = False) -> DataFrame:
    """One row a block: ENCODED_SCHEMA for version 1, PACKED_SCHEMA for version 2. A file is checked whole before any of
    its blocks is handed on; one of the other version is an error row."""
    return parse_codec_files(_files(spark, path, ".gsc", True, stream), version)


def parse_codec_files(files: DataFrame, version: int = 1) -> DataFrame:
    """(image, content) rows to those of read_gsc."""
    tail = [pa.list_(PAIR)] if version == 1 else [pa.int32(), pa.binary()]
    types = [pa.string(), *[pa.int64()] * 4, pa.list_(pa.int32()), pa.int64(), pa.int32(), *tail, pa.string()]
    names = ["image", "width", "height", "padded_width", "padded_height", "qmatrix", "block_id", "dc", *(["pairs"] if version == 1 else ["bit_count", "ac"]), "error"]

    def run(batches):
        for b in batches:
            for name, data in zip(b.column("image").to_pylist(), b.column("content")):
                try:
                    if not data.is_valid:
                        raise ValueError("no content")
                    head, blocks = parse_gsc(data.as_buffer().to_pybytes())
                    if head["magic"] != b"GSC%d" % version:
                        raise ValueError("a file of the other version")
                except ValueError as e:
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([name, *[None] * (len(types) - 2), str(e)], types)], names=names)
                    continue
                n = len(blocks.dc)
                fixed = [pa.array([v], k) for v, k in zip([name, *(head[c] for c in names[1:6])], types)]
                what = [blocks.pairs.arrow()] if version == 1 else [pa.array(blocks.bits.astype(np.int32)), pa.array(blocks.data, pa.binary())]
                for at in range(0, n, BATCH_BLOCKS):
                    k = min(BATCH_BLOCKS, n - at)
                    same = pa.array(np.zeros(k, dtype=np.int64))
                    own = [pa.array(np.arange(at, at + k)), pa.array(blocks.dc[at : at + k].astype(np.int32)), *(w.slice(at, k) for w in what)]
                    yield pa.RecordBatch.from_arrays([*(f.take(same) for f in fixed), *own, pa.nulls(k, pa.string())], names=names)

    return files.select("image", "content").mapInArrow(run, ENCODED_SCHEMA if version == 1 else PACKED_SCHEMA)
