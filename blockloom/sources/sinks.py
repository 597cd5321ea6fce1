"""File writers: bytes of a whole file for each image, made by expressions, and a sink that writes one file a row."""

from __future__ import annotations

import os
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions import tables
from ..operators.batches import SLOTS, Pairs


def _whole(blocks: DataFrame, columns: list[str], build, magic: bytes) -> DataFrame:
    """(image, content): header and blocks in order. The blocks of one image meet in one task, as one file holds them.
    The header has the image's size twice, as the format's writers do."""
    grouped = blocks.groupBy("image", "width", "height").agg(F.array_sort(F.collect_list(F.struct("block_id", *columns))).alias("b"))

    def run(batches):
        for b in batches:
            out = []
            for w, h, list_ in zip(b.column("width").to_pylist(), b.column("height").to_pylist(), b.column("b")):
                fields = [list_.values.field(c) for c in columns]
                body = build(*fields)
                out.append(magic + struct.pack("<5I64H", w, h, w, h, len(list_), *tables.QUANT) + body)
            yield pa.RecordBatch.from_arrays([b.column("image"), pa.array(out, pa.binary())], names=["image", "content"])

    return grouped.mapInArrow(run, "image string, content binary")


def _shorts(out: np.ndarray, at: np.ndarray, v: np.ndarray) -> None:
    out[at], out[at + 1] = v & 255, (v >> 8) & 255


def _first_format(dc, pairs) -> bytes:
    p = Pairs.of_arrow(pairs)
    if (p.count > SLOTS).any():
        raise ValueError("a block has over 63 pairs")
    n, block = len(dc), p.block
    out = np.zeros(3 * n + 3 * len(p.run), dtype=np.uint8)
    starts = 3 * np.arange(n) + 3 * p.offsets[:-1]
    _shorts(out, starts, dc.to_numpy(zero_copy_only=False).astype(np.int64))
    out[starts + 2] = p.count
    at = starts[block] + 3 + 3 * p.index
    out[at] = p.run
    _shorts(out, at + 1, p.value)
    return out.tobytes()


def _second_format(dc, bits, ac) -> bytes:
    heads = np.empty((len(dc), 2), dtype="<u2")
    heads[:, 0], heads[:, 1] = dc.to_numpy(zero_copy_only=False).astype(np.int64) & 65535, bits.to_numpy(zero_copy_only=False)
    data = ac.to_pylist()
    if any(len(d) != -(-int(n) // 8) for d, n in zip(data, heads[:, 1])):
        raise ValueError("a block's bytes don't fit its bits")
    return b"".join(x for head, d in zip(heads, data) for x in (head.tobytes(), d))


def gsc1_files(encoded: DataFrame) -> DataFrame:
    """From (image, width, height, block_id, dc, pairs): 152 bytes of header and 3 + 3 n bytes a block. A block of over 63
    pairs ends the query."""
    return _whole(encoded, ["dc", "pairs"], _first_format, b"GSC1")


def gsc2_files(packed: DataFrame) -> DataFrame:
    """From (image, width, height, block_id, dc, bit_count, ac): 4 bytes a block before its bits."""
    return _whole(packed, ["dc", "bit_count", "ac"], _second_format, b"GSC2")


def pgm_files(images: DataFrame) -> DataFrame:
    head = F.encode(F.format_string("P5\n%d %d\n255\n", "width", "height"), "UTF-8")
    return images.select("image", F.concat(head, "pixels").alias("content"))


@dataclass
class _Written(WriterCommitMessage):
    moved: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    """Each task writes under names of its own; the commit gives the files of the tasks that ended their final names."""

    def __init__(self, path: str):
        self.path = path

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), os.path.abspath(self.path))

    def write(self, iterator):
        system, top = self._fs()
        system.create_dir(top, recursive=True)
        moved = []
        for b in iterator:
            for name, content in zip(b.column("image").to_pylist(), b.column("content")):
                if "/" in name:
                    raise ValueError(f"not a file name: {name}")
                own = f"{top}/.{uuid.uuid4().hex}.part"
                with system.open_output_stream(own) as out:
                    out.write(content.as_buffer())
                moved.append((own, f"{top}/{name}"))
        return _Written(moved)

    def commit(self, messages):
        system, _ = self._fs()
        for own, final in (pair for m in messages if m for pair in m.moved):
            system.move(own, final)

    def abort(self, messages):
        system, _ = self._fs()
        for own, _ in (pair for m in messages if m for pair in m.moved):
            system.delete_file(own)


class OneFileARow(DataSource):
    @classmethod
    def name(cls):
        return "one_file_a_row"

    def schema(self):
        return "image string, content binary"

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


def write_files(spark: SparkSession, files: DataFrame, path: str) -> None:
    """Write (image, content) rows to a folder that all executors share, named by ``image``."""
    spark.dataSource.register(OneFileARow)
    files.select("image", "content").write.format("one_file_a_row").mode("append").save(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report as CSV with a header; quotes are doubled. Reports have one row an image, and keep their order in one file."""
    report.coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)
