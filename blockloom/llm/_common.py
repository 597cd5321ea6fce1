"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset one is made on a single machine only: elsewhere
    executors would write to their own disks, and what is read back would miss rows."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="blockloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage and keep each partition's rows and their order."""
    _folder(df.sparkSession)
    return df.checkpoint()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a table written to the checkpoint folder, which goes when the session ends.

    Unlike a checkpoint, it doesn't hand on the size estimates of its plan, which are multiplied with each join of an
    iteration; what is read again has the sizes of its files. Rows can come back in other partitions.
    """
    spark = df.sparkSession
    path = shared_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted with what is in it when the session ends."""
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def power_of_two(n: int, least: int = 2) -> int:
    """The largest power of two up to n, but at least ``least``."""
    return max(least, 1 << (max(1, n).bit_length() - 1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id"):
    """True for the fifth of the rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


_remembered: dict[str, dict] = {}


def remembered(owner: str) -> dict:
    """What a Python worker keeps from task to task, for one operator at a time: the memory of another goes first."""
    if owner not in _remembered:
        _remembered.clear()
        give_back()
        _remembered[owner] = {}
    return _remembered[owner]


def give_back() -> None:
    """Hand freed memory back to the system, where the C library can; else the process keeps it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


#: Rows that a text operator holds at once, beside the Arrow batch they come in.
SLICE = 512
#: Settings of how much a task holds at once: rows where it reads files and where it hands rows to Python, bytes of a column
#: group where it writes files, which a reader then holds.
BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": SLICE, "spark.sql.execution.arrow.maxRecordsPerBatch": SLICE, "parquet.block.size": 8 << 20}


def small_batches(spark: SparkSession) -> dict[str, str | None]:
    """Lower BATCHES for the session, where they are higher or unset, and return what they were.

    By default a reader holds 4,096 texts in one array and Arrow 10,000 in one buffer, for each task, and a writer 128 MB;
    the rows are the same in smaller batches.
    """
    before = {k: spark.conf.get(k, None) for k in BATCHES}
    for k, v in before.items():
        if not v or not 0 < int(v) <= BATCHES[k]:
            spark.conf.set(k, str(BATCHES[k]))
    return before


def put_back(spark: SparkSession, before: dict[str, str | None]) -> None:
    for k, v in before.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def tidy(run):
    """For mapInArrow: batches come in slices of SLICE rows, and freed memory goes back when the task ends, as the worker
    lives on."""

    def wrapped(batches):
        try:
            yield from run(b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE))
        finally:
            give_back()

    return wrapped


@functools.lru_cache(maxsize=1)
def tokenizer(path: str):
    """A tokenizer; a batch runs on the task's own core."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
