"""What the text operators share: table access, checkpoints and partition counts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder named by spark.checkpoint.dir, which all executors share.

    Where the session names none, a folder of this machine is used if all runs on it; on a cluster
    that is an error, as other machines could not read it.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="voxelgate-checkpoint-"))
    return df.checkpoint(eager=True)


def clear_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles of steps that nothing refers to any more.

    Spark does so when the driver's heap is collected, which a small heap may not be for long,
    while the disks of the executors fill; so a collection is asked for after large steps.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(spark: SparkSession, total_bytes: int, per_task: int = 64 << 20) -> int:
    """So many partitions that none holds much more than per_task bytes in a Python worker."""
    return max(shuffle_partitions(spark), -(-int(total_bytes or 0) // per_task))


#: Bytes that a worker gets at once; one longer text still comes whole.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let batches for Python workers end by bytes too, so that long texts don't add up. A smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(name, None)
    if given is None or not given.isdigit() or int(given) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def slices(batch: pa.RecordBatch, texts: pa.Array, most_rows: int, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many rows and, but for single longer ones, bytes of texts."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        end = min(at + most_rows, max(at + 1, int(np.searchsorted(ends, before + most_bytes, "right"))))
        yield batch.slice(at, end - at)
        at = end


def crc_mod(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null ids count as the empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(modulus))


#: What worker processes keep from task to task, by kind of task.
_HELD: dict[str, object] = {}


def hold(kind: str, make: Callable[[], object]) -> object:
    """The worker's object of that kind, made once and kept until a task of another kind comes."""
    if kind not in _HELD:
        _HELD[kind] = make()
    return _HELD[kind]


def drop_others(kind: str) -> None:
    for other in [k for k in _HELD if k != kind]:
        del _HELD[other]


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kind: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work on a task's batches, after which its freed memory goes back: workers live on, and others share their machine.

    What tasks of another kind have left in the worker is dropped first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others(kind)
        try:
            yield from work(batches)
        finally:
            give_back()

    return run
