"""Tables in the folder that all executors share, which outlive the executors that made them."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.errors import StoreError

#: Bytes of an Arrow batch between the JVM and Python, both of which hold several.
ARROW_BYTES = 2 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"
try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _TRIM = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, a temporary one in local mode only."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise StoreError("spark.checkpoint.dir must name a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def written(rows: DataFrame) -> DataFrame:
    """``rows`` written once to the shared folder and read from there."""
    path = f"{shared_folder(rows.sparkSession)}/rows-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def release() -> None:
    """Gives freed memory back, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def lean(rows: DataFrame, task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task`` of a map over partitions of ``rows``, which gets batches bounded by bytes, as rows say little of
    texts' sizes; a bound that the session sets stays.  Once it ends, what it needed goes back to the machine."""
    spark = rows.sparkSession
    if _ARROW not in spark.conf.getAll:
        spark.conf.set(_ARROW, str(ARROW_BYTES))

    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        release()

    return run
