"""Columnar blocks in shuffles, and tables that cut lineage.

Operators that move many small fixed-width records (suffix positions, sketch bands)
pack them by bucket into binary columns, one row per map task and bucket, so that a
shuffle handles few large rows.  ``Scatter`` packs, ``gather`` unpacks.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

FLUSH_BYTES = 16 << 20
#: Bytes of an Arrow batch between the JVM and Python, which both hold several of.
ARROW_BYTES = 8 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session; bucket counts follow it, and so the cluster's sizing."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def lean(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, as rows say little of texts' sizes; a bound that the session sets stays."""
    if _ARROW not in spark.conf.getAll:
        spark.conf.set(_ARROW, str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, a temporary one in local mode only."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: later jobs neither repeat it nor depend on shuffle files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tessera_path = path
    return back


def drop(df: DataFrame) -> None:
    """Removes a table that ``cut`` wrote, once nothing reads it any more."""
    path = getattr(df, "_tessera_path", None)
    if path:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def plain(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` under the names c0, c1, ..., which clash with none that an operator adds, and these names by the old ones."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names))


def named(rows: DataFrame, df: DataFrame, **more: str) -> DataFrame:
    """The columns of ``df`` of rows made from ``plain(df)``, under their old names, and ``more`` (column by
    name); a name that ``df`` has itself gets underscores."""
    free = []
    for name in more:
        while name.lower() in {c.lower() for c in df.columns}:
            name += "_"
        free.append(name)
    return rows.select(*[f"c{i}" for i in range(len(df.columns))], *more.values()).toDF(*df.columns, *free)


class Scatter:
    """Buffers records and yields one row per bucket with a binary column per field."""

    def __init__(self, fields: dict[str, str], limit: int = FLUSH_BYTES):
        self.fields = {k: np.dtype(v) for k, v in fields.items()}
        self.limit = limit
        self._reset()

    def _reset(self) -> None:
        self.buckets: list[np.ndarray] = []
        self.parts: dict[str, list[np.ndarray]] = {k: [] for k in self.fields}
        self.bytes = 0

    def schema(self) -> str:
        return "bucket int, " + ", ".join(f"{k} binary" for k in self.fields)

    def add(self, bucket: np.ndarray, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(bucket):
            self.buckets.append(bucket.astype(np.int32, copy=False))
            self.bytes += self.buckets[-1].nbytes
            for k, dtype in self.fields.items():
                x = np.ascontiguousarray(columns[k], dtype=dtype)
                self.parts[k].append(x)
                self.bytes += x.nbytes
        if self.bytes > self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.buckets:
            bucket = np.concatenate(self.buckets)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            bounds = np.r_[first, len(bucket)]
            columns = [pa.array(bucket[first])]
            for k in self.fields:
                x = np.concatenate(self.parts[k])[order]
                offsets = (bounds * x.dtype.itemsize).astype(np.int32)
                columns.append(pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))]))
            self._reset()
            batch = pa.RecordBatch.from_arrays(columns, names=["bucket", *self.fields])
            for i in range(0, batch.num_rows, 256):
                yield batch.slice(i, 256)


def blob(column: pa.Array, dtype: str) -> np.ndarray:
    """The records of all rows of a binary column, one after another."""
    if isinstance(column, pa.ChunkedArray):
        return np.concatenate([blob(c, dtype) for c in column.chunks] or [np.zeros(0, dtype)])
    if len(column) == 0:
        return np.zeros(0, dtype)
    _, off, data = column.buffers()
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(off, dtype=wide)[column.offset : column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype)
    return np.frombuffer(bytes(memoryview(data)[int(offsets[0]) : int(offsets[-1])]), dtype=dtype)


def gather(batches: Iterable[pa.RecordBatch], fields: dict[str, str], also_source: bool = False) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(bucket, records) of each bucket of a partition, in the order of the buckets."""
    parts: dict[int, list[pa.RecordBatch]] = {}
    for batch in batches:
        key = batch.column("bucket").to_numpy()
        order = np.argsort(key, kind="stable")
        if len(key) and (np.diff(key) < 0).any():
            batch, key = batch.take(pa.array(order)), key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else []
        for a, b in zip(first, np.r_[first[1:], len(key)].astype(int) if len(key) else []):
            parts.setdefault(int(key[a]), []).append(batch.slice(int(a), int(b - a)))
    for bucket in sorted(parts):
        rows = parts.pop(bucket)
        yield bucket, {k: np.concatenate([blob(r.column(k), v) for r in rows]) for k, v in fields.items()}


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of equal values of a sorted array."""
    if len(keys) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return start, np.diff(np.r_[start, len(keys)])
