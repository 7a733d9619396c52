"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


#: Folders of the tables written in this process, in order.
_written: list[str] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def released(spark: SparkSession):
    """Delete the tables written inside, once what depends on them has been written itself; all but those in the list it gives."""
    before, kept = len(_written), []
    yield kept
    for path in _written[before:]:
        if path not in kept:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written[before:] = kept


def last_written() -> str:
    """The folder of the table that ``written`` gave last."""
    return _written[-1]


def small_side(df: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """``df``, best a written table, to be broadcast in a join if it takes less than ``broadcast_bytes`` as text."""
    size = F.octet_length(F.to_json(F.struct(*df.columns))) + 48
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) < broadcast_bytes else df


def packed(**columns) -> bytes:
    """Columns of equal length as one zstd-compressed Arrow message."""
    batch = pa.record_batch({k: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for k, v in columns.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def taken(lengths: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups laid end to end with these lengths: the element indices of the picked groups, and the picked lengths."""
    starts = np.cumsum(lengths) - lengths
    n = lengths[picks]
    total = int(n.sum())
    index = np.repeat(starts[picks] - (np.cumsum(n) - n), n) + np.arange(total)
    return index, n


def chunks(batches, size_of, limit: int):
    """Join Arrow record batches, whole rows each, into tables of about ``limit`` units as ``size_of(batch)`` counts them per row."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        sizes = np.cumsum(size_of(batch))
        start = 0
        while start < batch.num_rows:
            before = int(sizes[start - 1]) if start else 0
            end = int(np.searchsorted(sizes, before + limit - total, side="left")) + 1
            end = min(max(end, start + 1), batch.num_rows)
            held.append(batch.slice(start, end - start))
            total += int(sizes[end - 1]) - before
            start = end
            if total >= limit:
                yield pa.Table.from_batches(held)
                held, total = [], 0
    if held:
        yield pa.Table.from_batches(held)


def quiet_threads() -> None:
    """One thread for each Python worker: Spark deals out the cores."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ.setdefault(name, "1")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
