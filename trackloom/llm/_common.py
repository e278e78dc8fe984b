"""Shared plumbing of the training-data operators.

Text kernels run in ``mapInArrow``: Arrow batches in, Arrow batches out, one
pass over each partition and nothing kept but bounded caches.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows of a batch that are held as Python objects at once.
SLICE_ROWS = 256
#: Rows of an Arrow batch.
BATCH_ROWS = 4096
#: Bytes of text that a vectorised kernel works on at once.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``; a folder of our
    own is set only where that is unset and all runs on this machine, as in tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = spark.sparkContext.getCheckpointDir() or f"file://{tempfile.mkdtemp(prefix='trackloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut
    and a lost executor loses nothing."""
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextlib.contextmanager
def bucketed(spark: SparkSession, df: DataFrame, key: str) -> Iterator[DataFrame]:
    """``df`` as a table that is dealt by a key, so that joins on the key move the other side only.
    Its files are in the shared folder; table and files are gone at the end of the ``with`` block, failures included."""
    name, parts = f"trackloom_{uuid.uuid4().hex}", shuffle_parts(spark)
    path = f"{shared_dir(spark)}/tables/{name}"
    try:
        df.repartition(parts, key).write.format("parquet").option("path", path).bucketBy(parts, key).sortBy(key).saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        delete(spark, table.stored_at)


def release(spark: SparkSession) -> None:
    """Free the disk of shuffles that ended jobs have left: Spark deletes the files of a shuffle only
    once the driver's collector has found that no plan holds it, which may be long after."""
    spark.range(1).collect()  # listeners hold the plan of the query whose end they saw last
    gc.collect()  # plans that Python holds
    spark._jvm.System.gc()


def text_rows(df: DataFrame) -> DataFrame:
    """The same table, once its session hands texts to Python in batches of a
    few megabytes: ten thousand long texts at once would fill an executor."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE_BYTES))
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def trim() -> None:
    """Give back to the system what earlier tasks of this worker have left behind."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, without copying."""
    trim()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_slices(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` bytes of text at most; one longer text stands alone."""
    trim()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(sizes, most + (sizes[at - 1] if at else 0), "right")))
            yield batch.slice(at, to - at)
            at = to


def texts_of(column: pa.Array) -> list[str]:
    """Strings of a column, null as the empty string."""
    return [x or "" for x in column.to_pylist()]


def utf8_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.Array]]:
    """Columns of sorted rows, cut so that no group of the first ``keys`` columns is split."""
    trim()
    kept: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if kept is not None:
            rows = pa.concat_tables([kept, rows])
        same = np.ones(rows.num_rows, bool)
        for k in range(keys):
            column = rows.column(k).to_numpy()
            same &= column == column[-1]
        cut = rows.num_rows - int(same.sum())
        if cut:
            yield [c.combine_chunks() for c in rows.slice(0, cut).columns]
        kept = rows.slice(cut)
    if kept is not None:
        yield [c.combine_chunks() for c in kept.columns]
