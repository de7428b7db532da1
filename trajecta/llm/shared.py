"""Helpers that several operators of this subpackage use.

Working tables go to the folder that the cluster names in ``spark.checkpoint.dir``, which driver and executors
share. Where that setting is missing, a local master gets a folder of its own (tests on one machine) and any other
raises. The application's working tables are deleted when the driver's process ends, or earlier with ``delete``.

Ids are whole numbers (byte to long). Bytes of a text that aren't UTF-8 are read as U+FFFD, except where an
operator works on bytes.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The application's folder for working tables, below ``spark.checkpoint.dir``."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/trajecta-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_delete_at_end, spark, folder)
    return folder


_folders: set[str] = set()


def _delete_at_end(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before
        delete(spark, [folder])


_made = threading.local()


@contextlib.contextmanager
def collected() -> Iterator[list[str]]:
    """Lists the working tables that this thread makes meanwhile, so that they can be deleted when their readers are done."""
    outer, _made.tables = getattr(_made, "tables", None), []
    try:
        yield _made.tables
    finally:
        if outer is not None:
            outer.extend(_made.tables)
        _made.tables = outer


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns a scan of it: lineage ends there, so a lost executor
    costs a re-read and nothing is computed twice when several branches use the table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (tables := getattr(_made, "tables", None)) is not None:
        tables.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now; else they stay until the driver happens to collect its garbage."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def delete(spark: SparkSession, tables: list[str]) -> None:
    """Deletes working tables; results read from them must have been written before."""
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def valid_text(text_col: str) -> Column:
    """The text, null as empty, bytes that aren't UTF-8 as U+FFFD."""
    return F.make_valid_utf8(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def long_id(df: DataFrame, id_col: str) -> Column:
    """The id as a long; ids of other kinds than whole numbers raise here and not in a task."""
    kind = df.select(F.col(id_col)).schema[0].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{id_col} must be a whole number, not {kind.simpleString()}")
    return F.col(id_col).cast("long")


def texts(df: DataFrame, id_col: str, text_col: str, **more: Column) -> DataFrame:
    """The id as ``doc_id`` and the text as ``text`` (null: empty), so that no other column can clash."""
    return df.select(F.col(id_col).alias("doc_id"), valid_text(text_col).alias("text"), *(c.alias(name) for name, c in more.items()))


def crc_of_id(id_col: str = "doc_id") -> F.Column:
    """crc32 of the id's decimal text, as the fold rules use it."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def release_memory() -> None:
    """Gives freed memory back to the system, as an idle Python worker stays beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow whose tasks release their memory at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        release_memory()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each piece's strings, bytes or lists in ``column`` hold about ``most`` units;
    a single larger row makes a piece of its own."""
    import numpy as np
    import pyarrow.compute as pc

    col = batch.column(batch.schema.get_field_index(column))
    size = pc.list_value_length(col) if pa.types.is_list(col.type) or pa.types.is_large_list(col.type) else pc.binary_length(col)
    ends = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, done = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(start, stop - start)
        start, done = stop, int(ends[stop - 1])


#: Bytes of a stored input for which a shuffle gets a partition.
PARTITION_BYTES = 64_000_000


def partitions_for(df: DataFrame) -> int:
    """How many partitions a shuffle of about all of ``df`` needs: as the session says, or more for larger inputs."""
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(own, size // PARTITION_BYTES) if size < 2**60 else own  # larger: unknown


def dealt(df: DataFrame, partitions: int, *columns: str) -> DataFrame:
    """``df`` by key; a number that isn't the session's own is given, which adaptive execution then keeps."""
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *columns) if partitions > own else df.repartition(*columns)
