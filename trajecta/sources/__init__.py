"""Scans, sinks and caches of session tables."""

from __future__ import annotations

import hashlib
import json
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.schema import ingest


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the cluster names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/trajecta-{spark.sparkContext.applicationId}"


def read_sessions(spark: SparkSession, path: str, split: str | None = None, id_col: str = "id") -> DataFrame:
    """A Parquet session table, normalised."""
    return ingest(spark.read.parquet(path), id_col, split=split)


def row_count(spark: SparkSession, path: str) -> int:
    """From the footers where the source can answer so."""
    return spark.read.parquet(path).count()


def write_submission(predictions: DataFrame, path: str, value_col: str = "probability", id_col: str = "id", files: int | None = None, append: bool = False) -> None:
    """CSV with a header: id and one value column, in ``files`` files (None: as many as partitions). With ``append`` to those that
    are there, such as earlier batches; every file has the header."""
    rows = predictions.select(F.col(id_col), F.col(value_col))
    (rows.coalesce(files) if files else rows).write.mode("append" if append else "overwrite").option("header", True).csv(path)


def read_batches(df: DataFrame, rows: int, id_col: str = "id") -> Iterator[DataFrame]:
    """The table in batches of ``rows`` consecutive ids."""
    first, last = df.agg(F.min(id_col), F.max(id_col)).first()
    for start in range(first, last + 1, rows) if first is not None else ():
        yield df.where((F.col(id_col) >= start) & (F.col(id_col) < start + rows))


def read_submission(spark: SparkSession, path: str, value_col: str = "probability", id_col: str = "id") -> DataFrame:
    return spark.read.option("header", True).schema(f"{id_col} long, {value_col} double").csv(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    """One value a line."""
    df.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """Tensors and trajectories are array columns of Parquet."""
    df.write.mode("overwrite").parquet(path)


def cached(df: DataFrame, folder: str, parameters: dict, inputs: str = "") -> DataFrame:
    """``df`` from a Parquet cache whose name is a digest of the schema, the parameters and the input's version
    (for files their paths, sizes and times, else the plan's hash), so a stale cache is never read."""
    spark = df.sparkSession
    sizes = []
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        sizes.append([name, status.getLen(), status.getModificationTime()])
    sizes = sizes or [df.semanticHash()]
    key = hashlib.sha256(json.dumps([df.schema.json(), parameters, inputs, sizes], sort_keys=True, default=str).encode()).hexdigest()[:32]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{key}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        df.write.mode("overwrite").parquet(f"{folder}/{key}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{key}")
