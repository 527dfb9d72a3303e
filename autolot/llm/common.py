"""Helpers shared by the training-data operators: tables, scratch space, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

_LOCAL: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as `spark.checkpoint.dir` names it.

    Only a local master, whose executors are threads of this machine, may do without: it gets one temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(f"file://{tempfile.mkdtemp(prefix='spark-')}")
        atexit.register(shutil.rmtree, _LOCAL[0].removeprefix("file://"), ignore_errors=True)
    return _LOCAL[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` to the shared folder once and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: int = 1000):
    """Within it, what runs sends texts to Python in batches of at most `most` rows; the session keeps its setting.

    At Spark's default of 10,000 rows, a batch and what Arrow keeps of it take hundreds of MB in each worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    if 0 < int(old) <= most:
        yield
        return
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def keep_batches_small(spark: SparkSession, most: int = 1000) -> None:
    """From now on, whatever the session runs sends texts to Python in batches of at most `most` rows.

    Spark takes the size when a run starts, so rows that a caller writes need it after the function that made them has returned.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= most:
        spark.conf.set(key, str(most))


def slim(batches: Iterator[pa.RecordBatch], most: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `most` rows, so that what is made of their texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)
    pa.default_memory_pool().release_unused()


def quoted(name: str) -> str:
    """A column's name for use in a DDL string."""
    return "`" + name.replace("`", "``") + "`"


def ddl(df: DataFrame) -> str:
    """The schema of `df` as a DDL string, whatever its columns are called."""
    return ", ".join(f"{quoted(f.name)} {typed(f.dataType)}" for f in df.schema)


def typed(kind: DataType) -> str:
    """A type for use in a DDL string, with quoted names of fields."""
    if isinstance(kind, StructType):
        return "struct<" + ", ".join(f"{quoted(f.name)}: {typed(f.dataType)}" for f in kind) + ">"
    if isinstance(kind, ArrayType):
        return f"array<{typed(kind.elementType)}>"
    if isinstance(kind, MapType):
        return f"map<{typed(kind.keyType)}, {typed(kind.valueType)}>"
    return kind.simpleString()


def spread(*cols: Column | str, seed: int = 0) -> Column:
    """A uniform hash of the columns, as a fraction of [0, 1) with 52 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 12).cast("double") / F.lit(float(2**52))


def chunks(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array with at most `limit` bytes each, or one longer row."""
    sizes = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + limit, "right")) - 1)
        yield at, min(end, len(texts))
        at = end


def strings(column: pa.Array) -> pa.Array:
    """A string column without nulls; null becomes the empty text."""
    return column.cast(pa.string()).fill_null("") if column.null_count or column.type != pa.string() else column


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a null-free string array, and the offsets of its rows in them."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]
