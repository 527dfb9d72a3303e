"""Sources and sinks: label CSV, nested JSON, recall and fuel dumps, keyed upsert, appends and reports."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_LOCAL: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder where all executors can write, in that of `spark.checkpoint.dir`; a temporary one only for a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(f"file://{tempfile.mkdtemp(prefix='spark-')}")
            atexit.register(shutil.rmtree, _LOCAL[0].removeprefix("file://"), ignore_errors=True)
        base = _LOCAL[0]
    return f"{base}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table that is read more than once, or whose expressions are long, and read it back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 32_000_000) -> DataFrame:
    """Broadcast `df` if its rows' bytes, counted whole, allow it. For columns of texts and numbers."""
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(16 * len(df.columns)))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most else df


def delimiter(spark: SparkSession, path: str) -> str:
    """`;` if the first line has more of them than commas, else a comma."""
    first = spark.read.text(path).limit(1).first()
    line = first[0] if first else ""
    return ";" if line.count(";") > line.count(",") else ","


def read_labels(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A label file with a header, all columns as text."""
    df = spark.read.csv(path, header=True, sep=delimiter(spark, path), encoding="UTF-8", inferSchema=False)
    return df if limit is None else df.limit(limit)


def count_objects(document: Column) -> Column:
    """How many objects a JSON document holds: a list's length, 1 for an object, 0 for anything else."""
    listed = F.json_array_length(document)
    single = F.get_json_object(document, "$").isNotNull() & F.ltrim(document).startswith("{")
    return F.when(listed.isNotNull(), listed).when(single, 1).otherwise(0)


def first_column(df: DataFrame, names: list[str], default: Column | None = None) -> Column:
    """The first of the names that `df` has; else the default, or an error where there is none."""
    for name in names:
        if name in df.columns:
            return F.col(f"`{name}`")
    if default is None:
        raise ValueError(f"none of {names} in {df.columns}")
    return default


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The next snapshot: incoming rows replace current ones of their key, or are added; `change` says which.

    Keys of `incoming` are unique (see `last_write`). A full outer join on the keys is one shuffle of both sides.
    """
    same = reduce(lambda a, b: a & b, [F.col(f"c.{k}").eqNullSafe(F.col(f"i.{k}")) for k in keys])
    both = current.withColumn("_c", F.lit(True)).alias("c").join(incoming.withColumn("_i", F.lit(True)).alias("i"), same, "full")
    take = [F.when(F.col("i._i"), F.col(f"i.{x}")).otherwise(F.col(f"c.{x}")).alias(x) for x in current.columns]
    change = F.when(F.col("i._i").isNull(), "kept").when(F.col("c._c"), "updated").otherwise("inserted")
    return both.select(*take, change.alias("change"))


def changes(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy("change").agg(F.count("*").alias("n"))


def append(df: DataFrame, path: str) -> int:
    """Append rows and return how many the table has then."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path).count()


def report(df: DataFrame, path: str, by: str, source: str, scraped_at: Column) -> DataFrame:
    """Write rows as JSON under `path`/rows, partitioned by `by`, and beside them, under `path`/summary, the envelope: scrape_date,
    source and total_reviews, with a row and its number for each value of `by`. Returns the summary as read again."""
    df.write.partitionBy(by).json(f"{path}/rows")
    counts = materialize(df.groupBy(by).agg(F.count("*").alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    envelope = counts.select(F.date_format(scraped_at, "yyyy-MM-dd'T'HH:mm:ss").alias("scrape_date"), F.lit(source).alias("source"), F.lit(total).cast("long").alias("total_reviews"), by, "n")
    envelope.write.json(f"{path}/summary")
    return df.sparkSession.read.schema(envelope.schema).json(f"{path}/summary")


def duplicates(df: DataFrame, keys: list[str], sparse: bool = False) -> DataFrame:
    """Keys that occur more than once; `sparse` passes over keys with nulls."""
    df = df.dropna("any", subset=keys) if sparse else df
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
