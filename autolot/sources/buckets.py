"""Keyed tables in buckets: a merge rewrites the buckets that it touches, and a manifest for each version says where each bucket stands.

    path/data/version=7/_bucket=12/part-….parquet    the rows of bucket 12 as version 7 left them
    path/manifest/version=7/part-….parquet           a row for each bucket: the version that holds its rows

A version that is written again, as after a failure, starts from the version before it and gives the same table. Old versions stay
readable until `vacuum`. The manifest is written last, so a version is there as a whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from autolot.sources.files import materialize, upsert

MANIFEST = "bucket int, held long, version long"
#: The manifest's row that holds the number of buckets instead of a version.
COUNT = -1


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def create(spark: SparkSession, path: str, buckets: int = 64) -> None:
    """An empty table: version -1."""
    spark.createDataFrame([(COUNT, buckets)], "bucket int, held long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version=-1")


def manifest(spark: SparkSession, path: str, before: int | None = None) -> tuple[int, int, dict[int, int]]:
    """The last version (of those below `before`), the number of buckets, and for each bucket with rows the version that holds them."""
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    rows = rows if before is None else rows.where(F.col("version") < before)
    last = rows.agg(F.max("version")).first()[0]
    if last is None:
        raise ValueError(f"no table in {path}" + (f" before version {before}" if before is not None else ""))
    held = {r["bucket"]: r["held"] for r in rows.where(F.col("version") == last).collect()}  # a row for each bucket
    return last, held.pop(COUNT), held


def read(spark: SparkSession, path: str, schema: StructType, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
    """The rows of the last version, or of one that is asked for, or of some of its buckets."""
    _, _, held = manifest(spark, path, None if version is None else version + 1)
    paths = [f"{path}/data/version={v}/_bucket={b}" for b, v in sorted(held.items()) if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge(incoming: DataFrame, path: str, keys: list[str], version: int) -> DataFrame:
    """Write version `version`: incoming rows replace those of their key, or are added. Returns how many were updated and inserted.

    Keys of `incoming` are unique (see `rows.last_write`). Only buckets with incoming keys are read and written. Columns are those of `incoming`, and
    are the same in all versions; none is called _bucket. Null keys are keys like others. Versions are numbers that grow; an empty merge only writes a manifest.
    """
    spark = incoming.sparkSession
    last, count, held = manifest(spark, path, version)
    rows = materialize(incoming.withColumn("_bucket", bucket_of(keys, count)), "incoming")
    touched = {r[0] for r in rows.select("_bucket").distinct().collect()}  # at most the number of buckets
    old = read(spark, path, incoming.schema, last, touched) if last >= 0 else spark.createDataFrame([], incoming.schema)
    merged = materialize(upsert(old, rows.drop("_bucket"), keys), "merged")
    if touched:
        whole = merged.drop("change").withColumn("_bucket", bucket_of(keys, count))
        whole.repartition(min(count, len(touched)), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/data/version={version}")
    now = {**held, **dict.fromkeys(touched, version)}
    spark.createDataFrame([(COUNT, count), *sorted(now.items())], "bucket int, held long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")
    return merged.where("change <> 'kept'").groupBy("change").agg(F.count("*").alias("n"))


def written(spark: SparkSession, path: str, version: int) -> int:
    """How many rows a version wrote, for reports: those of the buckets that it touched."""
    _, _, held = manifest(spark, path, version + 1)
    paths = [f"{path}/data/version={v}/_bucket={b}" for b, v in held.items() if v == version]
    return spark.read.parquet(*paths).count() if paths else 0


def vacuum(spark: SparkSession, path: str, keep: int) -> int:
    """Delete versions below `keep`, but for buckets that `keep` or a later version still reads. Returns how many folders went."""
    manifests = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").where(F.col("version") >= keep)
    used = {(r["held"], r["bucket"]) for r in manifests.select("held", "bucket").distinct().collect()}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    store, gone = folder(path).getFileSystem(conf), 0
    for status in store.globStatus(folder(f"{path}/data/version=*/_bucket=*")) or []:
        at = status.getPath()
        held, bucket = int(at.getParent().getName().split("=")[1]), int(at.getName().split("=")[1])
        if held < keep and (held, bucket) not in used:
            gone += store.delete(at, True)
    for status in store.globStatus(folder(f"{path}/manifest/version=*")) or []:
        if int(status.getPath().getName().split("=")[1]) < keep:
            store.delete(status.getPath(), True)
    return gone
