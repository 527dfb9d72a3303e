"""A directory of pages: a sorted table in ranges with their row counts, so that any page reads one range or two.

    path/rows/_range=12/part-….parquet    rows of a range of the sort keys, sorted
    path/counts/part-….parquet            a row for each range: how many rows it has, and how many stand before it
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows aimed at in one range.
RANGE_ROWS = 100_000


def write(df: DataFrame, path: str, order: list[Column], rows: int = RANGE_ROWS) -> None:
    """Sort a table once, in ranges of about `rows` rows. `order` decides between any two rows, as with an id at its end; ranges
    of equal sort keys are not cut. The table has no column _range; an empty one has no ranges."""
    size = df.count()
    count = max(1, -(-size // rows))
    ranged = df.repartitionByRange(count, *order).withColumn("_range", F.spark_partition_id()).sortWithinPartitions("_range", *order)
    ranged.write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")
    if not size:
        df.sparkSession.createDataFrame([], "_range int, n long, before long").write.mode("overwrite").parquet(f"{path}/counts")
        df.withColumn("_range", F.lit(0)).write.mode("overwrite").parquet(f"{path}/rows")  # files with the columns, as no folder of a range has them
        return
    counts = df.sparkSession.read.parquet(f"{path}/rows").groupBy(F.col("_range").cast("int").alias("_range")).agg(F.count("*").alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")


def total(spark: SparkSession, path: str) -> int:
    """How many rows there are, as the answer whether more pages follow asks for; read from the directory alone."""
    return spark.read.parquet(f"{path}/counts").agg(F.sum("n")).first()[0] or 0


def ranges(spark: SparkSession, path: str, skip: int, limit: int) -> list[tuple[int, int]]:
    """The ranges that hold rows `skip` to `skip + limit`, and how many rows stand before each."""
    rows = spark.read.parquet(f"{path}/counts").where((F.col("before") < skip + limit) & (F.col("before") + F.col("n") > skip))
    return sorted((r["_range"], r["before"]) for r in rows.collect())  # as many as the page touches


def page(spark: SparkSession, path: str, order: list[Column], skip: int, limit: int) -> DataFrame:
    """Rows `skip` to `skip + limit` in the order of the table; none beyond its end. Only the ranges that hold them are read."""
    found = ranges(spark, path, skip, limit)
    rows = spark.read.parquet(f"{path}/rows").where(F.col("_range").isin([r for r, _ in found]))
    return rows.orderBy(*order).offset(skip - found[0][1] if found else 0).limit(limit).drop("_range")
