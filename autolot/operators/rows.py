"""Operators on rows of one table: keep-first, last write, caps, ranks, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key by `order`. Spark's limit on window groups cuts rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def different(df: DataFrame, *columns: str) -> DataFrame:
    """The different rows of some columns, dealt to as many tasks as shuffles have.

    After a distinct alone Spark joins partitions by their bytes, and few short texts end in one or two tasks, although what is
    done with each of them next (patterns, matches) takes far longer than reading it.
    """
    return dealt(df.select(*columns).distinct(), *columns)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows of `df`, dealt by keys to as many tasks as shuffles have; for small files whose rows take far longer to work on than to read."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def last_write(df: DataFrame, keys: list[str], stamp: list[str]) -> DataFrame:
    """The latest row of each key, reduced before the shuffle by an aggregate."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*stamp))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def cap(df: DataFrame, keys: list[str], order: list[Column | str], most: int) -> DataFrame:
    """At most `most` rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def segment_ranks(df: DataFrame, segment: str, score: str) -> DataFrame:
    """rank, dense_rank and percent_rank of each row in its segment, best first.

    Ranks are found on the different scores of a segment with their counts, and joined back; so a segment,
    however large, is never sorted by one task.
    """
    counts = df.groupBy(segment, score).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(segment).orderBy(F.col(score).desc_nulls_last())
    total = F.sum("_n").over(Window.partitionBy(segment))
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.select(F.col(segment).alias("_s"), F.col(score).alias("_v"), (before + 1).alias("rank"), F.dense_rank().over(w).alias("dense_rank"), F.when(total > 1, before / (total - 1)).otherwise(0.0).alias("percent_rank"))
    return df.join(ranks, F.col(segment).eqNullSafe(F.col("_s")) & F.col(score).eqNullSafe(F.col("_v"))).drop("_s", "_v")


def page(df: DataFrame, order: list[Column], skip: int, limit: int, most: int = 100) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(min(limit, most))


def page_after(df: DataFrame, score: str, ident: str, last: tuple[float, int], limit: int) -> DataFrame:
    """The page after the row (score, ident), best first: no deep skip, only a top-k."""
    s, i = last
    return df.where((F.col(score) < s) | ((F.col(score) == s) & (F.col(ident) > i))).orderBy(F.desc(score), ident).limit(limit)
