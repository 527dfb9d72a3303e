"""Statistics that are kept as states and merged: a day's reviews change the vehicles that they speak of, and nothing else is read.

A state is a row for each vehicle: how many reviews, and for each column how many values, their sum, and the sum of their squares about
a fixed centre. States add up, in any order; those of reviews that are taken back have negative signs. Points are counted likewise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autolot.sources import buckets
from autolot.sources.files import materialize

#: Values are squared about it, so that sums of squares of notes stay small.
CENTRE = 10.0


def state(reviews: DataFrame, keys: list[str], columns: list[str], sign: int = 1) -> DataFrame:
    """The state of reviews, or with the sign -1 of reviews that are taken back. Null values do not count."""
    def parts(c: str) -> list[Column]:
        x = F.col(c).cast("double")
        return [(F.count(x) * sign).alias(f"{c}_n"), (F.coalesce(F.sum(x - CENTRE), F.lit(0.0)) * sign).alias(f"{c}_s"), (F.coalesce(F.sum((x - CENTRE) * (x - CENTRE)), F.lit(0.0)) * sign).alias(f"{c}_q")]

    return reviews.groupBy(*keys).agg((F.count("*") * sign).alias("n"), *[p for c in columns for p in parts(c)])


def points(items: DataFrame, keys: list[str], point: str, sign: int = 1) -> DataFrame:
    """How often each point was made for each vehicle, or taken back."""
    return items.groupBy(*keys, point).agg((F.count("*") * sign).alias("n"))


def added(states: DataFrame, keys: list[str]) -> DataFrame:
    """The sum of states or counts of each key; what adds up to nothing is kept as zero, so that a merge can replace it."""
    return states.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in states.columns if c not in keys]).select(*states.columns)


def fold(delta: DataFrame, path: str, keys: list[str], version: int) -> None:
    """Add states or counts to a bucketed table (`sources.buckets`) as version `version`. Only buckets of keys in `delta` are read and written.

    A version that is written again starts from the one before it, so a batch that runs twice counts once.
    """
    spark = delta.sparkSession
    last, count, _ = buckets.manifest(spark, path, version)
    new = materialize(added(delta, keys), "delta")
    touched = {r[0] for r in new.select(buckets.bucket_of(keys, count)).distinct().collect()}  # at most the number of buckets
    old = buckets.read(spark, path, new.schema, last, touched) if last >= 0 else spark.createDataFrame([], new.schema)
    same = [old[k].eqNullSafe(new[k]) for k in keys]
    known = old.join(new.select(*keys), same, "left_semi")
    buckets.merge(materialize(added(known.unionByName(new), keys), "folded"), path, keys, version)


def statistics(states: DataFrame, keys: list[str], spread: list[str], criteria: list[str], digits: int = 6) -> DataFrame:
    """Reviews, means and deviations of states, as `stats.vehicle_stats` gives them for reviews; keys without reviews are gone."""
    def mean(c: str) -> Column:
        return F.round(CENTRE + F.try_divide(f"{c}_s", f"{c}_n"), digits).alias(c)

    def deviation(c: str) -> Column:
        n, s, q = (F.col(f"{c}_{x}") for x in "nsq")
        return F.round(F.sqrt(F.try_divide(F.greatest(q - s * s / n, F.lit(0.0)), F.nullif(n - 1, F.lit(0)))), digits).alias(f"{c}_sd")

    safe = states.where("n <> 0").withColumns({f"{c}_n": F.nullif(f"{c}_n", F.lit(0)) for c in dict.fromkeys([*spread, *criteria])})
    return safe.select(*keys, "n", *map(mean, [*spread, *criteria]), *map(deviation, spread))
