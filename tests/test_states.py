"""Statistics from merged states against those of all reviews."""

from __future__ import annotations

import random
import tempfile

from pyspark.sql import functions as F

from autolot.operators import states, stats
from autolot.sources import buckets

SCHEMA = "id int, brand string, model string, note double, score double, km int"


def make(spark, n=900):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), f"m{rng.randrange(6)}", rng.choice([None, rng.uniform(0, 20)]), rng.uniform(0, 10), rng.choice([None, rng.randrange(300_000)])) for i in range(n)]
    rows += [(n, "once", "x", 3.0, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def close(got, want, keys):
    get = lambda df: {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}
    a, b = get(got), get(want)
    assert set(a) == set(b) and len(a) > 10
    for k, row in b.items():
        for c, v in row.items():
            if c != "rappels":
                assert a[k][c] == v if not isinstance(v, float) else abs(a[k][c] - v) <= 1e-9 * max(1, abs(v)), (k, c)


def test_merged_in_steps_equals_the_whole(spark):
    df, keys, columns = make(spark), ["brand", "model"], ["note", "score", "km"]
    path = f"{tempfile.mkdtemp()}/t"
    buckets.create(spark, path, 4)
    for version, part in enumerate((df.where("id < 200"), df.where("id between 200 and 700"), df.where("id > 700"))):
        states.fold(states.state(part, keys, columns), path, keys, version)
    schema = states.state(df, keys, columns).schema
    none = spark.createDataFrame([], "brand string, model string")
    whole = stats.vehicle_stats(df.where("brand is not null"), none, keys, ["note", "score"], ["km"], 12)
    close(states.statistics(buckets.read(spark, path, schema), keys, ["note", "score"], ["km"], 12).where("brand is not null"), whole, keys)
    # reviews are taken back: those of whole vehicles, and some of others; one batch runs twice
    gone = F.col("model").isin("m0", "m1") | (F.col("id") % 5 == 0)
    for _ in range(2):
        states.fold(states.state(df.where(gone), keys, columns, -1), path, keys, 3)
    left = stats.vehicle_stats(df.where(~gone & F.col("brand").isNotNull()), none, keys, ["note", "score"], ["km"], 12)
    got = states.statistics(buckets.read(spark, path, schema), keys, ["note", "score"], ["km"], 12).where("brand is not null")
    assert {tuple(r) for r in got.select(*keys, "n").collect()} == {tuple(r) for r in left.select(*keys, "n").collect()}
    a, b = ({(r.brand, r.model): (r.note, r.note_sd) for r in x.collect()} for x in (got, left))
    assert all(x == y or all(abs(p - q) < 1e-9 for p, q in zip(x, y, strict=True)) for x, y in ((a[k], b[k]) for k in b))
    assert buckets.read(spark, path, schema).where("brand is null and n <> 0").count() == df.where(~gone & F.col("brand").isNull()).select("model").distinct().count()


def test_points_are_counted_and_taken_back(spark):
    path = f"{tempfile.mkdtemp()}/t"
    buckets.create(spark, path, 4)
    items = spark.createDataFrame([("a", "quiet"), ("a", "quiet"), ("a", "fast"), ("b", "fast")], "brand string, point string")
    keys = ["brand", "point"]
    states.fold(states.points(items, ["brand"], "point"), path, keys, 0)
    states.fold(states.points(items.where("point = 'fast'"), ["brand"], "point", -1).unionByName(states.points(items.limit(0).union(spark.createDataFrame([("b", "big")], items.schema)), ["brand"], "point")), path, keys, 1)
    got = buckets.read(spark, path, states.points(items, ["brand"], "point").schema).where("n <> 0")
    assert sorted(map(tuple, got.collect())) == [("a", "quiet", 2), ("b", "big", 1)]
