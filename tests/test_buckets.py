"""Merges into buckets: what is written goes with the batch, and a batch that runs twice changes nothing."""

from __future__ import annotations

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from autolot.sources import buckets
from autolot.streaming import streams

SCHEMA = "k string, bucket int, v double"


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_versions_equal_a_dictionary(spark):
    rng = random.Random(1)
    path = f"{tempfile.mkdtemp()}/t"
    buckets.create(spark, path, 8)
    state, states = {}, {}
    schema = spark.createDataFrame([], SCHEMA).schema
    assert buckets.read(spark, path, schema).count() == 0
    for version in range(4):
        batch = {rng.choice([None, *(f"k{i}" for i in range(60))]): (rng.randrange(9), rng.random()) for _ in range(25)} if version != 2 else {}
        new, old = sum(k not in state for k in batch), sum(k in state for k in batch)
        counts = buckets.merge(spark.createDataFrame([(k, *v) for k, v in batch.items()], SCHEMA), path, ["k"], version)
        assert dict(counts.collect()) == {k: n for k, n in (("inserted", new), ("updated", old)) if n}
        state = {**state, **batch}
        states[version] = sorted(repr((k, *v)) for k, v in state.items())
        assert rows_of(buckets.read(spark, path, schema)) == states[version]
    for version in range(4):  # old versions can be read
        assert rows_of(buckets.read(spark, path, schema, version)) == states[version]
    again = spark.createDataFrame([(k, *v) for k, v in batch.items()], SCHEMA)
    buckets.merge(again, path, ["k"], 3)  # the last batch once more
    assert rows_of(buckets.read(spark, path, schema)) == states[3]
    assert buckets.vacuum(spark, path, 3) > 0 and rows_of(buckets.read(spark, path, schema)) == states[3]
    with pytest.raises(ValueError):
        buckets.read(spark, path, schema, 1)


def test_a_small_batch_writes_few_rows(spark):
    path = f"{tempfile.mkdtemp()}/t"
    buckets.create(spark, path, 64)
    base = spark.range(64_000).select(F.col("id").alias("k"), F.lit(0).alias("v"))
    buckets.merge(base, path, ["k"], 0)
    assert buckets.written(spark, path, 0) == 64_000
    buckets.merge(spark.range(3).select(F.col("id").alias("k"), F.lit(1).alias("v")), path, ["k"], 1)
    assert buckets.written(spark, path, 1) < 3 * 1_300
    got = buckets.read(spark, path, base.schema)
    assert got.count() == 64_000 and got.where("v = 1").count() == 3


def test_queue_merges_batches_and_survives_a_restart(spark):
    top = tempfile.mkdtemp()
    land = lambda rows: spark.createDataFrame(rows, "review_id long, note double, ts long").coalesce(1).write.mode("append").parquet(f"{top}/in")
    land([(1, 5.0, 1), (2, None, 1), (2, 4.0, 2)])
    land([(3, None, 3), (1, None, 4)])
    run = lambda: streams.review_queue(streams.read(spark, f"{top}/in"), f"{top}/table", 4).awaitTermination()
    got = lambda: {r.review_id: (r.status, r.errors) for r in streams.reviewed(spark, f"{top}/table").collect()}
    run()
    assert got() == {1: ("failed", "no rating"), 2: ("processed", ""), 3: ("failed", "no rating")}
    land([(3, 7.0, 9), (4, 1.0, 9)])
    run()
    assert got() == {1: ("failed", "no rating"), 2: ("processed", ""), 3: ("processed", ""), 4: ("processed", "")}
    assert buckets.manifest(spark, f"{top}/table")[0] == 2
