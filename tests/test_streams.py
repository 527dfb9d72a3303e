"""Continuous jobs: lifetimes of single listings, whatever the order of captures, and over a restart."""

from __future__ import annotations

import random
import tempfile

from pyspark.sql import functions as F

from autolot.streaming import streams

SCHEMA = "source string, external_id string, price double, seen struct<city: string, `odd name`: array<int>>, scraped_at timestamp"


def plain(captures, ttl=300):
    """Beginnings of lifetimes of captures (key, second), all of which are in time."""
    out, begun = [], {}
    for key, second in sorted(captures):
        if key not in begun or second > begun[key] + ttl:
            begun[key] = second
            out.append((key, second))
    return out


def land(spark, path, captures):
    rows = [("s", k, t / 2, (f"c{t}", [t]), t) for k, t in captures]
    df = spark.createDataFrame(rows, SCHEMA.replace("scraped_at timestamp", "t long")).withColumn("scraped_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t"))).drop("t")
    df.coalesce(1).write.mode("append").parquet(path)


def run(spark, path, out, files=1, delay="1 minute"):
    fresh = streams.fresh_listings(streams.read(spark, path, files), delay=delay)
    fresh.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(fresh.schema).parquet(out)
    assert got.schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()
    rows = got.withColumn("second", F.unix_seconds("scraped_at") - 1_700_000_000).collect()
    assert all(r.price == r.second / 2 and r.seen == (f"c{r.second}", [r.second]) for r in rows)
    return sorted((r.external_id, r.second) for r in rows)


def test_lifetimes_are_a_listings_own(spark):
    """Captured at 0, 3, 11, 20 and 23 minutes: fresh at 0, 11 and 20. Another listing of the stream has other lifetimes."""
    path, out = f"{tempfile.mkdtemp()}/in", f"{tempfile.mkdtemp()}/out"
    a, b = [("a", m * 60) for m in (0, 3, 11, 20, 23)], [("b", m * 60) for m in (2, 7, 8, 12)]
    for t in sorted({t for _, t in a + b}):
        land(spark, path, [x for x in a + b if x[1] == t])
    land(spark, path, [("z", 3000)])
    got = run(spark, path, out)
    assert got == plain(a + b)
    assert [t // 60 for k, t in got if k == "a"] == [0, 11, 20] and [t // 60 for k, t in got if k == "b"] == [2, 8]


def test_captures_out_of_order(spark):
    """Files that bring captures in any order within the delay give what sorted ones give; later ones are dropped."""
    rng = random.Random(5)
    captures = sorted({(f"k{rng.randrange(12)}", rng.randrange(0, 3600)) for _ in range(400)}, key=lambda x: x[1] + rng.uniform(0, 500))
    path, out = f"{tempfile.mkdtemp()}/in", f"{tempfile.mkdtemp()}/out"
    for at in range(0, len(captures), 50):
        land(spark, path, captures[at : at + 50])
    land(spark, path, [("end", 9000)])
    land(spark, path, [("k0", 100), ("late", 200)])  # far behind the watermark
    assert run(spark, path, out, delay="20 minutes") == plain(captures)


def test_restart_and_repeated_captures(spark):
    """A stream that is stopped and started again knows the lifetimes that were open; equal captures count once."""
    path, out = f"{tempfile.mkdtemp()}/in", f"{tempfile.mkdtemp()}/out"
    first, second = [("a", 0), ("a", 0), ("b", 100)], [("a", 299), ("a", 300), ("a", 301), ("b", 350), ("b", 401)]
    land(spark, path, first)
    land(spark, path, [("z", 200)])
    assert run(spark, path, out) == [("a", 0), ("b", 100)]
    land(spark, path, second)
    land(spark, path, [("y", 2000)])
    assert run(spark, path, out) == sorted([("a", 0), ("a", 301), ("b", 100), ("b", 401), ("z", 200)])
    land(spark, path, [("a", 2100), ("x", 4000)])
    assert ("a", 2100) in run(spark, path, out)


def test_keys_share_groups(spark):
    """Keys of one group keep lifetimes of their own, whatever the number of groups; and Python is called for groups, not for keys."""
    rng = random.Random(8)
    captures = sorted({(f"k{rng.randrange(300)}", rng.randrange(0, 1500)) for _ in range(1500)}, key=lambda x: x[1] + rng.uniform(0, 500))
    path = f"{tempfile.mkdtemp()}/in"
    for at in range(0, len(captures), 500):
        land(spark, path, captures[at : at + 500])
    land(spark, path, [("end", 9000)])
    for groups in (1, 7):
        out = f"{tempfile.mkdtemp()}/out"
        fresh = streams.fresh_listings(streams.read(spark, path), delay="20 minutes", groups=groups)
        query = fresh.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start()
        query.awaitTermination()
        got = sorted((r.external_id, r.second) for r in spark.read.schema(fresh.schema).parquet(out).withColumn("second", F.unix_seconds("scraped_at") - 1_700_000_000).collect())
        assert got == plain(captures)
        assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= groups
