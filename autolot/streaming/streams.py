"""Continuous jobs: fresh listings, fuel prices by window, the review queue."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from autolot.functions import refdata as R
from autolot.operators.rows import last_write
from autolot.sources import buckets
from autolot.sources.files import scratch


def read(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """New Parquet files of a folder, some at a time."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is, into Parquet, and read that."""
    spark = df.sparkSession
    out = scratch(spark, name)
    run = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def _packed(*columns: list) -> bytes:
    """Columns of equal length as one compressed value."""
    batch = pa.record_batch([pa.array(c) for c in columns], [f"c{i}" for i in range(len(columns))])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpacked(value: bytes) -> list[list]:
    return [c.to_pylist() for c in pa.ipc.open_stream(bytes(value)).read_all().columns]


def fresh_listings(captures: DataFrame, ttl: int = 300, delay: str = "0 seconds", keys: tuple[str, ...] = ("source", "external_id"), at: str = "scraped_at", groups: int = 1024) -> DataFrame:
    """The captures that begin a lifetime: the first of each key, and each first one after a lifetime of `ttl` seconds has passed.

    A key's lifetime is counted from its own beginning, whatever other keys do. Captures wait until the watermark (`delay` behind the latest
    capture) has passed them, and are then taken in the order of their times; so the result does not depend on the order in which they came.
    Those that come later than the watermark are dropped. What is known of a key goes when its lifetime is over and nothing waits. A capture at
    the very end of a lifetime still belongs to it; of captures at one time the first by its columns counts. Times and keys that are null are left out.

    Keys are dealt by their hash to `groups` groups, as a state of its own costs a key milliseconds in each batch that meets it. A group's state
    holds its open lifetimes and the captures that wait, compressed, and wakes by the earliest of their times. More keys ask for more groups;
    a stream keeps its number as long as its checkpoint.
    """
    rest = [c for c in captures.columns if c not in keys and c != at]
    known = captures.where(" and ".join(f"`{c}` is not null" for c in (*keys, at)))
    as_json = lambda names: F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    rows = known.withWatermark(at, delay).select(F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int").alias("_group"), at, as_json(keys).alias("_key"), F.unix_micros(at).alias("_at"), as_json(rest).alias("_rest"))
    span = ttl * 1_000_000

    def wake(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        begun, waiting = {}, []
        if state.exists:
            lives, waits = map(_unpacked, state.get)
            begun, waiting = dict(zip(*lives, strict=True)), list(zip(*waits, strict=True))
        if not state.hasTimedOut:
            for frame in frames:
                waiting += zip(frame["_key"].tolist(), frame["_at"].tolist(), frame["_rest"].tolist(), strict=True)
        mark = state.getCurrentWatermarkMs() * 1000
        fresh = []
        for key, time, row in sorted(w for w in waiting if w[1] <= mark):
            if key not in begun or time > begun[key] + span:
                begun[key] = time
                fresh.append((key, time, row))
        waiting = [w for w in waiting if w[1] > mark]
        begun = {k: t for k, t in begun.items() if t + span >= mark}
        if not waiting and not begun:
            state.remove()
        else:
            state.update((_packed(list(begun), list(begun.values())), _packed(*([w[i] for w in waiting] for i in range(3)))))
            # A timer wakes its group once the watermark lies beyond it; it has to be set beyond the present one.
            first = min(w[1] for w in waiting) if waiting else min(begun.values()) + span + 1
            state.setTimeoutTimestamp(max(-(-first // 1000) - 1, mark // 1000 + 1))
        if fresh:
            yield pd.DataFrame(dict(zip(("_key", "_at", "_rest"), map(list, zip(*fresh, strict=True)), strict=True)))

    begun = rows.groupBy("_group").applyInPandasWithState(wake, "_key string, _at long, _rest string", "begun binary, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)
    parsed = lambda c, names: F.from_json(c, StructType([captures.schema[n] for n in names])) if names else F.lit(None)
    told = begun.select(parsed("_key", keys).alias("_k"), F.timestamp_micros("_at").alias(at), parsed("_rest", rest).alias("_r"))
    return told.select(*[F.col(at) if c == at else F.col(f"_k.`{c}`" if c in keys else f"_r.`{c}`").alias(c) for c in captures.columns])


def fuel_windows(feed: DataFrame, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Mean, least and highest price of each fuel in tumbling windows; late rows are dropped by the watermark."""
    names = F.create_map([F.lit(x) for fuel, ns in R.STATION_NAMES.items() for n in ns for x in (n, fuel)])
    known = feed.select(F.col("ts").cast("timestamp").alias("ts"), names[F.col("name")].alias("fuel"), (F.col("raw").try_cast("double") / 1000).alias("p")).where("fuel is not null and p is not null")
    out = known.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "fuel").agg(F.round(F.round(F.avg("p"), 9), 3).alias("mean"), F.min("p").alias("least"), F.max("p").alias("most"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "fuel", "mean", "least", "most", "n")


def review_queue(pending: DataFrame, table: str, count: int = 64) -> StreamingQuery:
    """Each batch of pending reviews is processed or failed, and merged into the bucketed table `table` (see `sources.buckets`) as the
    version of the batch's number; so a batch writes the buckets that it touches, and one that runs twice after a failure gives the same table.

    Of several rows of a review in a batch the last by `ts` counts (without one, or at ties, the last by status).
    """
    def step(batch: DataFrame, number: int) -> None:
        failed = F.col("note").isNull()
        latest = last_write(batch, ["review_id"], ["ts"]) if "ts" in batch.columns else batch.dropDuplicates()
        done = latest.select("review_id", F.when(failed, "failed").otherwise("processed").alias("status"), F.when(failed, "no rating").otherwise("").alias("errors"))
        if number == 0:
            buckets.create(batch.sparkSession, table, count)
        buckets.merge(last_write(done, ["review_id"], ["status", "errors"]), table, ["review_id"], number)

    return pending.writeStream.foreachBatch(step).option("checkpointLocation", f"{table}-log").trigger(availableNow=True).start()


def reviewed(spark: SparkSession, table: str, key: str = "bigint") -> DataFrame:
    """The queue's table as its last batch left it."""
    return buckets.read(spark, table, StructType.fromDDL(f"review_id {key}, status string, errors string"))
