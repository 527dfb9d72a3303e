"""Sharding by jump consistent hashing (Lamping and Veach), with DataFrame functions only.

A row's key and the number of shards decide its shard: a row jumps to ever higher shard numbers, and
stays where the next jump would leave the range. With one more shard, a row stays or moves into the
new shard. The pseudo-random draws of the published method come from a linear generator; here they
come from MD5 of the key and the jump's number, which DataFrame functions and plain SQL both have.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from autolot.llm.common import materialize, table
from autolot.llm.graphs import maybe_broadcast

#: Rows aimed at in one numbering range.
RANGE_ROWS = 20_000


def draw(key: Column, number: Column | int) -> Column:
    """The 32-bit draw of a key for a jump; a null key is the key `null`."""
    text = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), F.lit(number) if isinstance(number, int) else number.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def jump(key: Column, shards: int) -> Column:
    """The shard, from 0 to shards - 1, of a key.

    A row needs about ln(shards) jumps. Twenty and ten standard deviations more than that are folded; rows that have not
    arrived by then, hardly any, go on for as many as `shards` jumps, which always suffice.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    start = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("next"))

    def step(state: Column, number: Column) -> Column:
        further = F.floor((state["next"] + 1) * F.lit(4294967296.0) / (draw(key, number) + 1))
        return F.when(state["next"] < shards, F.struct(state["next"].alias("b"), further.alias("next"))).otherwise(state)

    most = min(shards, 20 + math.ceil(math.log(shards) + 10 * math.sqrt(math.log(shards))))
    done = F.aggregate(F.sequence(F.lit(0), F.lit(most - 1)), start, step)
    if most == shards:
        return done["b"].cast("int")
    # only rows still on their way get numbers of further jumps
    numbers = F.when(done["next"] < shards, F.sequence(F.lit(most), F.lit(shards - 1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(numbers, done, step, lambda s: s["b"].cast("int"))


def rank(key: Column, *also: Column) -> Column:
    """60 bits of MD5 of a key and of what tells its rows apart."""
    text = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), *[c.cast("string") for c in also])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def number_within(df: DataFrame, group: str, order: list[str], rank: str, ranges: int, out: str, most: int = RANGE_ROWS) -> DataFrame:
    """Number each group's rows from 0 without gaps, by `rank` (a 60-bit hash), then `order`. `df` is a written table.

    Ranges of `rank` are numbered apart, and a range starts after the rows of those before it. A rank that over `most` rows of a
    group have, as equal rows do, is a range of its own and is cut further by the rows' numbers in the table; so
    no group or rank, however large, is sorted in one task. Only a row for each range is gathered.
    """
    df = df.withColumns({"_range": F.floor(F.col(rank) / F.lit(float(1 << 60)) * ranges).cast("int"), "_row": F.monotonically_increasing_id()})
    hot = df.groupBy(group, "_range", rank).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    hot = hot.groupBy(group, "_range").agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), F.ceil(F.col("_n") / most).cast("int").alias("parts")))).alias("_hot"))
    df = df.join(maybe_broadcast(materialize(hot, "hot")), [group, "_range"], "left")
    below = F.when(F.col("_hot").isNotNull(), F.size(F.filter("_hot", lambda x: x["rank"] < F.col(rank)))).otherwise(0)
    parts = F.try_element_at(F.filter("_hot", lambda x: x["rank"] == F.col(rank)), F.lit(1))["parts"]
    cut = F.when(parts.isNotNull(), 2 * below + 1).otherwise(2 * below)
    df = df.withColumns({"_cut": cut, "_part": F.coalesce(F.pmod(F.xxhash64("_row"), parts).cast("int"), F.lit(0))}).drop("_hot")
    keys = ["_range", "_cut", "_part"]
    counts = df.groupBy(group, *keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, *keys).orderBy(rank, *order)
    numbered = df.withColumn("_k", F.row_number().over(inside) - 1)
    return numbered.join(starts, [group, *keys]).withColumn(out, F.col("_start") + F.col("_k")).drop(*keys, "_row", "_k", "_n", "_start")


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put all rows into `shards` shards by the law `key`.

    Returns key, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard, slot (from 0, gapless in
    a shard) and grown_shard (with one more shard). Slots follow a hash of key and text_crc32, so the rows of one key lie
    apart in their shard. A null text is empty: size 1, crc32 0. A null key is a key like another. Repeated rows go to one shard and
    get slots of their own, in parts if they are many. Other columns are ignored; an empty table gives an empty result.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    crc = F.crc32(body.cast("binary"))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        crc.alias("text_crc32"),
        rank(F.col(key), crc).alias("_rank"),
        jump(F.col(key), shards).alias("shard"),
        jump(F.col(key), shards + 1).alias("grown_shard"),
    )
    rows = materialize(rows, "shards")
    ranges = max(1, rows.count() // (shards * RANGE_ROWS) + 1)
    ranges = max(ranges, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")) // shards + 1)
    slots = number_within(rows, "shard", ["doc_id", "text_crc32", "size"], "_rank", ranges, "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE table_bits(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM table_bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM table_bits WHERE k = 8),
d AS (SELECT coalesce(doc_id::VARCHAR, 'null') AS key, doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT key, doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM d),
z AS (SELECT key, doc_id, len(bytes)::BIGINT + 1 AS size, xor(list_reduce(bytes, lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32 FROM b, crc),
j AS (SELECT *, ('0x' || substr(md5(key || ':' || text_crc32), 1, 15))::BIGINT AS rank,
  list_reduce(range(0, 9), lambda s, n: CASE WHEN s.next < 8 THEN {'b': s.next, 'next': floor((s.next + 1) * 4294967296.0::DOUBLE / (('0x' || substr(md5(key || ':' || n), 1, 8))::BIGINT + 1))::BIGINT} ELSE s END, {'b': 0::BIGINT, 'next': 0::BIGINT}).b AS shard,
  list_reduce(range(0, 9), lambda s, n: CASE WHEN s.next < 9 THEN {'b': s.next, 'next': floor((s.next + 1) * 4294967296.0::DOUBLE / (('0x' || substr(md5(key || ':' || n), 1, 8))::BIGINT + 1))::BIGINT} ELSE s END, {'b': 0::BIGINT, 'next': 0::BIGINT}).b AS grown FROM z)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY rank, doc_id, text_crc32, size) - 1 AS slot, grown::INT AS grown_shard FROM j
"""
