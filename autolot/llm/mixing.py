"""Mixing of sources to target weights by Poisson replication.

A source with share w of the target gets a mean repetition rate w * rows / own rows. Each document's
number of copies is a Poisson draw with that mean, inverted from a hash of its key; so it depends neither
on the partitions nor on other draws. Copies are then dealt out by a hash and sorted by it, which is a
global shuffle in one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from autolot.llm.common import materialize, quoted, table

SEED = 7
#: Without weights, a source's share of the target goes with this power of its rows.
POWER = 0.5
#: Means above this are drawn as sums of Poisson draws of equal means at most so large.
STEP = 64.0
#: Up to so many sources, their rates are broadcast.
MANY_SOURCES = 50_000


def uniform(*parts: Column) -> Column:
    """A draw of 52 bits between 0 and 1 from the MD5 of the parts, never either."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def place(*parts: Column) -> Column:
    """A number of 60 bits from the MD5 of the parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def poisson(rate: Column, most: Column, u: Column) -> Column:
    """The smallest k whose distribution function exceeds u; `most` bounds k."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).cast("long").alias("k"))

    def step(s: Column, j: Column) -> Column:
        p = s["p"] * rate / j
        return F.when(s["cdf"] > u, s).otherwise(F.struct(p.alias("p"), (s["cdf"] + p).alias("cdf"), (s["k"] + 1).alias("k")))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["k"])


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = POWER) -> DataFrame:
    """Rows, target weight and mean repetition rate of each source. Null is a source of its own.

    With `weights`, sources that are not named have weight 0. Without, the weight is the rows' `power`.
    """
    rows = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        rows = rows.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        named = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        rows = rows.alias("r").join(named.alias("w"), F.expr("r.source <=> w.source"), "left").select("r.source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    rows = materialize(rows, "sources")
    top = rows.agg(F.max("weight")).first()[0] or 1.0
    share = F.col("weight") / F.lit(top)  # weights are scaled before they are rounded, so that no source's is lost in the sum
    total = rows.agg(F.sum("n").alias("rows"), F.sum(share.cast("decimal(38,18)")).cast("double").alias("weights")).first()
    weight = share / F.lit(total["weights"] or 1.0)
    return rows.select("source", "n", weight.alias("weight"), (weight * F.lit(float(total["rows"] or 0)) / F.col("n")).alias("rate"))


def names(docs: DataFrame) -> tuple[str, str, str]:
    """What mix() calls its columns: copy, rate and position, with `mix_` before those that `docs` has."""
    out = []
    for name in ("copy", "rate", "position"):
        while name in docs.columns:
            name = f"mix_{name}"
        out.append(name)
    return tuple(out)


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = POWER, seed: int = SEED) -> DataFrame:
    """Replicate and shuffle: all columns of `docs` (doc_id, source, ...), with copy, rate and position.

    Columns of `docs` with these names stay, and the new ones are called otherwise (see names). `copy` counts a document's copies from 0; `position` (ties: doc_id, copy) orders the mixture, and each
    partition is sorted by it. Equal rows draw alike. Null doc_ids draw as one key. Empty tables give none.
    The target has about as many rows as `docs`; nothing else is dropped. The draw needs no shuffle; one
    exchange by a hash moves the copies, which no source or key can skew.
    """
    plan = materialize(rates(docs.select("source"), weights, power).select(F.col("source").alias("_source"), "rate"), "rates")
    if plan.count() <= MANY_SOURCES:
        plan = F.broadcast(plan)  # of a checked size; else Spark shuffles, and splits skewed sources
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), "doc_id", "source")
    drawn = rows.join(plan, F.expr("source <=> _source"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int")
    mean = F.col("rate") / parts
    most = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    us = F.transform(F.sequence(F.lit(1), parts), lambda j: uniform(F.lit(seed), F.col("doc_id"), j))
    copies = F.aggregate(F.transform(us, lambda u: poisson(mean, most, u)), F.lit(0).cast("long"), lambda a, x: a + x)
    out = drawn.select("row", "doc_id", "rate", F.posexplode(F.array_repeat(F.lit(0), copies.cast("int"))).alias("copy", "_"))
    out = out.withColumn("position", place(F.lit(seed), F.col("doc_id"), F.col("copy")))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    kept = [F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns]
    copy, rate, position = names(docs)
    out = out.repartition(n, "position").sortWithinPartitions("position", "doc_id", "copy")
    return out.select(*kept, F.col("copy").cast("long").alias(copy), F.round("rate", 9).alias(rate), F.col("position").alias(position))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL = """
WITH n AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5::DOUBLE) AS w FROM documents GROUP BY source),
m AS (SELECT max(w) AS top FROM n),
t AS (SELECT sum(n)::DOUBLE AS rows, sum((w / top)::DECIMAL(38, 18))::DOUBLE AS ws FROM n, m),
r AS (SELECT source, w / top / ws * rows / n::DOUBLE AS rate FROM n, t, m),
d AS (SELECT d.*, rate, greatest(1, ceil(rate / 64.0::DOUBLE))::INT AS parts FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
p AS (SELECT row_number() OVER () AS id, * FROM d),
j AS (SELECT id, rate / parts AS mean, (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null') || ':' || j.j::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
      FROM p, LATERAL (SELECT unnest(range(1, parts + 1)) AS j) j),
k AS (SELECT id, sum(list_reduce(range(1, ceil(mean + 12 * sqrt(mean) + 20)::INT + 1),
        lambda s, x: CASE WHEN s.cdf > u THEN s ELSE {'p': s.p * mean / x, 'cdf': s.cdf + s.p * mean / x, 'k': s.k + 1} END,
        {'p': exp(-mean), 'cdf': exp(-mean), 'k': 0::BIGINT}).k)::BIGINT AS copies FROM j GROUP BY id)
SELECT doc_id, text, lang, source, n_chars, round(rate, 9) AS rate, c.copy,
       ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null') || ':' || c.copy::VARCHAR), 1, 15))::BIGINT AS position
FROM p JOIN k USING (id), LATERAL (SELECT unnest(range(0, copies)) AS copy) c
"""
