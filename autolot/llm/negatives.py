"""Hard-negative mining by slot-decomposed selection.

An anchor's positives are its best rows of its own label. Each positive p opens a window of scores for negatives, from
`low` to `high` percent of p's score; the windows of an anchor overlap. Their upper limits split all scores into disjoint
slots, so a score falls into one slot, and each block of rows keeps the `top` best negatives of each slot. The slots' best
rows are merged from the lowest slot up: what is merged up to a positive's limit holds the best rows of its window.

All anchors meet all rows, in blocks: anchors in groups, rows in blocks of a hash, a label's rows in blocks of their own for
the positives. So neither a label nor an anchor, however frequent, is one task's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from autolot.llm.common import materialize, table
from autolot.llm.graphs import maybe_broadcast
from autolot.llm.vectors import main_length, product, quantized

SCALE, ANCHORS, POSITIVES, TOP, LOW, HIGH = 256, 100, 5, 10, 30, 90
#: Anchors in a group, rows in a block, and anchors whose scores with a block are held at once.
GROUP, BLOCK, HELD = 2048, 8192, 256


def usable(vectors: DataFrame, label: Column, scale: int) -> DataFrame:
    """vec_id, label and whole-numbered v of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), quantized(F.col("embedding"), scale).alias("v"))
    return rows.where("vec_id is not null and label is not null and size(v) > 0")


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, highest first; of equal ones those that come first."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= kth)
    else:
        places = np.arange(len(scores))
    return places[np.argsort(-scores[places], kind="stable")][:k]


def scored(anchors: pd.DataFrame, block: pd.DataFrame) -> Iterator[tuple[pd.Series, np.ndarray]]:
    """Each anchor with its scores with the block's rows."""
    x = np.stack(block["v"].to_numpy())
    for lo in range(0, len(anchors), HELD):
        part = anchors.iloc[lo : lo + HELD]
        yield from zip(part.itertuples(index=False), product(np.stack(part["v"].to_numpy()), x), strict=True)


def windows(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest whole score of each positive's window: low * p <= 100 * s <= high * p."""
    p = [int(x) for x in scores]
    return np.array([-(-low * x // 100) for x in p], np.int64), np.array([high * x // 100 for x in p], np.int64)


def portion(p: Column, percent: int, rounding) -> Column:
    """percent * p / 100, rounded by F.floor or F.ceil, within longs whatever p."""
    rest = F.pmod(p, F.lit(100))
    return F.call_function("div", p - rest, F.lit(100)) * percent + rounding(rest * percent / 100)


def number(of: Column | int) -> Column:
    """A row's block among `of` of them, by a hash of its number."""
    return F.pmod(F.xxhash64("row", F.lit(12)), of if isinstance(of, Column) else F.lit(of)).cast("int")


def mine(vectors: DataFrame, label: Column | None = None, every: int = ANCHORS, positives: int = POSITIVES, top: int = TOP, low: int = LOW, high: int = HIGH, scale: int = SCALE, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    `vectors` has vec_id, embedding and label, or `label` says what the label is. Anchors are rows whose vec_id is divisible
    by `every`. A score is the integer inner product with the anchor; higher ones come first, ties by smaller vec_id, and among
    repeated rows as they stand. Rows with a null vec_id or label, or an unusable vector (`vectors.quantized`) take no part; nor do vectors
    of another length than most usable ones. An anchor is not its own positive: every row with its vec_id is left out. Several rows
    of an anchor's vec_id are one anchor each, and repeated rows are candidates apart. A positive below zero has an empty window
    (its upper limit is below its lower). Empty tables, labels without other rows, and windows without negatives give no rows;
    other columns are ignored.
    """
    answer = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark = vectors.sparkSession
    rows = usable(vectors, F.col("label") if label is None else label, scale)
    length, count = main_length(rows, "v")
    if not count:
        return spark.createDataFrame([], answer)
    rows = materialize(rows.where(F.size("v") == length).withColumn("row", F.monotonically_increasing_id()), "vectors")
    wide = -(-count // block)  # blocks of all rows
    chosen = rows.where(F.col("vec_id") % every == 0)
    groups = -(-chosen.count() // group)
    if not groups:
        return spark.createDataFrame([], answer)
    anchors = materialize(chosen.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "v", number(groups).alias("g")), "anchors")

    # Positives: a group's anchors of a label meet the label's blocks.
    labels = materialize(rows.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "labels")
    wanted = materialize(anchors.select("label", "g").distinct().join(labels, "label"), "wanted")
    data = rows.join(maybe_broadcast(wanted), "label").select(F.concat_ws(":", "g", "label", number(F.col("blocks"))).alias("key"), "row", "vec_id", "v")
    asked = anchors.join(maybe_broadcast(wanted), ["label", "g"]).select("anchor", "anchor_id", "v", "g", "label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    asked = asked.select(F.concat_ws(":", "g", "label", "b").alias("key"), "anchor", "anchor_id", "v")

    def nearest(some: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"anchor": [], "vec_id": [], "row": [], "score": []}).astype("int64")]
        if len(some) and len(rest):
            rest = rest.sort_values(["vec_id", "row"])
            ids, numbers = rest["vec_id"].to_numpy(), rest["row"].to_numpy()
            for a, s in scored(some, rest):
                other = np.flatnonzero(ids != a.anchor_id)
                kept = other[best(s[other], positives)]
                found.append(pd.DataFrame({"anchor": a.anchor, "vec_id": ids[kept], "row": numbers[kept], "score": s[kept]}))
        return pd.concat(found)

    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row")
    pairs = asked.groupBy("key").cogroup(data.groupBy("key")).applyInPandas(nearest, "anchor long, vec_id long, row long, score long")
    pairs = materialize(pairs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives).select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("n").cast("int").alias("n")), "positives")

    # Negatives: each group's anchors, with their positives' scores, meet blocks of all rows; the best of each slot are kept.
    limits = pairs.groupBy("anchor").agg(F.array_sort(F.collect_list("positive_score")).alias("positives"))  # at most `positives` each
    data = rows.select("row", "vec_id", "label", "v", number(wide).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    data = data.select(F.concat_ws(":", "g", "b").alias("key"), "row", "vec_id", "label", "v")
    asked = anchors.join(limits, "anchor").select("anchor", "label", "v", "g", "positives", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("b"))
    asked = asked.select(F.concat_ws(":", "g", "b").alias("key"), "anchor", "label", "v", "positives")

    def slots(some: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"anchor": [], "slot": [], "vec_id": [], "row": [], "score": []}).astype("int64")]
        if len(some) and len(rest):
            rest = rest.sort_values(["vec_id", "row"])
            ids, numbers, labels = (rest[c].to_numpy() for c in ("vec_id", "row", "label"))
            for a, s in scored(some, rest):
                least, most = windows(a.positives, low, high)  # both rise with the positives
                limits, first = np.unique(most, return_index=True)
                slot = np.searchsorted(limits, s)  # of the lowest upper limit that is not below the score
                open_ = np.flatnonzero((labels != a.label) & (slot < len(limits)))
                open_ = open_[s[open_] >= least[first][slot[open_]]]  # below all lower limits of the windows over this slot
                for k in np.unique(slot[open_]):
                    within = open_[slot[open_] == k]
                    kept = within[best(s[within], top)]
                    found.append(pd.DataFrame({"anchor": a.anchor, "slot": limits[k], "vec_id": ids[kept], "row": numbers[kept], "score": s[kept]}))
        return pd.concat(found)

    parts = asked.groupBy("key").cogroup(data.groupBy("key")).applyInPandas(slots, "anchor long, slot long, vec_id long, row long, score long")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row")
    parts = parts.withColumn("n", F.row_number().over(order)).where(F.col("n") <= top)
    entry = F.struct((-F.col("score")).alias("order"), "vec_id", "row")
    parts = parts.groupBy("anchor", "slot").agg(F.array_sort(F.collect_list(entry)).alias("best"))
    merged = parts.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "best"))).alias("slots"))  # from the lowest slot up

    # The merge: what is merged up to a positive's upper limit, without what lies below its lower one.
    upto = lambda x: F.flatten(F.transform(F.filter("slots", lambda y: y["slot"] <= x["slot"]), lambda y: y["best"]))
    merged = merged.select("anchor", F.transform("slots", lambda x: F.struct(x["slot"].alias("slot"), F.slice(F.array_sort(upto(x)), 1, top).alias("best"))).alias("slots"))
    out = pairs.join(merged, "anchor").join(anchors.select("anchor", "anchor_id"), "anchor")
    out = out.withColumns({"most": portion(F.col("positive_score"), high, F.floor), "least": portion(F.col("positive_score"), low, F.ceil)})
    within = F.element_at(F.filter("slots", lambda x: x["slot"] <= F.col("most")), -1)["best"]
    out = out.select("anchor_id", "positive_id", "positive_score", "least", F.posexplode(within).alias("n", "x")).where(-F.col("x.order") >= F.col("least"))
    return out.select("anchor_id", "positive_id", (F.col("n") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("negative_id"), "positive_score", (-F.col("x.order")).alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label counts as the next of ten where vec_id is divisible by 7."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine(table(spark, sf_dir, "embeddings"), label)


SQL = """
WITH e1 AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e0 AS (SELECT * FROM e1 WHERE list_sum(list_transform(v, lambda x: x * x)) <= 9.0e18),
e AS (SELECT * FROM e0 WHERE len(v) = (SELECT len(v) FROM e0 GROUP BY len(v) ORDER BY count(*) DESC, len(v) DESC LIMIT 1)),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id, e.label = a.label AS same, list_dot_product(a.v, e.v)::BIGINT AS score FROM e a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM n WHERE rank <= 10
"""
