"""Exact top-k search by a Voronoi kNN join (Lu et al.), for integer inner products.

Vectors are grouped by their nearest pivot. A cell's summary (rows, radius, distances of its rows nearest to
the pivot) bounds the products of all its rows with a group of queries: from above, and from below for at
least k rows. A cell is sent to a group of queries only if its upper bound reaches the group's k-th lower
bound. Each group is solved against blocks of rows, and the blocks' best rows are merged.
"""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from autolot.llm.common import materialize, slim, table
from autolot.llm.vectors import main_length, matrix, product, quantized

K, SCALE, EVERY = 20, 64, 20
#: Queries in a group, and rows in a block.
GROUP, BLOCK = 4096, 4096
#: There is a pivot for each block's worth of rows, within these bounds. The driver holds tables of pivots by pivots.
FEWEST, MOST = 48, 1024


def pivots(rows: DataFrame, count: int) -> np.ndarray:
    """At most `count` different vectors, from four times as many rows chosen by a hash of vec_id; a top-k, not a shuffle."""
    chosen = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(4 * count).toPandas()["v"]
    different = list(dict.fromkeys(tuple(v) for v in chosen))[:count]
    return np.array(different, float) if different else np.zeros((0, 0))


def _assign(rows: DataFrame, centre: np.ndarray) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(centre)
    half = (centre**2).sum(1) / 2

    def run(batches):
        for batch in slim(batches, 4096):
            x = matrix(batch.column(2))
            if not len(x):
                continue
            cell = (half[None] - x @ sent.value.T).argmin(1)
            far = np.sqrt(((x - sent.value[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far), pa.array(np.sqrt((x**2).sum(1)))], ["vec_id", "query", "v", "cell", "far", "norm"])

    return rows.mapInArrow(run, "vec_id long, query boolean, v array<double>, cell int, far double, norm double")


def needed(centre: np.ndarray, n: np.ndarray, radius: np.ndarray, near: list[np.ndarray], groups: list[list[int]], query_radius: np.ndarray, query_norm: np.ndarray, k: int) -> list[list[int]]:
    """For each group of query cells, the cells that may hold one of the k best rows of one of its queries.

    With q = p + d for a query of cell p and x = c + e for a row of cell c: q.x = p.c + d.c + q.e, where
    |d.c| is at most the query radius times |c|, and |q.e| at most the query norm times |e|.
    """
    size = np.sqrt((centre**2).sum(1))
    out = []
    for group in groups:
        keep = np.zeros(len(centre), bool)
        for i in group:
            mid = centre @ centre[i]
            slack = query_radius[i] * size
            upper = mid + slack + query_norm[i] * radius
            lower = np.concatenate([np.repeat(mid[j] - slack[j], len(near[j])) - query_norm[i] * near[j] for j in range(len(centre))])
            kth = np.sort(lower)[-(k + 1)] if len(lower) > k else -np.inf  # one of them may be the query itself
            keep |= (n > 0) & (upper >= kth - 1e-6 * (1 + abs(kth)))
        out.append(np.flatnonzero(keep).tolist())
    return out


def grouped(centre: np.ndarray, nq: np.ndarray, group: int) -> list[list[int]]:
    """Query cells near each other, together about `group` queries; a larger cell is a group alone."""
    left, groups = np.flatnonzero(nq), []
    while len(left):
        near = left[np.argsort(((centre[left] - centre[left[0]]) ** 2).sum(1), kind="stable")]
        own = near[: max(1, int(np.searchsorted(np.cumsum(nq[near]), group, "right")))]
        groups.append(own.tolist())
        left = np.setdiff1d(left, own)
    return groups


def plan(spark: SparkSession, n: np.ndarray, nq: np.ndarray, groups: list[list[int]], need: list[list[int]], group: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Where rows and queries go: for each cell, its unit, blocks and the groups that need it; for each query cell, its
    group, its shares and the units it needs. Blocks and shares are numbers here and become rows on the executors.
    """
    shares = [int(-(-nq[g].sum() // group)) for g in groups]
    blocks = np.maximum(1, -(-n // block))
    unit, filled, last = np.arange(len(n)), block + 1, len(n) - 1
    for c in sorted(np.flatnonzero((n > 0) & (n < block)).tolist(), key=lambda c: n[c]):  # small cells share a unit
        if filled + n[c] > block:
            last, filled = last + 1, 0
        unit[c], filled = last, filled + n[c]
    wanted: dict[int, list[tuple[int, int]]] = {}
    for g, cells in enumerate(need):
        for c in cells:
            wanted.setdefault(c, []).append((g, shares[g]))
    sends = [(c, int(unit[c]), int(blocks[c]), to) for c, to in wanted.items()]
    asks = [(c, g, shares[g], sorted({(int(unit[x]), int(blocks[x])) for x in need[g]})) for g, cells in enumerate(groups) for c in cells]
    return (
        spark.createDataFrame(sends, "cell int, unit int, blocks int, groups array<struct<g: int, shares: int>>"),
        spark.createDataFrame(asks, "cell int, g int, shares int, units array<struct<unit: int, blocks: int>>"),
    )


def search(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, count: int | None = None, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score: the k best of all other rows for each row whose vec_id is divisible by `every`.

    `vectors` has vec_id and embedding. Rows with an unusable vector, or a null vec_id, take no part; nor do vectors
    of another length than most usable ones (of equally frequent lengths, than the longest). A vector
    whose squares do not add up to a long takes no part, so every score is an exact long (`vectors.quantized`). Repeated rows are
    candidates apart; a query's own row is every row with its vec_id. Several rows of a query's vec_id are one query:
    the k best are those of all their scores. Fewer than k candidates are all given. Empty tables give no rows; other
    columns are ignored. What the driver holds and what is broadcast is bounded by the square of the pivots.
    """
    answer = "query_id long, vec_id long, score long"
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("vec_id") % every == 0).alias("query"), quantized(F.col("embedding"), scale).alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    length, usable = main_length(rows, "v")
    if not usable:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = rows.where(F.size("v") == length)
    centre = pivots(rows, count or min(MOST, max(FEWEST, usable // block)))
    rows = materialize(_assign(rows, centre).withColumn("row", F.monotonically_increasing_id()), "cells")
    nearest = F.row_number().over(Window.partitionBy("cell", "part").orderBy("far"))
    # A query leaves out every row with its vec_id, so each vec_id counts once, in one cell, towards the k + 1 of a bound.
    salted = rows.select("vec_id", "cell", "far").dropDuplicates(["vec_id"]).select("cell", "far", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("part"))
    close = salted.withColumn("_k", nearest).where(F.col("_k") <= k + 1).groupBy("cell").agg(F.slice(F.array_sort(F.collect_list("far")), 1, k + 1).alias("near"))
    total = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.sum(F.col("query").cast("long")).alias("nq"), F.max(F.when(F.col("query"), F.col("far"))).alias("qr"), F.max(F.when(F.col("query"), F.col("norm"))).alias("qn"))
    p = len(centre)
    n, radius, nq, qr, qn, near = np.zeros(p, int), np.zeros(p), np.zeros(p, int), np.zeros(p), np.zeros(p), [np.zeros(0)] * p
    for r in total.join(close, "cell", "left").collect():  # a row for each pivot; rows of a cell may all be counted in others
        c = r["cell"]
        n[c], radius[c], nq[c], qr[c], qn[c], near[c] = r["n"], r["radius"], r["nq"], r["qr"] or 0, r["qn"] or 0, np.array(r["near"] or [], float)

    groups = grouped(centre, nq, group)
    need = needed(centre, n, radius, near, groups, qr, qn, k)
    pruned = 1 - sum(int(n[c].sum()) * int(nq[g].sum()) for g, c in zip(groups, need, strict=True)) / max(1, int(n.sum()) * int(nq.sum()))
    logging.getLogger(__name__).info("%d pivots, %d groups of queries; %.4f of all pairs are pruned by bounds", p, len(groups), pruned)
    sends, asks = plan(spark, n, nq, groups, need, group, block)

    # A unit of work is a share of a group's queries and a block of a cell's rows, or of several small cells'.
    hashed = F.xxhash64("row", F.lit(8))  # not of vec_id, which may be repeated
    data = rows.join(F.broadcast(sends), "cell").select("vec_id", "v", F.pmod(hashed, "blocks").cast("int").alias("b"), "unit", F.explode("groups").alias("to"))
    data = data.select("vec_id", "v", "b", "unit", "to.g", F.explode(F.sequence(F.lit(0), F.col("to.shares") - 1)).alias("s"))
    data = data.select(F.concat_ws(":", "g", "s", "unit", "b").alias("key"), "vec_id", "v")
    asked = rows.where("query").join(F.broadcast(asks), "cell").select("vec_id", "v", "g", F.pmod(hashed, "shares").alias("s"), F.explode("units").alias("to"))
    asked = asked.select("vec_id", "v", "g", "s", "to.unit", F.explode(F.sequence(F.lit(0), F.col("to.blocks") - 1)).alias("b"))
    asked = asked.select(F.concat_ws(":", "g", "s", "unit", "b").alias("unit_key"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))

    def solve(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(block):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        block = block.sort_values("vec_id", kind="stable")
        ids, x = block["vec_id"].to_numpy(), np.stack(block["v"].to_numpy())
        found = []
        for lo in range(0, len(queries), 512):
            part = queries.iloc[lo : lo + 512]
            score = product(np.stack(part["q"].to_numpy()), x)
            for q, s in zip(part["query_id"].tolist(), score, strict=True):
                other = np.flatnonzero(ids != q)
                s = s[other]
                if len(s) > k:
                    kth = np.partition(s, len(s) - k)[len(s) - k]
                    kept = np.flatnonzero(s >= kth)
                else:
                    kept = np.arange(len(s))
                kept = kept[np.argsort(-s[kept], kind="stable")][:k]
                found.append(pd.DataFrame({"query_id": q, "vec_id": ids[other[kept]], "score": s[kept]}))
        return pd.concat(found)

    best = asked.groupBy("unit_key").cogroup(data.groupBy("key")).applyInPandas(solve, answer)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


SQL = """
WITH e1 AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e0 AS (SELECT * FROM e1 WHERE list_sum(list_transform(v, lambda x: x * x)) <= 9.0e18),
e AS (SELECT * FROM e0 WHERE len(v) = (SELECT len(v) FROM e0 GROUP BY len(v) ORDER BY count(*) DESC, len(v) DESC LIMIT 1)),
q AS (SELECT vec_id, v FROM e WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v)::BIGINT AS score FROM q JOIN e ON q.vec_id <> e.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
