"""Queries return all that their inputs hold, held against plain Python beside their SQL."""

from __future__ import annotations

import inspect

from pyspark.sql import functions as F

from autolot import plans
from autolot.operators import learning
from autolot.plans import jobs
from autolot.plans.lifts import frame


def test_queue_and_order_have_all_rows(spark, sf_dir):
    low = frame(spark, sf_dir, "reviews").where("level = 'low'").select("review_id", "ts", "note").collect()
    got = plans.queries()["b22_queue"](spark, sf_dir).collect()
    want = sorted(low, key=lambda r: (r.ts, r.review_id))
    assert len(low) > 200 and [(r.review_id, r.status) for r in got] == [(r.review_id, "failed" if r.note is None else "processed") for r in want]

    listings = frame(spark, sf_dir, "listings").select("external_id", "k", "expert", "price").collect()
    want = sorted(listings, key=lambda r: (-(r.expert or 0), 999999 if r.price is None else r.price, r.external_id, r.k))
    assert [tuple(r) for r in plans.queries()["f3_listing_order"](spark, sf_dir).collect()] == [(r.external_id, r.k) for r in want]


def test_models_with_many_recalls_score_low(spark, sf_dir, tmp_path):
    """Forty times the recalls, but none of the first brand."""
    spark.read.parquet(f"{sf_dir}/part.parquet").write.parquet(f"{tmp_path}/part.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("(o_custkey + o_orderkey) % 16 <> 0")
    orders.crossJoin(spark.range(40)).drop("id").write.parquet(f"{tmp_path}/orders.parquet")
    recalls = frame(spark, str(tmp_path), "recalls")
    many = {tuple(r) for r in recalls.where(F.col("risks").contains("incendie")).groupBy("marque", "modele").count().where("count >= 60").select("marque", "modele").collect()}
    known = {tuple(r) for r in recalls.select("marque", "modele").distinct().collect()}
    got = {(r.marque, r.modele): r.score for r in plans.queries()["d4_vehicles_without_recalls"](spark, str(tmp_path)).collect()}
    assert many & set(got) and all(got[m] == 0.0 for m in many & set(got))
    without = set(got) - known
    assert without and all(got[m] == 10.0 for m in without)


def test_the_grid_of_the_source_is_the_default():
    """The queries search a stated part of it (`jobs.GRID`), as all of it takes hours."""
    default = {k: v.default for k, v in inspect.signature(learning.train).parameters.items()}
    assert (default["trees"], default["depths"], default["leaves"], default["folds"]) == ((100, 200, 300), (30, 10, 20), (1, 2, 4), 5)
    assert set(jobs.GRID) == {"trees", "depths", "leaves", "folds"} and len(jobs.GRID["trees"]) * len(jobs.GRID["depths"]) * len(jobs.GRID["leaves"]) == 8


def test_leaf_size_is_searched(spark):
    df = spark.createDataFrame([(f"m{i % 3}", float(i % 50), float(i % 3) * 6) for i in range(300)], "m string, x double, y double")
    model = learning.train(df, ["m"], ["x"], "y", trees=(2,), depths=(4,), folds=2, leaves=(120, 1))
    assert model.stages[-1].getMinInstancesPerNode() == 1
