"""One growth for many points of the grid: cut trees against grown ones."""

from __future__ import annotations

import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from autolot.operators import learning


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(float(rng.randrange(40)), float(rng.randrange(9)), rng.gauss(0, 1)) for _ in range(800)]
    df = spark.createDataFrame([(x, z, x % 7 + z * z / 9 + e) for x, z, e in data], "x double, z double, y double")
    return VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(df).select("features", "y").repartition(3).cache()


def mse(model, rows):
    return model.transform(rows).agg(F.avg(F.pow(F.col("y") - F.col("raw"), F.lit(2)))).first()[0]


def test_a_tree_cut_to_a_depth_equals_one_grown_to_it(spark, rows):
    every = lambda depth: learning.forest("y", 1, depth, 2).setFeatureSubsetStrategy("all").fit(rows)
    deep = every(12)
    for depth in (0, 1, 3, 6):
        cut, grown = learning.cut_back(deep, spark, 1, depth, 1), every(depth)
        a, b = ([r.raw for r in m.transform(rows).collect()] for m in (cut, grown))
        assert max(abs(x - y) for x, y in zip(a, b, strict=True)) < 1e-12 and cut.trees[0].depth <= depth


def test_errors_of_all_points_are_those_of_cut_forests(spark, rows):
    grown = learning.forest("y", 6, 9, 1).fit(rows)
    points = [(d, s) for d in (2, 5, 9) for s in (2, 20, 90)]
    found = learning.errors(grown, rows, "y", (2, 6), points)
    assert len(found) == 18
    for n, depth, least in ((2, 2, 2), (2, 9, 20), (6, 5, 90), (6, 9, 2), (6, 9, 90)):
        cut = learning.cut_back(grown, spark, n, depth, least)
        assert cut.getNumTrees == n and abs(mse(cut, rows) - found[n, depth, least]) < 1e-9
    assert abs(found[6, 9, 2] - mse(grown, rows)) < 1e-9
    path = learning.scratch(spark, "cut")
    learning.cut_back(grown, spark, 6, 9, 90).save(path)
    sizes = learning.nodes(path, spark).where("leftChild >= 0").agg(F.min("rawCount")).first()[0]
    assert sizes >= 90


def test_the_best_point_is_taken(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(rng.choice("abc"), float(i % 50), rng.gauss(0, 4)) for i in range(600)], "m string, x double, y double")
    model = learning.train(df, ["m"], ["x"], "y", trees=(2, 8), depths=(6,), folds=2, leaves=(1,), splits=(2, 300))
    last = model.stages[-1]  # noise: the largest forest of the smallest trees errs least
    assert last.getNumTrees in (2, 8) and max(t.numNodes for t in last.trees) < 15
    assert learning.predict(model, df).where("prediction between 0 and 20").count() == 600


def test_published_models(spark, tmp_path):
    df = spark.createDataFrame([(c, float(i % 20), float(i % 20 > 9) * 8 + 2) for i, c in enumerate("abab" * 50)], "m string, x double, y double")
    few = learning.train(df.where("x < 5"), ["m"], ["x"], "y", trees=(2,), depths=(3,), folds=2, leaves=(1,), splits=(2,))
    all_ = learning.train(df, ["m"], ["x"], "y", trees=(3,), depths=(3,), folds=2, leaves=(1,), splits=(2,))
    root = str(tmp_path)
    with pytest.raises(ValueError):
        learning.published(spark, root, "y")
    assert learning.publish(few, spark, root, "y", {"r2": 0.5}) == 1 and learning.publish(all_, spark, root, "y") == 2 and learning.publish(few, spark, root, "z") == 3
    all_.save(f"{root}/models/4-broken-off")  # never named by the manifest
    says = lambda m: [r.prediction for r in learning.predict(m, df).orderBy("m", "x").collect()]
    assert says(learning.published(spark, root, "y")) == says(all_) != says(few)
    assert says(learning.published(spark, root, "y", 1)) == says(few) == says(learning.published(spark, root, "z"))
    with pytest.raises(ValueError):
        learning.published(spark, root, "y", 3)


def test_rows_are_not_multiplied_by_trees(spark, rows, monkeypatch):
    """Errors are summed by each task where the row is read: no join, and no exchange but that of the sums."""
    grown, seen = learning.forest("y", 5, 6, 1).fit(rows), []
    frames = type(rows)
    monkeypatch.setattr(frames, "first", lambda self, first=frames.first: (seen.append(self._jdf.queryExecution().optimizedPlan().toString()), first(self))[1])
    found = learning.errors(grown, rows, "y", (2, 5), [(3, 2), (6, 40)])
    assert len(seen) == 1 and "Join" not in seen[0] and "Generate" not in seen[0] and seen[0].count("Aggregate") == 1
    for n, depth, least in found:
        assert abs(mse(learning.cut_back(grown, spark, n, depth, least), rows) - found[n, depth, least]) < 1e-9
    assert set(learning.errors(grown, rows.where("y > 1e9"), "y", (2,), [(3, 2)]).values()) == {None}


def test_rows_that_remember_their_nodes_grow_the_same_trees(rows):
    assert learning.forest("y", 5, 10, 1).getCacheNodeIds() and not learning.forest("y", 5, 11, 1).getCacheNodeIds()
    trees = [f.fit(rows).toDebugString.split("\n")[1:] for f in (learning.forest("y", 5, 8, 1), learning.forest("y", 5, 8, 1).setCacheNodeIds(False))]
    assert trees[0] == trees[1] and len(trees[0]) > 50


def test_growths_read_as_many_tasks_as_shuffles_have(spark, monkeypatch):
    """A small file is not grown from in one task."""
    seen, written = [], learning.materialize
    monkeypatch.setattr(learning, "materialize", lambda df, name: seen.append(df.rdd.getNumPartitions()) or written(df, name))
    df = spark.createDataFrame([("abc"[i % 3], float(i), i % 7 * 1.0) for i in range(300)], "m string, x double, y double").coalesce(1)
    learning.train(df, ["m"], ["x"], "y", trees=(2,), depths=(3,), folds=2, leaves=(1,), splits=(2,))
    assert seen == [8]
