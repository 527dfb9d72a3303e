"""The note model: features, random forest, grid search, prediction."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from autolot.sources.files import materialize, scratch

SEED = 42


def bucket(key: str, seed: int = SEED, of: int = 10) -> Column:
    """0 to `of` - 1 by MD5 of seed and key: the same whatever the partitions, and in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long") % of


def encoder(texts: list[str], numbers: list[str]) -> Pipeline:
    """Sorted categories as codes (unknown ones get a code of their own), numbers with gaps filled by the mean."""
    index = StringIndexer(inputCols=texts, outputCols=[f"{c}_code" for c in texts], stringOrderType="alphabetAsc", handleInvalid="keep")
    fill = Imputer(strategy="mean", inputCols=numbers, outputCols=[f"{c}_full" for c in numbers])
    return Pipeline(stages=[index, fill, VectorAssembler(inputCols=[*index.getOutputCols(), *fill.getOutputCols()], outputCol="features")])


def forest(label: str, trees: int, depth: int, leaf: int) -> RandomForestRegressor:
    """Up to depth 10 rows remember the nodes they are in, which grows the same trees in less time; deeper trees take so many rounds that this would ask for checkpoints."""
    return RandomForestRegressor(featuresCol="features", labelCol=label, predictionCol="raw", seed=SEED, maxBins=256, numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, cacheNodeIds=depth <= 10)


def nodes(path: str, spark: SparkSession) -> DataFrame:
    """The nodes of a saved forest, flat: treeID, id (from the root on, left before right), prediction, rawCount, leftChild, rightChild and the rest."""
    return spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")


def depths_of(tree: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Depth and parent (-1: the root) of the nodes of one tree, sorted by id."""
    depth, parent = np.zeros(len(tree), np.int64), np.full(len(tree), -1)
    for i, (lo, hi) in enumerate(zip(tree["leftChild"].tolist(), tree["rightChild"].tolist(), strict=True)):
        for child in (lo, hi):
            if child >= 0:
                depth[child], parent[child] = depth[i] + 1, i
    return depth, parent


def answers(tree: pd.DataFrame, points: list[tuple[int, int]]) -> pd.DataFrame:
    """leaf (numbered from the left) and what the tree says there if it is cut back to each (depth, least rows to split)."""
    tree = tree.sort_values("id")
    depth, parent = depths_of(tree)
    says, rows, inner = tree["prediction"].to_numpy(float), tree["rawCount"].to_numpy(), tree["leftChild"].to_numpy() >= 0
    out = np.empty((len(points), len(tree)))
    for k, (most, least) in enumerate(points):
        stop = (depth >= most) | (rows < least)
        at = np.arange(len(tree))  # the node where a row that reaches this one stops
        for i in range(1, len(tree)):  # parents come first
            up = parent[i]
            if at[up] != up or stop[up]:
                at[i] = at[up]
        out[k] = says[at]
    leaves = np.flatnonzero(~inner)
    return pd.DataFrame({"tree": int(tree["treeID"].iloc[0]), "leaf": np.arange(len(leaves), dtype=np.int64), "says": list(out[:, leaves].T)})


def errors(grown: RandomForestRegressionModel, rows: DataFrame, label: str, trees: tuple[int, ...], points: list[tuple[int, int]]) -> dict[tuple[int, int, int], float]:
    """Mean squared error on `rows` (features, label) of the grown forest's first trees, cut back to each (depth, least rows to split).

    A row's leaves in the grown trees are found once; what a cut tree says there is looked up. So one growth answers for all points.
    What the leaves say is broadcast, as the forest itself is: a number for each leaf and point, less than Spark's forest, which the driver
    also holds. So rows are neither multiplied by trees nor shuffled; each task gives its sums.
    """
    spark = rows.sparkSession
    path = scratch(spark, "forest")
    grown.save(path)
    kept = nodes(path, spark).where(F.col("treeID") < max(trees)).select("treeID", "id", "prediction", "rawCount", "leftChild", "rightChild")
    says = kept.groupBy("treeID").applyInPandas(lambda t: answers(t, points), "tree int, leaf long, says array<double>").toPandas().sort_values(["tree", "leaf"])  # one tree a task
    table = spark.sparkContext.broadcast((np.stack(says["says"].to_numpy()).T.copy(), np.searchsorted(says["tree"].to_numpy(), np.arange(max(trees)))))
    names = [f"s_{n}_{k}" for n in trees for k in range(len(points))]

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, first = table.value
        sums, count = np.zeros((len(trees), len(points))), 0
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            at = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)[:, : len(first)].astype(np.int64) + first
            for k in range(len(points)):
                total = np.cumsum(told[k][at], axis=1)
                sums[:, k] += [np.sum((y - total[:, n - 1] / n) ** 2) for n in trees]
            count += len(y)
        if count:
            yield pa.RecordBatch.from_pydict({"n": [count], **{c: [float(x)] for c, x in zip(names, sums.ravel(), strict=True)}})

    leafy = grown.copy().setLeafCol("_leaves").transform(rows).select(F.col(label).cast("double").alias("y"), vector_to_array("_leaves").alias("leaves"))
    parts = leafy.mapInArrow(squares, "n long, " + ", ".join(f"{c} double" for c in names))
    found = parts.agg(*[(F.sum(c) / F.sum("n")).alias(c) for c in names]).first()
    table.unpersist()
    return {(n, *points[k]): found[f"s_{n}_{k}"] for n in trees for k in range(len(points))}


def cut_back(grown: RandomForestRegressionModel, spark: SparkSession, trees: int, depth: int, least: int) -> RandomForestRegressionModel:
    """The forest of the first `trees` trees without what lies below `depth`, and without splits of fewer than `least` rows."""
    source, target = scratch(spark, "forest"), scratch(spark, "forest")
    grown.save(source)
    flat = nodes(source, spark)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.schema)

    def cut(tree: pd.DataFrame) -> pd.DataFrame:
        tree = tree.sort_values("id").reset_index(drop=True)
        level, parent = depths_of(tree)
        stop = (level >= depth) | (tree["rawCount"].to_numpy() < least) | (tree["leftChild"].to_numpy() < 0)
        kept = np.ones(len(tree), bool)
        for i in range(1, len(tree)):
            kept[i] = kept[parent[i]] and not stop[parent[i]]
        number = np.append(np.cumsum(kept) - 1, -1)  # the last one for "no child"
        leaf = pd.Series(stop)
        tree = tree.assign(id=number[:-1], leftChild=np.where(stop, -1, number[tree["leftChild"]]), rightChild=np.where(stop, -1, number[tree["rightChild"]]), gain=tree["gain"].where(~leaf, -1.0))
        none = {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}
        tree["split"] = [none if s else x for x, s in zip(tree["split"], stop, strict=True)]
        return tree[kept]

    data = flat.where(F.col("treeID") < trees).groupBy("treeID").applyInPandas(cut, kinds)
    fields = [c for c in flat.columns if c != "treeID"]
    data.select("treeID", F.struct(*fields).alias("nodeData")).write.parquet(f"{target}/data")
    spark.read.parquet(f"{source}/treesMetadata").where(F.col("_1") < trees).coalesce(1).write.parquet(f"{target}/treesMetadata")
    about = json.loads(spark.read.text(f"{source}/metadata").first()[0])
    about["numTrees"] = about["paramMap"]["numTrees"] = trees
    about["paramMap"]["maxDepth"] = depth
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{target}/metadata")
    return RandomForestRegressionModel.load(target)


def train(df: DataFrame, texts: list[str], numbers: list[str], label: str, trees: tuple[int, ...] = (100, 200, 300), depths: tuple[int, ...] = (30, 10, 20), folds: int = 5, leaves: tuple[int, ...] = (1, 2, 4), splits: tuple[int, ...] = (2, 5, 10)) -> PipelineModel:
    """Fit the encoder once, then search the grid by mean squared error over `folds`; the model applies both.

    The defaults are the source's 81 points and folds; its unlimited depth is 30 here, the most that Spark grows. A fold needs one growth for each leaf
    size: the largest forest at the greatest depth. Smaller forests are its first trees, and lower depths and larger least sizes of a node to
    split, which Spark's forest does not know, are its trees cut back, as a tree grown under them would stop there.
    Of equally good points the first in the order of the parameters is taken. Rows without label or features take no part.
    """
    spark = df.sparkSession
    coded = encoder(texts, numbers).fit(df)
    rows = coded.transform(df).where(F.col(label).isNotNull()).select("features", F.col(label).cast("double").alias(label), F.floor(F.rand(SEED) * folds).cast("int").alias("_fold"))
    # Few bytes a row, of which a file's readers make few tasks, but each growth passes over them as many times as its trees are deep.
    rows = materialize(rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), "features")
    points = [(d, s) for d in depths for s in splits]
    total: dict[tuple[int, int, int, int], float] = {}
    for fold in range(folds):
        for leaf in leaves:
            grown = forest(label, max(trees), max(depths), leaf).fit(rows.where(F.col("_fold") != fold))
            for point, e in errors(grown, rows.where(F.col("_fold") == fold), label, trees, points).items():
                total[leaf, *point] = total.get((leaf, *point), 0.0) + (e or 0.0)  # a fold without rows tells nothing
    leaf, n, depth, least = min(total, key=total.get)
    best = forest(label, n, max(depths), leaf).fit(rows)
    return PipelineModel(stages=[*coded.stages, cut_back(best, spark, n, depth, least)])


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Notes rounded to two digits, from 0 to 20."""
    return model.transform(df).withColumn("prediction", F.greatest(F.lit(0.0), F.least(F.lit(20.0), F.round("raw", 2)))).drop("raw")


MODELS = "number long, path string, published_at timestamp, label string, metrics map<string,double>"


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    """Published models under `root`; none where there is no manifest yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(MODELS).parquet(f"{root}/manifest") if there else spark.createDataFrame([], MODELS)


def publish(model: PipelineModel, spark: SparkSession, root: str, label: str, metrics: dict[str, float] | None = None) -> int:
    """Save a model under `root`, then a row of the manifest that names it; returns its number, from 1.

    A model counts from its row on, so one whose saving broke off is never loaded, and models that are in use are never overwritten.
    One job publishes at a time.
    """
    number = (_manifest(spark, root).agg(F.max("number")).first()[0] or 0) + 1
    path = f"{root}/models/{number}-{uuid.uuid4().hex}"
    model.save(path)
    row = (number, path, datetime.now(timezone.utc), label, metrics or {})
    spark.createDataFrame([row], MODELS).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return number


def published(spark: SparkSession, root: str, label: str, number: int | None = None) -> PipelineModel:
    """The latest published model of a label, or that of a number; an error where there is none."""
    known = _manifest(spark, root).where(F.col("label") == label)
    row = (known if number is None else known.where(F.col("number") == number)).orderBy(F.desc("number")).first()
    if row is None:
        raise ValueError(f"no model of {label} under {root}")
    return PipelineModel.load(row["path"])
