"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from autolot.llm.common import materialize, quoted

#: Written tables of at most so many bytes, as counted, are broadcast; larger ones are shuffled.
BROADCAST_BYTES = 64_000_000


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a written table if the bytes of its rows, counted whole, allow it."""
    wide = [c.name for c in df.schema if isinstance(c.dataType, ArrayType | MapType | StructType)]
    size = F.lit(16 * len(df.columns)).cast("long")
    for c in df.schema:
        if isinstance(c.dataType, StringType):
            size = size + F.coalesce(F.octet_length(quoted(c.name)), F.lit(0))
    for name in wide:
        size = size + F.coalesce(F.octet_length(F.to_json(F.struct(quoted(name)))), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most else df


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a, b); the root is the component's least node.

    In each round every root that has an edge to a smaller root hooks onto the least of these; chains of
    hooks are then followed to their ends by doubling. A round leaves at most half of the roots that can still
    be joined, so rounds go with the logarithm of the nodes. Each round is written, so nothing is recomputed.
    """
    edges = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels = materialize(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), "labels")
    while True:
        known = maybe_broadcast(labels)
        ends = edges.join(known.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(known.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        hooks = ends.where("ra <> rb").groupBy(F.greatest("ra", "rb").alias("root")).agg(F.min(F.least("ra", "rb")).alias("to"))
        hooks = materialize(hooks, "hooks")
        if hooks.isEmpty():
            return labels
        while True:
            other = maybe_broadcast(hooks).select(F.col("root").alias("to"), F.col("to").alias("further"))
            longer = materialize(hooks.join(other, "to", "left").select("root", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "hooks")
            hooks = longer.select("root", "to")
            if longer.where("moved").isEmpty():
                break
        labels = materialize(labels.join(maybe_broadcast(hooks), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
