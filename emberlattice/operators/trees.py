"""Fitted trees as a table of nodes, and predictions by walking it."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlattice.session import shared_folder

BROADCAST_NODES = 200_000


def node_table(model, spark) -> DataFrame:
    """(tree, weight, node, feature, threshold, left, right, value) of a fitted forest or boosted model.

    The model is written to the shared folder and its nodes are read back by Spark. A row goes left where its
    feature is at most the threshold; a leaf has null feature, threshold and children. The prediction is the
    sum of weight * value over the trees' leaves. Features are numbers, in the order of the vector.
    """
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    trees = spark.read.parquet(f"{path}/treesMetadata").select(F.col("_1").alias("tree"), F.col("_3").alias("weight"))
    if "RandomForest" in type(model).__name__:
        trees = trees.withColumn("weight", F.lit(1.0 / model.getNumTrees))
    nodes = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    inner = F.col("leftChild") >= 0
    return nodes.join(trees, "tree").select(
        "tree", "weight", F.col("id").alias("node"), F.when(inner, F.col("split.featureIndex")).alias("feature"),
        F.when(inner, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
        F.when(inner, F.col("leftChild")).alias("left"), F.when(inner, F.col("rightChild")).alias("right"),
        F.col("prediction").alias("value"))


def score_nodes(rows: DataFrame, nodes: DataFrame, names: Sequence[str], keys: Sequence[str], depth: int) -> DataFrame:
    """(keys..., prediction): every row walks every tree, one equi join with the node table for each level.

    ``keys`` are unique and not null; ``depth`` is the model's greatest. The nodes are broadcast only if
    counted to be at most ``BROADCAST_NODES``.
    """
    side = F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes
    last = nodes.agg(F.max("tree")).first()[0]
    at = rows.select(*keys, F.array(*[F.col(n).cast("double") for n in names]).alias("_x"),
                     F.explode(F.sequence(F.lit(0), F.lit(last))).alias("tree"), F.lit(0).alias("node"))
    for _ in range(depth):
        step = F.when(F.get("_x", F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        at = at.join(side, ["tree", "node"]).select(*keys, "_x", "tree", F.coalesce(step, F.col("node")).alias("node"))
    return at.join(side, ["tree", "node"]).groupBy(*keys).agg(F.sum(F.col("weight") * F.col("value")).alias("prediction"))
