"""What the library's trees lack: a least number of rows to split a node, and depths beyond its limit.

A fitted tree or forest is written in the library's own format, its table of nodes is changed, and the result is
loaded again: still a plain ``pyspark.ml`` model, which can be saved, loaded and applied like any other.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.ml.util import JavaMLReadable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions.storage import shared_folder

#: The deepest tree that the library grows at once.
DEEPEST = 30


def _is_forest(model) -> bool:
    return hasattr(model, "trees")


def _rebuilt(model: JavaMLReadable, change, spark):
    """The model with its node table passed through ``change``."""
    folder = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(f"{folder}/before")
    nodes = spark.read.parquet(f"{folder}/before/data")
    # Few nodes, and the model is one object on the driver in any case.
    change(nodes).coalesce(1).write.parquet(f"{folder}/after/data")
    spark.read.text(f"{folder}/before/metadata").coalesce(1).write.text(f"{folder}/after/metadata")
    if _is_forest(model):
        spark.read.parquet(f"{folder}/before/treesMetadata").write.parquet(f"{folder}/after/treesMetadata")
    return type(model).load(f"{folder}/after")


def least_split(model, rows: int, spark):
    """``model`` without the splits of nodes with fewer than ``rows`` training rows.

    A tree is grown from the top, each split for itself, so what is left is the tree that would have grown under
    that limit: such a node is a leaf with its own prediction. What was below it is no longer reached.
    """

    def change(nodes: DataFrame) -> DataFrame:
        node = "nodeData" if _is_forest(model) else None
        at = lambda c: F.col(f"{node}.{c}" if node else c)
        ends = at("rawCount") < rows
        none = F.struct(F.lit(-1).alias("featureIndex"), F.array().cast("array<double>").alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
        made = [
            *[at(c) for c in ("id", "prediction", "impurity", "impurityStats", "rawCount")],
            F.when(ends, -1.0).otherwise(at("gain")).alias("gain"), F.when(ends, -1).otherwise(at("leftChild")).alias("leftChild"),
            F.when(ends, -1).otherwise(at("rightChild")).alias("rightChild"), F.when(ends, none).otherwise(at("split")).alias("split"),
        ]
        return nodes.select("treeID", F.struct(*made).alias("nodeData")) if node else nodes.select(*made)

    return _rebuilt(model, change, spark)


def with_nodes(model, nodes: DataFrame):
    """A forest with the trees of ``nodes`` (``treeID`` and the columns of a node) in place of its own."""

    def change(table: DataFrame) -> DataFrame:
        kind = table.schema["nodeData"].dataType
        made = [F.col(f.name).cast(f.dataType).alias(f.name) for f in kind.fields]
        return nodes.select(F.col("treeID").cast(table.schema["treeID"].dataType).alias("treeID"), F.struct(*made).alias("nodeData"))

    return _rebuilt(model, change, nodes.sparkSession)


def _nodes(model, spark) -> list[pd.DataFrame]:
    """The node table of each tree, by id (parents first)."""
    folder = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(folder)
    table = spark.read.parquet(f"{folder}/data")
    table = table.select("treeID", "nodeData.*") if _is_forest(model) else table.select(F.lit(0).alias("treeID"), "*")
    rows = table.toPandas()
    return [part.drop(columns="treeID").sort_values("id").reset_index(drop=True) for _, part in rows.groupby("treeID")]


def _depths(nodes: pd.DataFrame) -> list[int]:
    depths = [0] * len(nodes)
    for at, left, right in zip(nodes["id"], nodes["leftChild"], nodes["rightChild"]):
        if left >= 0:
            depths[left] = depths[right] = depths[at] + 1
    return depths


def _grafted(nodes: pd.DataFrame, grafts: dict[int, pd.DataFrame]) -> pd.DataFrame:
    """The table with trees in place of some leaves, numbered anew from the root, left before right."""
    tables, out = [nodes, *grafts.values()], []
    number = {leaf: i + 1 for i, leaf in enumerate(grafts)}
    width = max(len(s) for s in nodes["impurityStats"])
    stack = [(0, 0, None, "")]  # table, node, parent's place, side
    while stack:
        t, n, parent, side = stack.pop()
        if t == 0 and n in number:
            t, n = number[n], 0
        row = tables[t].iloc[n].to_dict()
        left, right, row["id"] = row["leftChild"], row["rightChild"], len(out)
        row["impurityStats"] = [*row["impurityStats"], *[0.0] * (width - len(row["impurityStats"]))]
        if parent is not None:
            out[parent][side] = row["id"]
        out.append(row)
        if left >= 0:
            stack += [(t, right, row["id"], "rightChild"), (t, left, row["id"], "leftChild")]
    return pd.DataFrame(out)


def deeper(model, train: DataFrame, estimator, depth: int):
    """``model`` grown on to ``depth``: each impure leaf at the library's limit gets a tree of its own rows.

    ``estimator`` is a single tree of the same kind and settings. The trees of a forest grow on with all training rows
    that reach the leaf, not with their own draws.
    """
    spark = train.sparkSession
    least = 2 * estimator.getMinInstancesPerNode()
    reached = DEEPEST
    while reached < depth:
        step = min(DEEPEST, depth - reached)
        trees = model.trees if _is_forest(model) else [model]
        grown, changed = [], False
        for tree, nodes in zip(trees, _nodes(model, spark)):
            depths, grafts = _depths(nodes), {}
            leaves = nodes.index[nodes["leftChild"] < 0].tolist()
            open_ = [(i, n) for i, n in enumerate(leaves) if depths[n] == reached and nodes["rawCount"][n] >= least and nodes["impurity"][n] > 0]
            if open_:
                placed = tree.copy().setLeafCol("_leaf").transform(train).select(*train.columns, "_leaf")
                for i, n in open_:
                    sub = estimator.copy({estimator.maxDepth: step}).fit(placed.where(F.col("_leaf") == float(i)).drop("_leaf"))
                    if sub.depth:
                        grafts[n] = _nodes(sub, spark)[0]
            changed |= bool(grafts)
            grown.append(_grafted(nodes, grafts) if grafts else nodes)
        if not changed:
            break

        def change(table: DataFrame) -> DataFrame:
            kind = table.schema["nodeData"].dataType if _is_forest(model) else table.schema
            rows = [(i, tuple(_plain(r[f.name]) for f in kind.fields)) for i, t in enumerate(grown) for r in t.to_dict("records")]
            whole = spark.createDataFrame(rows, f"treeID int, nodeData {kind.simpleString()}")
            return whole if _is_forest(model) else whole.select("nodeData.*")

        model = _rebuilt(model, change, spark)
        reached += step
    return model


def _plain(value):
    """A cell of a node table as plain Python."""
    if hasattr(value, "asDict"):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(_plain(v) for v in value.values())
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist") and getattr(value, "ndim", 0):
        return [float(v) for v in value]
    return value.item() if hasattr(value, "item") else value
