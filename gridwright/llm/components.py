"""Connected components of links as alternating joins; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions.storage import staged


def _star(links: DataFrame, small: bool) -> DataFrame:
    """Hang the neighbours of each node below the least of them.

    ``small``: only the neighbours below the node, and the node itself; else those above it. The least
    neighbour comes from a grouped minimum, so a node with very many links is summed before the shuffle,
    and the join back splits it.
    """
    if small:
        around = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        around = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            links.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    hung = around.join(least.withColumn("m", F.least("u", "m")), "u")
    if small:
        moved = hung.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    else:
        moved = hung.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of the links ``(a, b)``; the root is the least node of its component.

    Links that repeat, point both ways or join a node to itself make no difference. Large and small stars
    alternate until nothing moves, in a number of rounds that grows with the logarithm of the longest path;
    each round's links are written to the shared folder.
    """
    links = staged(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    )
    before = None
    while True:
        links = staged(_star(_star(links, small=False), small=True))
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20, 0)"))).first()
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
