"""Trees of items by parent, expanded breadth first within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def expand(items: DataFrame, depth: int, limit: int) -> DataFrame:
    """The first ``limit`` items of each root by breadth: root, item, level, path (positions from the root), by path order.

    items: item, parent (null for roots), pos (its place among siblings), live. Items not live are skipped with all below
    them. Levels are joined one after another, ``depth`` at most; siblings come before children.
    """
    live = items.where(F.coalesce(F.col("live"), F.lit(True)))
    child = live.select(F.col("item").alias("_i"), F.col("parent").alias("_p"), F.col("pos").alias("_o")).where("_p is not null")
    level = live.where("parent is null").select(F.col("item").alias("root"), "item", F.lit(0).alias("level"), F.array(F.col("pos")).alias("path"))
    out = level
    for k in range(1, depth + 1):
        level = level.join(child, F.col("item") == F.col("_p")).select("root", F.col("_i").alias("item"), F.lit(k).alias("level"), F.concat("path", F.array("_o")).alias("path"))
        out = out.unionByName(level)
    # Counts before an item by level bound the work: the budget is a rank by (level, path) within the root.
    ranked = out.withColumn("_k", F.row_number().over(Window.partitionBy("root").orderBy("level", "path", "item")))
    return ranked.where(F.col("_k") <= limit).drop("_k")
