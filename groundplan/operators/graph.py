"""Bounded closures over edge tables and parent chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundplan.operators.lineage_cut import cut


def closure(edges: DataFrame, start: int | str, depth: int, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """Distinct edges within ``depth`` steps of ``start`` in either direction, with the least step.

    Each step joins the frontier with the edges; the frontier loses what was seen, so
    cycles end, and is checkpointed, so the plan grows by one union a step.
    """
    both = edges.select(F.col(source).alias("_from"), F.col(target).alias("_to")).union(edges.select(F.col(target).alias("_from"), F.col(source).alias("_to"))).distinct()
    seen = frontier = edges.sparkSession.createDataFrame([(start, 0)], f"node {edges.schema[source].dataType.simpleString()}, step int")
    for step in range(1, depth):
        reached = frontier.join(both, F.col("node") == F.col("_from")).select(F.col("_to").alias("node")).distinct()
        frontier = cut(reached.join(seen.select("node"), "node", "left_anti").withColumn("step", F.lit(step)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    near = seen.groupBy("node").agg(F.min("step").alias("step"))
    by_source = edges.join(near, F.col(source) == F.col("node")).select(*edges.columns, "step")
    by_target = edges.join(near, F.col(target) == F.col("node")).select(*edges.columns, "step")
    return by_source.unionByName(by_target).groupBy(*edges.columns).agg((F.min("step") + 1).alias("depth"))


def roots(parents: DataFrame, levels: int = 5, child: str = "child", parent: str = "parent") -> DataFrame:
    """The topmost ancestor of each child within ``levels`` steps; a cycle ends where it would repeat the child."""
    links = parents.select(F.col(child).alias("_c"), F.col(parent).alias("_p"))
    found = parents.select(F.col(child), F.col(parent).alias("root"), F.when(F.col(parent).isNull(), 0).otherwise(1).alias("level"))
    found = found.withColumn("root", F.coalesce("root", child))
    for _ in range(levels - 1):
        step = found.join(links, F.col("root") == F.col("_c"), "left")
        up = F.col("_p").isNotNull() & (F.col("_p") != F.col(child)) & (F.col("_p") != F.col("root"))
        found = step.select(child, F.when(up, F.col("_p")).otherwise(F.col("root")).alias("root"), F.when(up, F.col("level") + 1).otherwise(F.col("level")).alias("level"))
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the connected part of each node of ``edges`` (a, b), two whole numbers.

    Each round points every node's larger neighbours, then its smaller ones, at its
    smallest neighbour, which halves long chains; the parts are stars in the end.
    """
    links = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        down = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        flat = down.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = cut(flat)
        if now.exceptAll(links).isEmpty() and links.exceptAll(now).isEmpty():
            nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        links = now
