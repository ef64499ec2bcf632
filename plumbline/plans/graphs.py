"""Traversals of a directed graph given as an edge table (source_id, target_id, seq): iterative joins, cut by checkpoints.

For graphs that do not fit the driver. Every step joins the frontier with the edges, drops what was seen and ends when
nothing new is found. Each level is a checkpoint of its own, written once. ``seq`` orders edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .checkpoints import checkpoint, release


def reach(edges: DataFrame, start: str, max_depth: int = -1, reverse: bool = False, places: bool = False) -> DataFrame:
    """(node_id, depth): nodes reached from ``start``, which is left out, nearest first. Unknown: no rows.

    With ``places`` also the place that a queue would visit a node at within its level, which sorts each level as a
    whole: for levels that one task can hold.
    """
    source, target = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    links = checkpoint(edges.select(F.col(source).alias("node_id"), F.col(target).alias("next"), "seq"))
    kept = ["node_id", "depth", *["place"] * places]
    levels = [checkpoint(edges.sparkSession.createDataFrame([(start, 0, 0)], "node_id string, depth int, place long").select(*kept))]
    while max_depth < 0 or len(levels) <= max_depth:
        seen = reduce(DataFrame.unionByName, (level.select("node_id") for level in levels))
        ways = levels[-1].join(links, "node_id").select(F.col("next").alias("node_id"), *[F.struct("place", "seq").alias("by")] * places)
        found = (ways.groupBy("node_id").agg(F.min("by").alias("by")) if places else ways.distinct()).join(seen, "node_id", "left_anti")
        if places:
            found = found.withColumn("place", F.row_number().over(Window.orderBy("by")).cast("long"))
        level = checkpoint(found.withColumn("depth", F.lit(len(levels))).select(*kept))
        if level.isEmpty():
            break
        levels.append(level)
    release(links)
    return reduce(DataFrame.unionByName, levels).where(F.col("depth") > 0)


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, level): the longest way from a root, by peeling nodes without open predecessors; cycles raise."""
    rest, links, peeled = checkpoint(nodes.select("node_id")), checkpoint(edges.select("source_id", "target_id")), []
    while not rest.isEmpty():
        free = checkpoint(rest.join(links.select(F.col("target_id").alias("node_id")).distinct(), "node_id", "left_anti").withColumn("level", F.lit(len(peeled))))
        if free.isEmpty():
            raise RuntimeError("Graph contains a cycle; topological sort is impossible")
        peeled.append(free)
        old = rest, links
        rest = checkpoint(rest.join(free, "node_id", "left_anti"))
        links = checkpoint(links.join(free.select(F.col("node_id").alias("source_id")), "source_id", "left_anti"))
        release(*old)
    return reduce(DataFrame.unionByName, peeled) if peeled else nodes.select("node_id", F.lit(0).alias("level")).limit(0)


def ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, side): the nodes that no edge enters ("root") or leaves ("leaf"); a node on its own is both."""
    without = lambda end, side: nodes.join(edges.select(F.col(end).alias("node_id")).distinct(), "node_id", "left_anti").select("node_id", F.lit(side).alias("side"))
    return without("target_id", "root").unionByName(without("source_id", "leaf"))


def neighbours(edges: DataFrame, node_id: str) -> DataFrame:
    """(node_id, side): the direct successors and predecessors of a node."""
    side = lambda of, other, name: edges.where(F.col(of) == node_id).select(F.col(other).alias("node_id"), F.lit(name).alias("side"))
    return side("source_id", "target_id", "successor").unionByName(side("target_id", "source_id", "predecessor"))


def type_counts(nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """(node_type, n) of the given kinds, those without nodes included."""
    known = nodes.sparkSession.createDataFrame([(k,) for k in kinds], "node_type string")
    own = nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("own"))
    return known.join(own, "node_type", "left").select("node_type", F.coalesce("own", F.lit(0)).alias("n"))


def paths(spark: SparkSession, edges: DataFrame, start: str, most: int = 10_000) -> DataFrame:
    """(path): all ways from a node to leaves, by a recursive query. There may be exponentially many: Spark stops at its row limit."""
    return spark.sql(
        f"""WITH RECURSIVE walk(node_id, path) MAX RECURSION LEVEL {most} AS (
  SELECT :start AS node_id, array(:start) AS path
  UNION ALL
  SELECT e.target_id, array_append(w.path, e.target_id) FROM walk w JOIN {{edges}} e ON e.source_id = w.node_id)
SELECT path FROM walk LEFT ANTI JOIN {{edges}} e ON e.source_id = walk.node_id WHERE size(path) > 1""",
        args={"start": start},
        edges=edges,
    )
