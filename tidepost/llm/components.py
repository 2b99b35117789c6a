"""Connected components of a graph of links, by hooking and pointer jumping on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepost.session import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the root is one node of the component, the same for all.

    Every node that is not the smallest among its neighbours hooks to the smallest; pointer jumping flattens the trees;
    links inside a tree go. Each round at least halves what is left. Nothing is collected; joins are on single nodes, so
    Spark can split those with very many links.
    """
    both = links.filter("a <> b").select("a", "b").union(links.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(both.distinct(), "links")
    nodes = edges.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    while not edges.isEmpty():
        hooks = edges.groupBy("a").agg(F.min("b").alias("to")).filter(F.col("to") < F.col("a"))
        hooks = written(hooks, "hooks")
        while True:
            up = hooks.select(F.col("a").alias("to"), F.col("to").alias("above"))
            jumped = written(hooks.join(up, "to", "left").select("a", F.coalesce("above", "to").alias("to"), "above"), "hooks")
            hooks = jumped.select("a", "to")
            if jumped.filter("above is not null").isEmpty():
                break
        nodes = nodes.join(hooks.select(F.col("a").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        ends = edges.join(hooks.select("a", F.col("to").alias("ra")), "a", "left").select(F.coalesce("ra", "a").alias("a"), "b")
        ends = ends.join(hooks.select(F.col("a").alias("b"), F.col("to").alias("rb")), "b", "left").select("a", F.coalesce("rb", "b").alias("b"))
        edges = written(ends.filter("a <> b").distinct(), "links")
    return written(nodes, "roots")
