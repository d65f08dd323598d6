"""Connected components of links, all in shuffled tables: hook to the smallest neighbour, jump to roots, contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, forget, salted_join


def roots(parents: DataFrame) -> DataFrame:
    """(node, comp): the root of every node of a forest (node, comp), where comp, the parent, is smaller than node.

    Pointer jumping: rounds grow as the logarithm of the depth. Roots themselves have no row. A parent of very many nodes
    is dealt over several tasks. An empty forest gives no rows."""
    now = cut(parents.select("node", "comp"), "parents")
    while True:
        up = now.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        new = cut(salted_join(now, up, ["comp"]).select("node", F.coalesce("top", "comp").alias("comp"), F.col("top").isNotNull().alias("moved")), "parents")
        forget(now)
        if new.filter("moved").isEmpty():
            return new.drop("moved")
        now = new.drop("moved")
        now.cut_path = new.cut_path


def labels(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable over edges (a long, b long), for every node but those smallest ones.

    Every node hooks to its smallest neighbour, if that is smaller; trees shrink to their roots, edges to edges between
    roots, which at least halve in two rounds. Rows never reach the driver, only whether there are any. No edges give
    no rows; null ends and loops are ignored."""

    def between(a, b) -> DataFrame:
        return edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()

    edges = cut(between("a", "b"), "edges")
    found = None
    while found is None or not edges.isEmpty():
        near = roots(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")))
        if found is None:
            found = near
        else:
            further = near.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
            found = cut(salted_join(found, further, ["comp"]).select("node", F.coalesce("top", "comp").alias("comp")).unionByName(near), "labels")
        ends = salted_join(edges, near.select(F.col("node").alias("a"), F.col("comp").alias("x")), ["a"])
        edges = salted_join(ends, near.select(F.col("node").alias("b"), F.col("comp").alias("y")), ["b"])
        edges = cut(between(F.coalesce("x", "a"), F.coalesce("y", "b")), "edges")
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable over edges (a long, b long), for every node of an edge that is no loop."""
    found = labels(edges)
    return found.unionByName(found.select(F.col("comp").alias("node"), "comp").distinct())
