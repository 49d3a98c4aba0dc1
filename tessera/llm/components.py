"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def connected_components(edges: DataFrame, work: common.Workspace, name: str = "components") -> DataFrame:
    """``node, label`` for every node of an edge; label is the component's smallest node.

    ``edges`` has the long columns ``a`` and ``b``. Each round puts every node under the first within two steps of
    it, in an order of hashes that changes with the round, and keeps the edges between different ones, so a star is
    done in one. Nodes become fewer in each round, so that all rounds together read a small multiple of the edges.
    Each round is written to the shared folder.
    """

    def undirected(a: str, b: str) -> list[Column]:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    left = work.save(edges.where("a <> b").select(*undirected("a", "b")).distinct(), f"{name}-edges-0")
    ups: list[DataFrame] = []
    while not left.isEmpty():
        step = len(ups)
        place = lambda x: F.struct(F.xxhash64(x, F.lit(step)).alias("h"), F.col(x).alias("label"))
        both = left.union(left.select(F.col("b"), F.col("a")))
        near = both.groupBy("a").agg(F.least(F.min(place("b")), place("a")).alias("near"))
        far = both.join(near.withColumnRenamed("a", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))  # a node is its neighbours' neighbour
        up = work.save(far.select("node", F.col("near.label").alias("label")), f"{name}-{step}")
        side = lambda x: up.select(F.col("node").alias(x), F.col("label").alias(f"{x}_up"))
        apart = left.join(side("a"), "a").join(side("b"), "b").where("a_up <> b_up")
        left = work.save(apart.select(*undirected("a_up", "b_up")).distinct(), f"{name}-edges-{step + 1}")
        work.drop(f"{name}-edges-{step}")
        ups.append(up)
    if not ups:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = ups.pop()
    while ups:
        above = out.select(F.col("node").alias("label"), F.col("label").alias("top"))
        out = ups.pop().join(above, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    out = work.save(out, f"{name}-tops")
    least = out.groupBy("label").agg(F.min("node").alias("least"))
    return work.save(out.join(least, "label").select("node", F.col("least").alias("label")), name)
