"""Connected components of a graph in DataFrame operations, with bounded rounds' lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for (a, b) edges: root is the least node that can be reached. Isolated nodes do not appear.

    Large-star and small-star by turns: each round hangs a node's larger, then its
    smaller neighbours on the least one, until nothing changes. Every round is
    written to the shared folder, so a lost executor costs one round at most. No
    node's neighbours meet in one value; only minima are taken over them.
    """
    edges = store.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = store.cut(small.where("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if (now["n"], now["h"]) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = (now["n"], now["h"])
    raise RuntimeError("the components did not settle")
