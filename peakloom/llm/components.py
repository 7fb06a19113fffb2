"""Connected components of a bipartite graph (nodes sharing keys), without collecting links anywhere.

A key that many nodes share is split by a salt: inside (key, salt) every node is linked to the smallest
node there, and the smallest nodes of the salts to the smallest of all. The links, at most one per (node,
key) and salt, are then contracted by alternating large-star and small-star rounds. A round is made of
minimum aggregates, which combine on the map side, and equi joins whose skewed side adaptive execution
may split; its result is written to the shared checkpoint folder, which cuts the lineage and
survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakloom.session import cut

SALTS = 64
MAX_ROUNDS = 60


def star_links(edges: DataFrame, salts: int = SALTS) -> DataFrame:
    """(u, v), u > v: links between nodes that share a key. edges: distinct (node, key), no nulls."""
    local = Window.partitionBy("key", "salt")
    salted = edges.select("node", "key", F.pmod(F.xxhash64("node"), F.lit(salts)).alias("salt")).withColumn("low", F.min("node").over(local))
    inner = salted.where("node > low").select(F.col("node").alias("u"), F.col("low").alias("v"))
    lows = salted.where("node = low").select("key", "low").distinct()
    outer = lows.withColumn("least", F.min("low").over(Window.partitionBy("key"))).where("low > least").select(F.col("low").alias("u"),
        F.col("least").alias("v"))
    return inner.unionByName(outer).distinct()


def contract(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node of its component."""
    links = cut(links)
    before = None
    for _ in range(MAX_ROUNDS):
        # Large star: every larger neighbour of u goes to the smallest of u and its neighbours.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u > v").distinct()
        # Small star: u and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        moved = large.join(low, "u").where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        links = cut(moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if now == before and (now[0] == now[2]):
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"not contracted after {MAX_ROUNDS} rounds")


def components(edges: DataFrame, nodes: DataFrame, salts: int = SALTS) -> DataFrame:
    """(node, root) of every row of nodes (distinct, no nulls); nodes that share no key are their own root."""
    roots = contract(star_links(edges, salts))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
