"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.session import cut

#: Links of one task; a small link table is kept in few partitions, so that a round writes few files.
LINKS_A_TASK = 250_000


def _smallest(pairs: DataFrame) -> DataFrame:
    """Per node u of directed pairs (u, v): the smallest of u and its neighbours."""
    return pairs.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v); component is the smallest node reachable.

    Each round is two aggregations and two joins on node ids; a hub's links are spread by the joins, as no
    step gathers the links of one node. Rounds grow with the logarithm of the longest chain. Each round is
    checkpointed; the loop ends when a round leaves the links as they were.
    """
    edges = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    tasks = max(1, math.ceil(edges.count() / LINKS_A_TASK))
    edges = edges.coalesce(tasks)
    mark = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour v of u is linked to the smallest node around u
        large = both.where("v > u").join(_smallest(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(_smallest(both).select("u", F.col("m").alias("v"))).where("u <> v").coalesce(tasks).distinct().coalesce(tasks)
        # small star: u and every smaller neighbour are linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").coalesce(tasks).distinct().coalesce(tasks))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
