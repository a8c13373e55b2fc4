"""Connected components of a graph held as a table of links, by alternating large and small stars.

Each round rewires links towards smaller node names (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014); links, labels and counts stay in tables. A hot node's links are
never gathered: its minimum is a pre-aggregated `min`, and the join that hands the minimum
back deals both sides from tables, so Spark may split the hot key. A round's tables are
deleted when the next one has its own; they are kept in as many files as their links ask for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, scratch_table


#: Links in a file.
LINKS_PER_FILE = 250_000


def _minimum(links: DataFrame, node: str, other: str, files: int) -> DataFrame:
    """(node, m): the smallest of each node and its neighbours."""
    return scratch_table(links.groupBy(F.col(node).alias("node")).agg(F.least(F.min(other), F.first(node)).alias("m")).coalesce(files), "min")


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): for each node of a link between two different nodes, the smallest node it can reach.

    Null ends and self links are ignored; repeated links count once. A scratch table.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    edges = links.filter(f"`{a}` IS NOT NULL AND `{b}` IS NOT NULL AND `{a}` <> `{b}`").select(high.alias("u"), low.alias("v")).distinct()
    edges = scratch_table(edges, "links")
    files, seen = 1 + edges.count() // LINKS_PER_FILE, None
    for _ in range(most_rounds):
        # large star: neighbours above a node move to the node's minimum
        both = scratch_table(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(2 * files), "both")
        least = _minimum(both, "u", "v", files)
        moved = both.filter("v > u").join(least.withColumnRenamed("node", "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch_table(moved.filter("u <> v").distinct().coalesce(files), "large")
        forget(edges, both, least)
        # small star: a node and its lower neighbours move to the node's minimum
        least = _minimum(large, "u", "v", files)
        moved = large.join(least.withColumnRenamed("node", "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch_table(moved.unionByName(least.select(F.col("node").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct().coalesce(files), "small")
        forget(large, least)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    tops = edges.select(F.col("v").alias("node")).distinct().join(edges.select(F.col("u").alias("node")), "node", "left_anti")
    out = scratch_table(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops.select("node", F.col("node").alias("component"))), "components")
    forget(edges)
    return out
