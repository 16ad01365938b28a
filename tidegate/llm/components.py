"""Connected components of links, by alternating large and small stars.

Each round is an aggregate and a join on the node, both spread by key (partial
aggregates take up hubs, and a skewed join is split), and is written to the shared
folder. The number of rounds is logarithmic in the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step on edges (u, v) with u > v; the result has the same form."""
    if larger:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        turned = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        turned = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return turned.filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (u, v), the component being its smallest node.

    Links may repeat, run either way or join a node to itself; null ends are left out.
    No links give no rows.
    """
    clean = links.filter("u IS NOT NULL AND v IS NOT NULL")
    edges = stored(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    current, before = edges.filter("u > v"), None
    while True:
        current = stored(_star(_star(current, True), False), "stars")
        seen = current.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == before:
            break
        before = seen
    return nodes.join(current.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
