"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """The smallest node that each node of the links (columns a, b; long) reaches: node, root.

    Each round joins every node's larger neighbours to the smallest node beside it (large star), then every
    node and its smaller neighbours to the smallest of them (small star), until nothing changes; the
    number of rounds grows with the logarithm of the longest path. A node's smallest neighbour is a partial
    minimum joined back to its links, so a hub's links are never gathered; the sum of all rows is
    written to the checkpoint folder after each round. Self-links and nulls are left out.
    """
    edges = cut_lineage(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    last = _sum(edges)
    while last[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        edges = cut_lineage(small)
        now = _sum(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _sum(edges: DataFrame) -> tuple:
    """Links and a checksum of them: equal sums in two rounds mean that no link has changed."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
