"""Connected components of link tables, without a graph ever leaving the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpanel.session import stage


def _least(links: DataFrame, own: str) -> DataFrame:
    """Per node the smallest of itself and its neighbours, joined back to its links."""
    least = links.groupBy(own).agg(F.least(F.col(own), F.min("v")).alias("m"))
    return links.join(least, own)


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for all nodes of ``links`` (a long, b long).

    Alternates two steps, each one grouping and one join on a node: every node hands its larger
    neighbours to its smallest one, then its smaller ones.  Rounds grow with the logarithm of the nodes;
    each is a table in the shared folder.  Repeated links, self links and an empty table are allowed.
    """
    links = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    state = None
    while True:
        seen = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state or not seen[0]:
            break
        state = tuple(seen)
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _least(large, "u")
        out = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        links = stage(out.where("u <> v").distinct(), "links")
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
