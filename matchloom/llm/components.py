"""Connected components of a table of links, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import staged


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. large: each node's larger neighbours are tied to its least neighbour (or itself); else its smaller
    neighbours and itself are."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        tied = edges.join(least, "a")
        out = tied.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node of its component) of all nodes of links (a, b), by alternating star steps.

    Nodes with no link do not occur. Loops and repeated links do no harm; no links give no rows. Every step is
    staged, so lineage stays short; hub nodes are spread by partial aggregation and split joins.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    state = None
    while True:
        edges = staged(_starred(_starred(edges, True), False), "stars")
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
