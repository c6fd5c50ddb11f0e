"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hangs the neighbours of each node (small: those not larger than it) on the least of them. edges: u, v, undirected.

    The least neighbour is a sum over rows that tasks take part by part; no list of neighbours is gathered.
    """
    both = edges.where("u > v") if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    hung = both.join(least, "u").where(F.lit(True) if small else F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if small:
        hung = hung.unionByName(least.select("u", F.col("m").alias("v")))
    return stored(hung.where("u <> v").distinct(), "star")


def components(links: DataFrame) -> DataFrame:
    """node, label for each node of links (a, b: long): label is the least node that its links reach."""
    edges = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 16))).first())
        if now == before:
            break
        before = now
        edges = _star(_star(edges, small=False), small=True)
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stored(labels.unionByName(labels.select(F.col("label").alias("node"), "label")).distinct(), "labels")
