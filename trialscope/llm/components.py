"""Connected components of a graph of any size, by alternating star steps on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _toward_least(pairs: DataFrame) -> DataFrame:
    """Each row (u, v) with ``m``, the least v of its u.

    Minima are aggregated before they are shuffled, and written: a join of two plain scans is one whose
    hot keys (a node with a third of all edges) Spark can split.
    """
    return pairs.join(stored(pairs.groupBy("u").agg(F.min("v").alias("m")), "least"), "u")


def _star_step(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u > v)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _toward_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
    large = stored(large, "stars")
    near = _toward_least(large)
    hung = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(near.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: longs); the component is its least node.

    Null ends, loops and repeated edges are ignored. A graph without edges gives no rows. Each round
    is a table in the shared folder, so a lost executor repeats one round at most; the rounds grow
    with the logarithm of the longest path.
    """
    edges = (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    edges = stored(edges, label)
    sign = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"))
    seen = edges.agg(sign.alias("s")).first()["s"]
    while seen["n"]:
        edges = stored(_star_step(edges), label)
        now = edges.agg(sign.alias("s")).first()["s"]
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
