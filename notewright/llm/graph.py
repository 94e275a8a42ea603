"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import durable


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph.

    ``edges`` has two columns of one orderable type. Returns (node, component), the component being its least
    node, for every node that has an edge to another node. Self links and repeated links are ignored; an empty
    table gives an empty result. Each round is two joins against per-node minima, so that a node with very many
    links is only ever aggregated map-side, never gathered; rounds grow with the logarithm of the path length.
    """
    left, right = edges.columns[:2]
    current = durable(
        edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where("a <> b").distinct()
    )
    seen = _signature(current)
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        wide = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        parent = wide.groupBy("a").agg(F.min("b").alias("m"))
        joined = wide.join(parent, "a")
        small = joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = durable(small.unionByName(parent.select("a", F.col("m").alias("b"))).distinct())
        now = _signature(current)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
