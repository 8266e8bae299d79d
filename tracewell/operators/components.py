"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import scratch, written


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node reachable.

    Alternating large-star and small-star rounds: each node hangs its larger
    neighbours, then its smaller ones, under its least neighbour. The number of
    rounds is logarithmic in practice; each is written, which cuts lineage, and
    only the last stays in the shared folder. A
    node with very many neighbours is reduced to a minimum before any join.
    """
    spark = edges.sparkSession
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    with scratch(spark) as keep:
        edges, before = written(edges.distinct(), "edges"), None
        for _ in range(most_rounds):
            with scratch(spark) as keep_round:
                large = _star(_both(edges), larger=True)
                edges = keep_round(written(_star(written(large, "stars"), larger=False).distinct(), "edges"))
            now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
            if now == before:
                break
            before = now
        else:
            raise RuntimeError(f"components did not settle within {most_rounds} rounds")
        keep(edges)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Hang neighbours under the least one: the larger neighbours of every node, or the node and its smaller ones."""
    # Written, so that the join's two sides are plain shuffles and a hot node's can be split.
    least = written(edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    joined = edges.join(least, "a")
    if larger:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    hung = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b")
