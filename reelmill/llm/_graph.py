"""Connected components by alternating large-star and small-star rounds, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.llm._shared import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node it sees. The minima are a table of their own, so that
    the join has a plain shuffle on both sides and a node with very many neighbours can be split."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
    least = materialize(both.groupBy("n").agg(F.min("m").alias("m")).select("n", F.least("n", "m").alias("low")), "edges-least")
    return both.where("m > n").join(least, "n").select(F.col("low").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them. Edges stand as u < v."""
    least = materialize(edges.groupBy("v").agg(F.min("u").alias("low")), "edges-least")
    moved = edges.join(least, "v").select(F.col("low").alias("u"), F.col("u").alias("v"))
    return moved.unionByName(least.select(F.col("low").alias("u"), "v")).where("u < v")


def _state(edges: DataFrame) -> tuple:
    """Size and an order-free digest of the edge set."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v: long, any direction, repeats allowed) -> (node, component): each node that has an edge to another
    node, with the smallest node it reaches. Rows with a null end, and loops, count for nothing; no edges give no rows.

    Each round is written to the shared folder, so lineage stays short; the driver sees two numbers a round.
    """
    edges = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges = materialize(edges, "edges")
    before = _state(edges)
    while before[0]:
        after = materialize(_small_star(_large_star(edges).distinct()).distinct(), "edges")
        discard(edges)
        edges, state = after, _state(after)
        if state == before:
            break
        before = state
    nodes = edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return nodes.unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
