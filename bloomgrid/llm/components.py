"""Connected components by alternating large-star and small-star steps.

Every step is two shuffles over edges. A hub's edges are not gathered: its least neighbour is a
combining aggregate, and the join that hands it out may be split by key when skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bloomgrid.session import cut_lineage


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _tidy(both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v"))


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them. Edges have u < v."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    smaller = edges.join(least, "v").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return _tidy(smaller.unionByName(least.select(F.col("m").alias("u"), "v")))


def _tidy(edges: DataFrame) -> DataFrame:
    return (
        edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .where("u <> v")
        .distinct()
    )


def connected(edges: DataFrame) -> DataFrame:
    """id and label (the least id of its component) for every node of the edges (u, v).

    Loops and repeated edges are allowed; without edges the result is empty.
    """
    edges = cut_lineage(_tidy(edges))
    state = _state(edges)
    while True:
        edges = cut_lineage(small_star(large_star(edges)))
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("u").alias("id")).distinct()
    return edges.select(F.col("v").alias("id"), F.col("u").alias("label")).unionByName(
        roots.join(edges.select(F.col("v").alias("id")), "id", "left_anti").select(
            "id", F.col("id").alias("label")
        )
    )


def _state(edges: DataFrame) -> tuple:
    """A fixed-size account of the edge set, to see when steps no longer change it."""
    found = edges.agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"),
        F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s"),
    ).first()
    return tuple(found)
