"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("h")).first()
    return r["n"], r["h"]


def connected_components(links: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """links (a, b), long ids in any direction -> (node, component) for every node with a link to another; the
    component is its smallest node. Each round's edges are a written table; a node with a third of all links is
    one side of a join whose other side has a row for each node, which adaptive execution splits."""
    edges = scratch.cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        # large star: every larger neighbour of a node gets the smallest of its neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = scratch.cut(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "edges")
        # small star: a node and its smaller neighbours get the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        small = scratch.cut(small, "edges")
        scratch.drop(edges, large)
        edges, before, state = small, state, _state(small)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
