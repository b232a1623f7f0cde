"""Connected components by alternating large and small stars, as joins on written rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v.

    Each node points its larger (large star) or smaller (small star) neighbours, and
    itself, to the least node around it. Neighbours are joined, never gathered.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if large:
        joined = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        joined = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return joined.where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root), a written table, for every node of links (a, b): root is the least node of its component.

    Rounds go on until the edges no longer change; their number grows with the logarithm
    of the longest chain. Each round is written, so a lost executor costs one round.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
    edges = written(edges, "edges")
    before = state(edges)
    while True:
        last, edges = edges, written(star(star(edges, True), False), "edges")
        discard(last)
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out = written(roots, "roots")
    discard(edges)
    return out
