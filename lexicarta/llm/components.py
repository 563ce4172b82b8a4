"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and joins over the edge table; no component
is gathered as a whole, though the edges of one node meet in one task of a join
where adaptive execution does not split it, and nothing but two counters reaches the
driver.  Edges are staged in the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Edges of a file: small tables are not scattered over many tasks and files.
FILE_EDGES = 200_000


def components(edges: DataFrame, scratch: Scratch, label: str = "cc", most_rounds: int = 60) -> DataFrame:
    """Edges ``(a, b)`` of longs in either direction; returns ``(node, component)`` with the smallest node.

    Nodes without an edge are not returned; self-loops and repeats are ignored.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    current = scratch.write(links, f"{label}-0")
    # no round has more edges than the first
    files = max(1, -(-current.count() // FILE_EDGES))
    seen = None
    for step in range(1, most_rounds + 1):
        both = current.union(current.select("b", "a"))
        # large-star: every larger neighbour of u points to the smallest of u's neighbourhood
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.write(large.coalesce(files), f"{label}-{step}l")
        # small-star: u and its smaller neighbours point to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x"), "m"), F.struct(F.col("b").alias("x"), "m"))).alias("e"))
        small = small.select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()
        after = scratch.write(small.coalesce(files), f"{label}-{step}")
        scratch.drop(f"{label}-{step}l")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        scratch.drop(f"{label}-{step - 1}")
        current = after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
