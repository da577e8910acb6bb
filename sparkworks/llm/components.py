"""Connected components of a link table, as DataFrame joins (used by operators 6 and 7)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkworks.llm.common import settle_unsized as settle


#: Edges to a task: rounds of a small table have few tasks, however many parts the session deals shuffles into.
EDGES = 100_000
#: Minima of up to so many edges are broadcast: 1.5 MB at most, for each round leaves two such tables to the driver's collector.
BROADCAST = 20_000


def _stars(edges: DataFrame, large: bool, parts: int, few: bool) -> DataFrame:
    """One step of the alternating star algorithm on edges (u, v) with u > v, left in at most ``parts`` parts.

    Minima are settled before they are joined, so that the join can split the
    edges of a node that has most of them; where there are ``few``, they are broadcast.
    """
    near = F.broadcast if few else lambda df: df
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")).coalesce(parts))
        return both.join(near(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct().coalesce(parts)
    least = settle(edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts))
    moved = edges.join(near(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(parts)


def components(edges: DataFrame, max_rounds: int = 60, about: int | None = None) -> DataFrame:
    """(node, component) for every node of an edge table (a, b) of longs; the component is its least node.

    Alternating large-star and small-star steps (Kiveris and others, 2014):
    every node is joined to the least node around it until all components are
    stars, after a number of rounds that grows with the logarithm of the
    longest path.  Only a count and a checksum come to the driver.  Loops and
    repeated edges do no harm; rows with a null end are left out.  ``about`` says
    how many edges there may be, for the number of tasks of the first step alone.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and a <> b").distinct()
    now, seen = settle(now if about is None else now.coalesce(max(4, math.ceil(about / EDGES)))), None
    n = now.count()
    for _ in range(max_rounds):
        # Every step leaves as many edges as it was given, or fewer.
        parts, few = max(4, math.ceil(n / EDGES)), n <= BROADCAST
        now = settle(_stars(settle(_stars(now.coalesce(parts), True, parts, few)), False, parts, few))
        mark = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(v, u) as decimal(38, 0)))")).first()
        if mark == seen:
            break
        seen, n = mark, mark[0]
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
