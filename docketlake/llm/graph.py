"""Connected components as a loop of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm.base import checkpoint

#: A node of more edges is a hub. The limit rises with the edges, so that there are at most HUBS hubs (16 bytes each).
HUB_EDGES, HUBS = 100_000, 1_000_000


def components(edges: DataFrame, a: str = "a", b: str = "b", hub_edges: int = HUB_EDGES) -> DataFrame:
    """The component of every node that has an edge: (id, component_id), the smallest id it reaches.

    Large-star and small-star steps alternate until the edges stop changing. Each step is one
    grouped minimum and one join; the edges of a hub stay where they are, and its minimum is broadcast to
    them, so neither a component nor a node's neighbours are ever gathered in one place. The number of
    rounds grows with the logarithm of the longest path. Every round is checkpointed, so a lost executor
    costs one round. Null ends and self loops are ignored; an empty input gives an empty result.
    """
    pairs = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    pairs = checkpoint(pairs.distinct())
    seen = _signature(pairs)
    while True:
        pairs = checkpoint(_small_star(_large_star(pairs, seen[0], hub_edges), seen[0], hub_edges))
        now = _signature(pairs)
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("hi").alias("id"), F.col("lo").alias("component_id")).union(pairs.select("lo", "lo").distinct())


def _signature(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.bit_xor(F.xxhash64("lo", "hi"))).first())


def _beside_least(rows: DataFrame, least: DataFrame, edges: int, hub_edges: int) -> DataFrame:
    """rows (u, v) beside m of least (u, m, n): the smallest node around u, which has n edges."""
    many = max(hub_edges, 2 * edges // HUBS)
    one = least.select("u", "m")
    if edges <= many:
        return rows.join(one, "u")
    hubs = F.broadcast(checkpoint(least.where(F.col("n") > many).select("u", "m")))
    return rows.join(hubs, "u").union(rows.join(hubs, "u", "left_anti").join(one, "u"))


def _large_star(pairs: DataFrame, edges: int, hub_edges: int) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(pairs.select("lo", "hi"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _beside_least(both.where(F.col("v") > F.col("u")), least, edges, hub_edges).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(pairs: DataFrame, edges: int, hub_edges: int) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. `edges` is what there are at most."""
    rows = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _beside_least(rows, least, edges, hub_edges).where(F.col("v") != F.col("m")).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("u", "m")).distinct()
