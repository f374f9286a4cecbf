"""Connected components of a graph too large for the driver: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, if_small


#: Edges of a node from which the smallest of its neighbours is broadcast to them, as one task could not take all.
HUB = 10_000


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the smallest neighbour m of u. A hub's edges stay where they are."""
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    hubs = least.filter(F.col("n") > HUB).select("u", "m")
    if hubs.isEmpty():
        return edges.join(least.select("u", "m"), "u")
    hubs = if_small(hubs)
    return edges.join(hubs, "u").unionByName(edges.join(hubs.select("u"), "u", "left_anti").join(least.filter(F.col("n") <= HUB).select("u", "m"), "u"))


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star round over edges (u, v)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    met = _with_least(both).withColumn("m", F.least("u", "m"))
    large = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    down = large.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    small = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple[int, int | None]:
    """What two rounds with the same edges have in common: their number and the XOR of their hashes, which cannot overflow as a sum does."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes with an edge to another: the component is its smallest node.

    Each round is written to the shared folder. Ends when a round changes nothing;
    the rounds grow with the logarithm of the longest path.
    """
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        state = _state(now)
        if state == seen or not state[0]:
            break
        seen = state
        now = cut(_star(now), "edges")
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
