"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adweave.functions.storage import materialise


#: Edges of one node that a task takes; a node with more is split.
HOT = 200_000


def meet_least(edges: DataFrame, least: DataFrame, most: int | None = None, hot: int = HOT) -> DataFrame:
    """``u, v, m``: edges (u, v) with the least neighbour of u (``least``: u, m and the count n of u's edges).

    A node with over ``hot`` edges is a hot key: its edges are dealt by their
    other end into parts of about ``hot``, and its row of ``least`` is copied to
    each.  The split nodes, at most one for each ``hot`` edges, are broadcast.
    Among ``most`` edges, if that is known to be less, there is none to split.
    """
    if most is not None and most <= hot:
        return edges.join(least.select("u", "m"), "u")
    parts = F.ceil(F.col("n") / hot)
    split = F.broadcast(least.where(F.col("n") > hot).select("u", parts.alias("parts")))
    dealt = edges.join(split, "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1).cast("bigint"))).alias("part"))
    each = least.select("u", "m", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"))
    return dealt.join(each, ["u", "part"]).select("u", "v", "m")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges``; the smallest node names it.

    Alternates two steps until nothing changes: each node ties its larger
    neighbours to its smallest one (large star), then its smaller ones (small
    star).  Both only group by node, which sums up in each task first, and join
    by node, where one with very many edges, such as a star's centre, is split
    (``meet_least``); the rounds grow as the logarithm of the longest path.  Every round is written to the shared folder.  Edges
    with a null end are ignored; loops and repeated edges are fine; an empty
    table gives an empty result.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    current = materialise(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    seen, most = None, 2 * current.count()
    for _ in range(max_rounds):
        both = current.union(current.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = meet_least(both.where("v > u"), least, most).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = meet_least(large, least, most).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v")))
        current = materialise(small.where("u <> v").distinct(), "components")
        state = tuple(current.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen, most = state, 2 * state[0]
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return nodes.join(current, nodes["node"] == current["u"], "left").select("node", F.coalesce("v", "node").alias("component"))
