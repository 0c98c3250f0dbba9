"""Connected components of a graph given as a table of links, by joins and aggregations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibloom.llm.common import discard, materialize, settled

#: A safety stop; the number of rounds grows with the logarithm of the longest path.
MAX_ROUNDS = 60


def _star(links: DataFrame, both_ways: bool, hold: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """One step on links (u > v): join the neighbours of each node to the least of them.

    ``both_ways``: of all neighbours, the greater ones are joined to the least (large star);
    else, of the lesser neighbours, all and the node itself are (small star). The least comes
    from an aggregation, which combines before the shuffle; of many links it is written before
    it is joined: the links of a hub then meet it in a join with exchanges of its own, which
    Spark splits.
    """
    if both_ways:
        near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = hold(near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        moved = near.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = hold(links.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    moved = hold(moved.where(F.col("u") != F.col("v")).distinct(), "links")
    if hold is materialize:
        discard(least)
    return moved


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of every node of a link; component is the least node reachable.

    Alternates large and small stars until the links are stars around the least nodes. The
    links of each round are written to the shared folder; nothing but their count and a
    checksum reaches the driver. Links with a null end and self links are left out, repeated
    links count once; no links give no rows.
    """
    a, b = F.col(left), F.col(right)
    now = links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = materialize(now, "links")
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        hold = settled(state[0])
        large = _star(now, True, hold)
        after = _star(large, False, hold)
        after = after if hold is materialize else materialize(after, "links")
        discard(now, *((large,) if hold is materialize else ()))
        now, before, state = after, state, _state(after)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    heads = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)
